"""Column functions and small operators that no query reaches on its own."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from granary.functions import normalize as N
from granary.functions import physics as P
from granary.functions.md5 import md5_words
from granary.operators import graph
from granary.operators import identity as I
from granary.operators import metrics as M
from granary.operators import quality as Q
from granary.operators import rules, splits
from granary.sources import readers, writers
from granary.streaming import campaign


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.orderBy("k").select(fn(F.col("x")).alias("y")).collect()]


def test_values(spark):
    assert column(spark, ["1,500 h", "-3.5%", "1e3", "none", None, ".5"], "string", N.to_number) == [1500.0, -3.5, 1000.0, None, None, 0.5]
    assert column(spark, ["Yes", " 1.0 ", "no", None, "2"], "string", N.truth) == [True, True, False, False, False]
    rules_ = [("fuel", ("h2", "hydrogen")), ("cell", ("cell",))]
    assert column(spark, ["Hydrogen cell", "a CELL", "x", None], "string", lambda c: N.label_by_rules(c, rules_, "rest")) == ["fuel", "cell", "rest", "rest"]
    two = spark.createDataFrame([("n/a", "b", "7"), (None, " ", "x 30"), ("a", "b", None)], "p string, q string, r string")
    assert [r.y for r in two.select(N.first_present("p", "q").alias("y")).collect()] == ["b", None, "a"]
    assert [r.y for r in two.select(N.any_in_range(["q", "r"], 5, 10).alias("y")).collect()] == [True, False, False]
    assert [r.y for r in two.select(Q.fill_ratio(["p", "q", "r"]).alias("y")).collect()] == [pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3)]
    assert N.list_cell("x") is not None and column(spark, [" a ;b| a\n c1 ", None], "string", N.list_cell) == [["a", "b", "c1"], []]


def test_list_items_keep_the_digits_of_their_places(spark):
    assert column(spark, ["0a; 1b;b1 ;2;"], "string", N.list_cell) == [["0a", "1b", "b1", "2"]]
    assert column(spark, ["0a=1; 1b=b1 "], "string", N.parse_pairs) == [{"0a": "1", "1b": "b1"}]


def test_units(spark):
    light = spark.createDataFrame([("100 mW/cm2", 100.0), ("1000 W/m2", 1000.0), ("dark", 1.0), (None, 0.5), ("x", 80.0), ("x", 0.0), ("mW/cm2", 9000.0)], "t string, n double")
    assert [r.y for r in light.select(P.standardize_light(F.col("t"), F.col("n")).alias("y")).collect()] == [1.0, 1.0, None, 0.5, 0.8, None, None]
    part = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double")
    for xs, want in (([0.5, 1.0, None], [50.0, 100.0, None]), ([50.0, 99.0], [50.0, 99.0])):
        df = part(xs)
        assert [r.y for r in df.select(P.fraction_to_percent(df, "x").alias("y")).collect()] == want
    df = spark.createDataFrame([(16.0, 20.0), (30.0, 10.0), (18.0, None)], "e double, i double")
    assert [r.y for r in df.select(P.retention_percent(df, "e", "i").alias("y")).collect()] == [80.0, 30.0, 18.0]
    df = spark.createDataFrame([(0.8, 20.0)], "e double, i double")
    assert df.select(P.retention_percent(df, "e", "i").alias("y")).first().y == 80.0
    rate = spark.createDataFrame([(0.9, 100.0, 5.0), (1.2, 100.0, 50.0), (None, None, None), (0.9, 0.5, None)], "r double, h double, t double").select(P.observed_rate(F.col("r"), F.col("h"), F.col("t")).alias("y")).collect()
    assert [None if r.y is None else round(r.y, 9) for r in rate] == [round(-math.log(0.9) / 100, 9), round(-math.log(0.8) / 50, 9), None, None]


def test_seeds_groups_and_prefixes(spark):
    assert M.estimate_seed("pce", "r2") == M.estimate_seed("pce", "r2") != M.estimate_seed("pce", "rmse") and 42 <= M.estimate_seed("a") < 1_000_042
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, r int")
    assert [r.y for r in df.select(splits.group_key("g", "r").alias("y")).collect()] == ["a", "NO_GROUP", "NO_GROUP"]
    assert [r.y for r in df.select(splits.group_key("g", "r", "row").alias("y")).collect()] == ["a", "missing_group_row_2", "missing_group_row_3"]
    assert column(spark, ["ab_c_x", "ab_c", "ab_d", "abc", "z"], "string", lambda c: I.longest_prefix(spark.range(0), "x", ["ab", "ab_c"])) == ["ab_c", "ab_c", "ab", None, None]
    numbers = spark.createDataFrame([(str(k) if k < 24 else "x", "1%" if k < 15 else None) for k in range(30)], "a string, b string")
    assert rules.promote_numeric(numbers, ["a", "b"]) == {"a": True, "b": False}


def test_reports_ledgers_and_json_before_csv(spark, tmp_path):
    row = spark.createDataFrame([(1, float("nan"), [float("inf"), 2.0], datetime.date(2024, 1, 2))], "n int, x double, l array<double>, d date")
    assert writers.json_report(row) == {"n": 1, "x": None, "l": [None, 2.0], "d": "2024-01-02"}
    with pytest.raises(ValueError):
        writers.json_report(row.limit(0))
    for k in range(2):
        writers.append_ledger(spark.createDataFrame([(k,)], "batch int"), str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    csv, json = spark.createDataFrame([("a", "csv"), ("b", "csv")], "_stem string, x string"), spark.createDataFrame([("a", "json", 1), ("a", "json", 2)], "_stem string, x string, more int")
    got = sorted((r._stem, r.x) for r in readers.prefer_json(spark, csv, json).collect())
    assert got == [("a", "json"), ("a", "json"), ("b", "csv")]


def test_rounds_and_windows(spark):
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    assert tuple(campaign.candidate_accounting(keys("aab"), keys("bcd"), "key").first()) == (2, 1, 1)
    assert campaign.targets_met(5, 3, 5, 3) and not campaign.targets_met(5, 2, 5, 3) and not campaign.targets_met(4, 9, 5, 3)
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    events = spark.createDataFrame([(at(1), "x"), (at(4), "x"), (at(6), "x"), (at(6), "y")], "t timestamp, kind string")
    got = sorted((r.window_start.minute, r.kind, r.events) for r in campaign.windowed_counts(events, "t", "kind", "5 minutes", "1 minute").collect())
    assert got == [(0, "x", 2), (5, "x", 1), (5, "y", 1)]


def test_md5_of_many_texts():
    import hashlib

    heads = [f"42:{d}:".encode() for d in (0, 7, 10, 99, 1999)] + [b""]
    names = [b"", b"a", b"123456", "é日本".encode(), b"x" * 47, b"x" * 51, b"x" * 55, b"x" * 56, b"x" * 300]
    got = md5_words(heads, names)
    assert ["%08x%08x%08x%08x" % tuple(got[:, j, k]) for j in range(len(names)) for k in range(len(heads))] == [hashlib.md5(h + n).hexdigest() for n in names for h in heads]


def test_attribution_deals_more_tasks_to_more_rows(spark, monkeypatch):
    monkeypatch.setattr(rules, "ROWS_AT_ONCE", 10)
    rows = [(k // 4, "xyz"[k % 3], float(k % 7 - 3), k // 40) for k in range(200)]
    values, groups = spark.createDataFrame(rows, "r int, f string, v double, c int"), spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "b")], "f string, group string")
    got = rules.grouped_attribution(values, groups, "r", "f", "v", "c")
    assert any("REPARTITION_BY_NUM" in line and ", 20)" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines())
    sums = {}
    for r, f, v, c in rows:
        key = r, c, "a" if f == "x" else "b"
        sums[key] = sums.get(key, 0) + v
    for r in got.collect():
        by = {c: [abs(v) for (_, x, g), v in sums.items() if x == c and g == r.group] for c in range(5)}
        assert r.mean_abs == pytest.approx(sum(map(sum, by.values())) / sum(map(len, by.values()))) and r.balanced_mean_abs == pytest.approx(sum(sum(x) / len(x) for x in by.values()) / 5)


def test_counts_of_edges_carry_no_properties(spark):
    rows = [("a", "b", "T", {"p": "1"}, 1), ("A", "b", "T", {"p": "1"}, 2), ("a", "c", "T", {}, 1), ("a", "b", "U", None, 1)]
    edges = graph.merge_edges(spark.createDataFrame(rows, "src string, dst string, type string, properties map<string,string>, seq int"))
    counts = graph.type_counts(edges)
    picked = [line for line in counts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "max_by" in line]
    assert picked and not any("max_by(properties" in line or "max_by(struct" in line or "max_by(src" in line for line in picked)
    assert sorted(map(tuple, counts.collect())) == [("T", 2), ("U", 1)]
    assert sorted((r.src, r.dst, r.type) for r in edges.collect()) == [("A", "b", "T"), ("a", "b", "U"), ("a", "c", "T")]
