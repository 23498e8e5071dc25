"""Readers, writers, recovery, integration and incremental operators on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from granary.functions import normalize as N
from granary.operators import identity as I
from granary.operators import metrics as M
from granary.operators import quality as Q
from granary.operators import recovery as R
from granary.operators import splits as S
from granary.sources import readers, writers
from granary.streaming import campaign


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "key"), [("﻿DOI: 10.1039/C8SE00314A", None), ("https://doi.org/10.1039/C8SE00314A.", "10.1039/c8se00314a"), ("doi: 10.1/a;", "10.1/a"), ("n/a", "")])
def test_doi(spark, raw, key):
    assert one(spark, raw.lstrip("﻿"), N.normalize_doi) == (key if key is not None else "10.1039/c8se00314a")


@pytest.mark.parametrize(("raw", "value"), [("60-85", 72.5), ("21.2 ± 0.3", 21.2), ("-5.5", -5.5), ("about 1,500 h", 1500.0), ("none", None), ("3 – 5 nm", 4.0), ("", None)])
def test_midpoint(spark, raw, value):
    assert one(spark, raw, N.numeric_midpoint) == value


def test_categories(spark):
    assert one(spark, "['DMF', 'DMSO']", lambda c: N.canonical_category(c, "solvents")) == "dmf; dmso"
    assert one(spark, "SLG / ITO|SnO2", lambda c: N.canonical_category(c, "Cell_stack_sequence")) == "slg | ito | sno2"
    assert one(spark, "Regular planar", lambda c: N.canonical_category(c, "Cell_architecture")) == "nip"
    assert one(spark, " N.A. ", lambda c: N.norm_missing(c)) is None and one(spark, " x ", lambda c: N.norm_missing(c)) == " x "
    assert one(spark, "a=1; b = 2;c", lambda c: N.parse_pairs(c)) == {"a": "1", "b": "2"}
    assert one(spark, "MA;FA", lambda c: N.aligned_fractions(c, F.lit("1;3"))) == {"MA": 0.25, "FA": 0.75}


def test_integration(spark):
    rows = spark.createDataFrame([("s", 21.61, None, 1), ("s", 21.13, None, 2), ("s", 19.12, None, 3), ("p", 21.61, None, 4), ("p", None, "ITO/HTL", 5)], "id string, pce double, stack string, seq int")
    split = I.split_conflicts(rows, "id", "pce", ["seq"])
    assert {r.id for r in split.collect()} == {"s_21p61", "s_21p13", "s_19p12", "p"}
    merged = I.coalesce_partial(split, "id", ["seq"]).where("id = 'p'").first()
    assert (merged.pce, merged.stack) == (21.61, "ITO/HTL")
    issues = spark.createDataFrame([("d_target_pce_14p82", 15.44, "x"), ("d_target_pce_15p86", 15.44, "x"), ("other", 1.0, "y")], "id string, pce double, stack string")
    found = sorted(r.issue for r in I.identity_issues(issues, "id", "pce", ["pce", "stack"]).collect())
    assert found == ["duplicate_final_device_identity"] * 2 + ["sample_id_pce_mismatch"] * 2
    with pytest.raises(Exception, match="repeats"):
        I.one_to_one_join(rows.select("id"), rows.select("id"), "id").collect()


def test_metrics(spark):
    df = spark.createDataFrame([(2.0, 2.0), (4.0, 3.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert (r.r2, round(r.rmse, 12), r.mae) == (0.5, round(0.5**0.5, 12), 0.5)
    flat = lambda p: M.regression_metrics(spark.createDataFrame([(3.0, p), (3.0, p)], "y double, p double"), "y", "p").first().r2
    assert flat(3.0) == 1.0 and flat(2.0) == 0.0
    c = spark.createDataFrame([(0, 0.1, 0), (0, 0.4, 0), (1, 0.4, 0), (1, 0.8, 1)], "y int, s double, p int")
    assert M.roc_auc(c, "y", "s").first().auc == 0.875
    m = M.classification_metrics(c, "y", "p").first()
    assert (m.accuracy, m.balanced_accuracy, round(m.f1, 12)) == (0.75, 0.75, round(2 / 3, 12))
    assert M.roc_auc(c.where("y = 1"), "y", "s").first().auc is None


def test_bootstrap_weighs_groups_like_repeated_rows(spark):
    rows = [(1.0, 1.3, "b"), (2.0, 2.1, None), (4.0, 3.5, "b"), (3.0, 2.9, None), (6.0, 5.0, "c")]
    df = spark.createDataFrame(rows, "y double, p double, g string")
    got = {r.metric: r for r in M.cluster_bootstrap(df, "y", "p", "g", draws=50).collect()}
    m = df.select(F.coalesce("g", F.lit("NO_GROUP")).alias("g"), "y", "p").withColumn("m", M.poisson_multiplicities(F.col("g"), 50, 42))
    import numpy as np

    rows = m.collect()
    values = []
    for d in range(50):
        drawn = [(r.y, r.p) for r in rows for _ in range(r.m[d])]
        if drawn:
            y, p = np.array(drawn).T
            values.append(np.sqrt(np.mean((p - y) ** 2)))
    assert got["rmse"].ci_lower == pytest.approx(np.percentile(values, 2.5), abs=1e-9) and got["rmse"].ci_upper == pytest.approx(np.percentile(values, 97.5), abs=1e-9)
    assert got["rmse"].groups == 3 and got["rmse"].rows == 5


def test_paired_bootstrap_has_a_hash_for_each_draw(spark):
    import hashlib
    import math

    import numpy as np

    groups, draws = [chr(97 + k % 23) if k % 5 else None for k in range(120)], 41
    rows = [(float(k % 17), k % 17 + k % 3 / 3, k % 17 - k % 4 / 7, g) for k, g in enumerate(groups)] + [(None, 1.0, 1.0, "a"), (1.0, None, 1.0, "a")]
    df = spark.createDataFrame(rows, "y double, a double, b double, g string").repartition(3)
    got = {r.metric: r for r in M.paired_bootstrap(df, "y", "a", "b", "g", draws=draws).collect()}
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(11)])
    y, a, b = (np.array([r[k] for r in rows[:120]]) for k in range(3))
    deltas = []
    for d in range(draws):
        m = np.array([np.sum(steps <= int(hashlib.md5(f"42:{d}:{g or 'NO_GROUP'}".encode()).hexdigest()[:13], 16) / 2**52) for g in groups])
        rmse = [np.sqrt(np.average((p - y) ** 2, weights=m)) for p in (a, b)]
        deltas.append(rmse[1] - rmse[0])
    r = got["rmse"]
    assert r.draws == draws and [r.ci_lower, r.median_delta, r.ci_upper] == pytest.approx(list(np.percentile(deltas, [2.5, 50, 97.5])), abs=1e-9)
    odd = df.union(spark.createDataFrame([(float("inf"), 1.0, 1.0, "z")], df.schema))  # only the draws that its group enters have no number
    assert 0 < sum(not math.isfinite(x.sy) for x in M._weighed(odd.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("sy")).na.fill("NO_GROUP", ["g"]), draws, 42, "poisson", ["n", "sy"], 1).collect()) < draws


def test_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(k, f"doi_{k // 3}") for k in range(30)], "y int, g string")
    folded = S.balanced_group_folds(df, "g", 5)
    assert M.fold_integrity(folded, "g", "fold").count() == 0 and {r["count"] for r in folded.groupBy("fold").count().collect()} == {6}


def test_recovery(spark):
    texts = [
        (1, "The champion device reached a PCE of 21.2% with Voc = 1.12 V, Jsc of 24.1 mA cm-2 and FF = 0.79."),
        (2, "Unencapsulated devices in ambient air: stability improved and T80 = 1,500 h was measured for the cell."),
        (3, "The encapsulated cell retained 92% of its initial efficiency after 1000 h under illumination."),
        (4, "The relative humidity was 40% for 500 h."),
        (5, None),
    ]
    df = spark.createDataFrame(texts, "id int, t string")
    best = {name: {r.id: r for r in R.recover(df, "id", "t", spec).collect()} for name, spec in (("pce", R.PERFORMANCE), ("t80", R.LIFETIME), ("ret", R.RETAINED))}
    assert best["pce"][1]["values"] == [21.2] and best["pce"][1].score == 13 and set(best["pce"]) == {1}
    assert best["t80"][2]["values"] == [1500.0] and set(best["t80"]) == {2}
    assert best["ret"][3]["values"] == [92.0, 1000.0] and set(best["ret"]) == {3}
    filled = R.fill_missing(df.withColumn("pce", F.lit(None).cast("double")), R.recover(df, "id", "t", R.PERFORMANCE).select("id", F.col("values")[0].alias("pce")), "id", ["pce"])
    assert {r.id: (r.pce, r._changed) for r in filled.collect()}[1] == (21.2, ["pce"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿doi,title\n10.1/A,x\n".encode())
    (tmp_path / "b.csv").write_bytes("doi,extra\n10.1/B,ü\n".encode("cp1252"))
    (tmp_path / "audit_c.csv").write_text("doi\nno\n")
    (tmp_path / "d.csv").write_bytes("doi,title\n10.1/D,ö\n".encode("utf-16"))
    for k, name in enumerate(["a.csv", "b.csv", "d.csv"]):
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    paths = readers.record_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["a.csv", "b.csv", "d.csv"]
    df = readers.read_records(spark, paths)
    assert df.columns == ["doi", "title", "extra", "_file_seq", "_source_file"]
    assert [(r.doi, r.title, r.extra) for r in df.orderBy("_file_seq").collect()] == [("10.1/A", "x", None), ("10.1/B", None, "ü"), ("10.1/D", "ö", None)]
    (tmp_path / "log.jsonl").write_text('{"event": "paper_complete", "slug": "a"}\n\nbroken\n{"event": "x", "slug": "b"}\n')
    assert [r.slug for r in readers.read_events(spark, str(tmp_path / "log.jsonl"), "event string, slug string", "paper_complete").collect()] == ["a"]
    texts = tmp_path / "texts"
    texts.mkdir()
    for name in ("p1__summary.txt", "p1__performance.txt", "p2__x.txt"):
        (texts / name).write_text(name)
    got = {r.slug: r.text for r in readers.read_text_artifacts(spark, str(texts)).collect()}
    assert got == {"p1": "p1__performance.txt\np1__summary.txt", "p2": "p2__x.txt"}


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", ["B", "A"], {"k": "v & <w>\x01"}), ("n2", ["A"], {})], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("r1", "n1", "n2", "USES", {"x": "1"})], "rel_id string, src string, dst string, type string, properties map<string,string>")
    writers.write_bulk_csv(nodes, edges, str(tmp_path / "bulk"))
    back = readers.read_csv(spark, str(tmp_path / "bulk" / "nodes"))
    assert back.columns == ["id:ID", ":LABEL", "properties_json"] and {r[1] for r in back.collect()} == {"A;B", "A"}
    writers.write_graph_lines(nodes, edges, str(tmp_path / "lines"))
    assert json.loads(spark.read.text(str(tmp_path / "lines" / "relationships")).first()[0])["target"] == "n2"
    xml = [r.value for r in writers.graphml_elements(nodes, edges).collect()]
    assert '<node id="n1"><data key="k">v &amp; &lt;w&gt;</data></node>' in xml
    manifest = writers.content_manifest(spark, str(tmp_path / "lines"))
    kept = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert writers.verify_manifest(manifest, kept).count() == 0
    assert {r.status for r in writers.verify_manifest(manifest, kept.withColumn("sha256", F.lit("0"))).collect()} == {"changed"}


def test_campaign(spark, tmp_path):
    assert campaign.query_plan(["A b", "a  B", "c"], ["C", "d"]) == ["A b", "c", "d"] and campaign.query_plan(["a", "b", "c"], [], 2) == ["a", "b"]
    inputs, registry, out = (str(tmp_path / n) for n in ("in", "registry", "out"))
    spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "doi string, seq int").coalesce(1).write.parquet(inputs)
    run = lambda: campaign.start_campaign(campaign.stream_table(spark, inputs), "doi", ["seq"], registry, out, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("y", 4), ("z", 5)], "doi string, seq int").write.mode("append").parquet(inputs)
    run()
    assert sorted((r.doi, r.seq) for r in spark.read.parquet(out).collect()) == [("x", 1), ("y", 2), ("z", 5)]
    again = campaign.process_batch(registry, "doi", ["seq"], out)
    last = spark.read.parquet(registry).agg(F.max("batch")).first()[0]
    again(spark.createDataFrame([("y", 4), ("z", 5)], "doi string, seq int"), last)
    assert spark.read.parquet(out).count() == 3
    ledger = spark.createDataFrame([(1, 5, "t"), (2, 9, None)], "batch int, papers int, finished string")
    assert [r.papers_delta for r in campaign.ledger_deltas(ledger, "batch", ["papers"]).orderBy("batch").collect()] == [5, 4] and campaign.next_batch(ledger) == 2


def test_year_and_coverage(spark):
    df = spark.createDataFrame([("2019-01", "x", None), ("n/a", None, "1"), ("in 1987", "na", "2")], "d string, a string, b string")
    assert [r.y for r in df.select(N.year_of("d").alias("y")).collect()] == [2019, None, 1987]
    assert {r["column"]: r.present for r in Q.column_coverage(df, ["a", "b"]).collect()} == {"a": 1, "b": 2}
