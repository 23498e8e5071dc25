"""Files of mixed encodings and headers, one-document exports, and joins, groups and ranks over whole tables."""

import csv
import json
import random
import xml.etree.ElementTree as ET
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import agreement as A
from granary.operators import components, consolidate, substring
from granary.sources import documents as D
from granary.sources import encodings as E
from granary.sources import readers

GRAPH = {"labels": "array<string>", "properties": "map<string,string>"}


def test_every_file_in_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name,note\n1,Müller,“x”\n2,b\n3,c,d,too many\n4,\"two\nlines, with \"\"quotes\"\"\",e\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("note,id\nÄ,5\n".encode("utf-16"))
    (tmp_path / "c.csv").write_bytes("﻿id,name,id\n6,żółw,7\n".encode())
    (tmp_path / "d.csv").write_bytes(b"id,name,note\n" + b"7,plain,x\n" * 20_000 + "8,é,\x93\n".encode("latin-1"))  # nothing odd in the first 64 KiB
    (tmp_path / "e.csv").write_bytes(b"")
    rows, skipped = E.read_csv_files(spark, str(tmp_path), ("UTF-8", "windows-1252"), "*.csv")
    assert rows.columns[-2:] == ["_file_seq", "_source_file"] and set(rows.columns[:-2]) == {"id", "name", "note"}
    got = {r.id: (r.name, r.note, r._source_file) for r in rows.distinct().collect()}
    assert got == {
        "1": ("Müller", "“x”", "a.csv"), "2": ("b", None, "a.csv"), "4": ('two\nlines, with "quotes"', "e", "a.csv"), "5": (None, "Ä", "b.csv"), "6": ("żółw", None, "c.csv"), "7": ("plain", "x", "d.csv"), "8": ("é", "“", "d.csv"),
    }
    assert rows.count() == 20_000 + 6 and [(r._source_file, r.line) for r in skipped.collect()] == [("a.csv", "3,c,d,too many")]
    survey = {r.path.rsplit("/", 1)[-1]: (r.encoding, r.multi_line, r.lines) for r in E.survey_files(spark, str(tmp_path), ("UTF-8", "windows-1252"), "*.csv").collect()}
    assert survey["d.csv"] == ("windows-1252", False, 20_002) and survey["a.csv"][1] and survey["c.csv"][0] == "UTF-8" and survey["b.csv"][0] == "UTF-16"
    (tmp_path / "f.csv").write_bytes(b"id\n\x81\n")
    with pytest.raises(ValueError, match="f.csv"):
        E.read_csv_files(spark, str(tmp_path / "f.csv"), ("UTF-8", "windows-1252"))
    assert E.count_rows(spark, str(tmp_path / "c.csv")) == 1
    assert readers.read_csv(spark, str(tmp_path / "c.csv")).columns == ["id", "name"]


def test_no_files_with_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    rows, skipped = E.read_csv_files(spark, str(tmp_path))
    assert rows.collect() == [] and skipped.collect() == []


def test_newest_preview_and_tail(spark, tmp_path):
    import os

    for k, name in enumerate(["b.txt", "a.txt"]):
        (tmp_path / name).write_text("".join(f"{name}{j}\n" for j in range(50)))
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    assert E.newest_file(spark, str(tmp_path)).endswith("a.txt") and E.newest_file(spark, str(tmp_path), "*.none") is None
    assert E.tail_lines(spark, str(tmp_path / "a.txt"), 2) == ["a.txt48", "a.txt49"]
    assert E.preview(spark.range(100), 3).count() == 3


def graph(spark):
    nodes = spark.createDataFrame([("n1", ["B", "A"], {"b": "x & <y>", "a": "\x01é"}), ("n\"2'", ["C"], None)], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("e1", "n1", "T", "n\"2'", {"@id": "mine", "source": "s", "w": "1"})], "rel_id string, src string, type string, dst string, properties map<string,string>")
    return nodes.repartition(3), edges


def test_graphml_is_one_document(spark, tmp_path):
    nodes, edges = graph(spark)
    path = tmp_path / "g.graphml"
    for _ in range(2):  # the second replaces the first
        D.write_graphml(nodes, edges, str(path), "g")
    root = ET.parse(path).getroot()
    x = "{http://graphml.graphdrawing.org/xmlns}"
    assert [k.get("id") for k in root.findall(f"{x}key")] == ["label", "node_properties", "relationship_type", "relationship_properties"]
    data = lambda e: {d.get("key"): d.text for d in e.findall(f"{x}data")}
    found = {e.get("id"): data(e) for e in root.iter(f"{x}node")}
    assert {k: (v["label"], json.loads(v["node_properties"])) for k, v in found.items()} == {"n1": ("A;B", {"a": "\x01é", "b": "x & <y>"}), "n\"2'": ("C", {})}
    (e,) = root.iter(f"{x}edge")
    assert (e.get("source"), e.get("target"), data(e)["relationship_type"]) == ("n1", "n\"2'", "T")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["g.graphml"]
    D.write_graphml(nodes.limit(0), edges.limit(0), str(path), "g")
    assert list(ET.parse(path).getroot().iter(f"{x}node")) == []


def test_jsonld_is_one_document(spark, tmp_path):
    nodes, edges = graph(spark)
    path = tmp_path / "g.jsonld"
    D.write_jsonld(nodes, edges, str(path), {"la": "x"}, "la:")
    whole = json.loads(path.read_text())
    items = {i["@id"]: i for i in whole["@graph"]}
    assert whole["@context"] == {"la": "x"} and len(whole["@graph"]) == 3
    assert items["la:n1"] == {"@id": "la:n1", "@type": "la:A;B", "a": "\x01é", "b": "x & <y>"}
    assert items["la:e1"] == {"@id": "la:e1", "@type": "la:T", "source": "la:n1", "target": "la:n\"2'", "w": "1"}
    D.write_jsonld(nodes.limit(0), edges.limit(0), str(path), {})
    assert json.loads(path.read_text())["@graph"] == []


def test_header_of_all_keys(spark, tmp_path):
    rows = spark.createDataFrame([(2, {"b": "x,\n\"y\"", "c": None}), (1, {"d": "1", "a": "2"}), (3, {"a": "é"})], "seq int, record map<string,string>")
    D.write_united_csv(rows, "record", "seq", str(tmp_path / "u.csv"))
    got = list(csv.reader(Path(tmp_path / "u.csv").open(newline="", encoding="utf-8")))
    assert got == [["a", "d", "b", "c"], ["2", "1", "", ""], ["", "", 'x,\n"y"', ""], ["é", "", "", ""]]


def test_substring_joins(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [(k, word(rng.randrange(0, 60))) for k in range(200)] + [(900, None), (901, ""), (902, "xyz\nabab"), (903, "x" * 50_000)]
    needles = [(k, word(rng.randrange(1, 9))) for k in range(60)] + [(100, None), (101, ""), (102, "\nab"), (103, "qqqqqqqq"), (104, "z"), (105, "xxxxxxxxxx")]
    needles.append((106, needles[0][1]))
    t, n = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(needles, "j int, needle string")
    want = sorted((k, j) for k, a in texts for j, b in needles if a and b and b in a)
    for found in (substring.contains_join(t, "text", n, "needle"), substring.contains_join(t, "text", n, "needle", most=3)):
        assert sorted((r.k, r.j) for r in found.collect()) == want
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.columns == ["k", "text", "j", "needle"]
    assert substring.contains_join(t, "text", n.limit(0), "needle").collect() == [] == substring.contains_by_grams(t.limit(0), "text", n, "needle").collect()


def test_groups_and_papers(spark):
    chain = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(200)] + [("x", "y"), ("z", None), (None, None)], "a string, b string")
    got = {r.id: r.group for r in components.linked_groups(chain).collect()}
    assert got == {f"n{k:03d}": "n000" for k in range(201)} | {"x": "x", "y": "x", "z": "z"}
    rows = [(1, "10.1/a", None, "", "short", "web"), (2, None, "t1", "B", "longer one", None), (3, "10.1/a", "t1", "C", "longer two", "pdf"), (4, None, None, "D", None, "pdf"), (5, None, "", None, None, None), (6, None, "t9", "E", "n/a", "web")]
    r = spark.createDataFrame(rows, "id int, doi string, title string, author string, abstract string, kind string")
    papers = consolidate.consolidate_papers(r, "id", {"doi": F.col("doi"), "title": F.col("title")}, "id", ["author"], ["abstract"], ["kind"], {"with_pdf": F.col("kind") == "pdf"})
    got = {p.paper: (p.raw_record_count, p.author, p.abstract, p.kind, p.with_pdf) for p in papers.collect()}
    assert got == {"doi:10.1/a": (3, "B", "longer one", ["pdf", "web"], 1), "row:4": (1, "D", None, ["pdf"], 1), "row:5": (1, None, None, [], 0), "title:t9": (1, "E", None, ["web"], 0)}


def brute_tau(a, b):
    c = d = ta = tb = both = 0
    for i in range(len(a)):
        for j in range(i):
            s = np.sign(a[i] - a[j]) * np.sign(b[i] - b[j])
            c, d, ta, tb, both = c + (s > 0), d + (s < 0), ta + (a[i] == a[j]), tb + (b[i] == b[j]), both + (a[i] == a[j] and b[i] == b[j])
    return tuple(map(int, (c, d, ta, tb, both)))


@pytest.mark.parametrize("pairs", [10**6, 7, 40])
def test_kendall_like_all_pairs(spark, pairs):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.integers(0, 30, 120), np.full(60, 7)]).astype(float)
    b = np.round(a + rng.normal(0, 9, len(a)))
    b[rng.random(len(b)) < 0.3] = 5
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist()), (None, 1.0), (1.0, None), (float("nan"), 2.0)], "a double, b double")
    r = A.kendall_tau(df, "a", "b", pairs).first()
    c, d, ta, tb, both = brute_tau(a, b)
    assert (r.n, r.concordant, r.discordant, r.tied_a, r.tied_b, r.tied_both) == (180, c, d, ta, tb, both)
    n0 = 180 * 179 // 2
    assert abs(r.tau - (c - d) / np.sqrt(float(n0 - ta) * float(n0 - tb))) < 1e-12
    assert A.kendall_tau(df.limit(0), "a", "b").first().tau is None and A.kendall_tau(df.where("a = 7"), "a", "b").first().tau is None


def test_agreement_gate(spark):
    rng = np.random.default_rng(1)
    rows = [(k, f"g{g:02d}", float(g + rng.normal()), float(g), 1e-9) for k in range(20) for g in range(30)]
    df = spark.createDataFrame(rows, "row int, g string, a double, e double, rest double")
    r = A.importance_agreement(df, "g", "a", "e", "rest").first()
    assert r.passed and r.overlap == 20 and r.reconstruction_max == 1e-9 and r.kendall > 0.9
    assert not A.importance_agreement(df, "g", "a", "e", "rest", most_residual=1e-10).first().passed


def test_graphml_is_read_in_splits(spark, tmp_path):
    texts = ["a\nb", "c\r\nd", "<e> &", "  f  ", "", None, "é\u2028"]
    nodes = spark.createDataFrame([(f"n{k}\n{k}", [texts[k % 7] or "x"], {"t": texts[k % 7]}) for k in range(2000)], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([(f"r{k}", f"n{k}\n{k}", "T", "m") for k in range(2000)], "rel_id string, src string, type string, dst string").withColumn("properties", F.lit(None).cast("map<string,string>"))
    D.write_graphml(nodes, edges, f"file://{tmp_path}/g.graphml")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        n, e = D.read_graphml(spark, f"file://{tmp_path}/g.graphml")
        assert n.rdd.getNumPartitions() > 5 and n.count() == e.count() == 2000
        got = {r["_id"]: {d["_key"]: d["_VALUE"] for d in r["data"]} for r in n.collect()}
        assert {r["_source"] for r in e.collect()} == set(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k in range(2000):
        assert (got[f"n{k}\n{k}"]["label"] or "") == (texts[k % 7] or "x") and json.loads(got[f"n{k}\n{k}"]["node_properties"]).get("t") == texts[k % 7]
