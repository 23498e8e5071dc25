"""Publication checks on the survey's fixtures."""

from pyspark.sql import functions as F

from granary.operators import release as R
from granary.sources import readers

P = "raw_frozen_row_key string, canonical_row_key string"
M = "raw_row_key string, canonical_row_key string, in_training string, is_frozen_test_sample string"
TEST = ("doi: 10.1126/science.adm9474|0.0|01|", "10.1126/science.adm9474|0.0|01|")
HELD, TRAIN = (TEST[1], TEST[1], "False", "True"), ("10.1126/science.adm9474|2|02|", "10.1126/science.adm9474|2|02|", "True", "False")


def errors(spark, predictions, membership):
    return {r.error for r in R.identity_errors(spark.createDataFrame(predictions, P), spark.createDataFrame(membership, M)).collect()}


def test_sample_identities(spark):
    assert errors(spark, [TEST], [HELD, TRAIN]) == set()
    assert errors(spark, [TEST], [(*HELD[:2], "True", "True"), TRAIN]) == {"the same canonical sample appears in training and test"}
    assert errors(spark, [TEST], [(*HELD[:2], "False", "False"), TRAIN]) == {"training audit does not identify every frozen test sample"}
    assert errors(spark, [], [HELD, TRAIN]) == {"training audit does not identify every frozen test sample"}
    assert errors(spark, [TEST] * 2, [HELD, TRAIN]) == {"canonical test sample identities collide"}
    assert errors(spark, [TEST], [HELD, TRAIN, TRAIN]) == {"eligible canonical sample identities collide"}
    assert errors(spark, [(TEST[0].replace("0.0", "0"), TEST[1])], [HELD]) == {"canonicalization changed a sample suffix or publication contract"}
    assert errors(spark, [], []) == set()


def test_publications_stay_in_one_fold(spark):
    def found(rows):
        return {r.error for r in R.publication_fold_errors(spark.createDataFrame(rows, "label string, identity string, fold string"), "label", "identity", "fold").collect()}

    low = "10.1039/c8se00314a"
    assert found([("10.1039/C8SE00314A", low, "2"), (low, low, "2")]) == set()
    assert found([("10.1039/C8SE00314A", low, "2"), (low, low, "3")]) == {"a canonical publication crosses historical test folds"}
    assert found([("10.1039/C8SE00314A", "10.1039/C8SE00314A", "2")]) == {"stability canonical publication does not match its retained source label"}
    assert found([(low, None, "2"), (low, "", "3")]) == {"stability publication identity is missing"}


def test_hygiene(spark):
    files = [("a.md", "fine C:/data"), ("b.md", "C:\\\\Users\\\\me\\\\x"), ("c.md", "/home/me/x"), ("d.md", "bell \x07"), ("e.md", "ghp_" + "x" * 30), ("f" * 181, None), ("g.md", "tab\tand\nline")]
    got = sorted(tuple(r) for r in R.hygiene_issues(spark.createDataFrame(files, "path string, text string"), "path", "text").collect())
    assert got == [("b.md", "personal absolute path"), ("c.md", "personal absolute path"), ("d.md", "unexpected control character"), ("e.md", "credential pattern"), ("f" * 181, "relative path length 181 exceeds limit 180")]


def test_numbers_categories_and_shapes(spark, tmp_path):
    rows = [("JV_default_PCE", 20.0, 20.15, True), ("JV_default_PCE", 20.0, 20.5, False), ("JV_default_Voc", 1.1, 1.12, False), ("other", 1.0, 1.0, None), ("JV_default_PCE", None, 1.0, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, f string, v double, g double, want boolean")
    assert df.where(~R.within_tolerance(F.col("f"), F.col("v"), F.col("g")).eqNullSafe(F.col("want"))).count() == 0
    cells = [("Inverted planar", "p-i-n"), ("NIP", "n-i-p"), ("Mesoporous inverted", "mesoporous"), (" Other  Kind", "other kind"), (None, "__missing__")]
    got = [r.c for r in spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cells)], "k int, c string").orderBy("k").select(R.review_category("Cell_architecture", F.col("c")).alias("c")).collect()]
    assert got == [w for _, w in cells]
    assert spark.createDataFrame([("isos l_2 test",)], "c string").select(R.review_category("Stability_protocol", F.col("c"))).first()[0] == "ISOS-L-2"
    text = R.shapes_document({"Paper": ["schema:identifier"], "Claim": ["text"]}, {"Claim": {"status": "evidence_linked"}}, {"la": "https://x/"})
    assert "la:PaperShape a sh:NodeShape ;\n  sh:targetClass la:Paper ;\n  sh:property [ sh:path schema:identifier ; sh:minCount 1 ] ." in text and 'sh:hasValue "evidence_linked" ] .' in text
    (tmp_path / "s.json").write_text('\ufeff{"a": 1}', encoding="utf-8")
    (tmp_path / "broken.json").write_text("{")
    assert [readers.read_settings(spark, str(tmp_path / n)) for n in ("s.json", "broken.json", "none.json")] == [{"a": 1}, {}, {}]
