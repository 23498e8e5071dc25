"""Queries that once read a part of their tables read whole ones."""

import oracle
from granary.plans import registry

FOLDER = "/root/testdata/sf0.01"


def run(spark, name):
    got = registry.QUERIES[name](spark, FOLDER)
    oracle.compare(got, oracle.connect(FOLDER), registry.ORACLE_SQL[name])
    return got


def count(spark, table):
    return spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_conflicts_of_all_orders(spark):
    got = run(spark, "conflict_split")
    assert got.count() == count(spark, "orders") and got.where("o_orderkey >= 2000 and id like '%p25'").count() > 0


def test_all_labels_are_evidence(spark):
    got = run(spark, "lookup_by_fallback_keys")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    assert got.where("key_rank = 0").select("doc_id", "quality").exceptAll(labels).count() == 0
    assert labels.join(got.where("key_rank = 0"), "doc_id", "left_anti").count() == 0


def test_all_edges_against_all_nodes(spark):
    assert {r["end"]: r["edges"] for r in run(spark, "graph_dangling").collect()} == {"dst": count(spark, "lineitem")}


def test_registry_grows_with_the_table(spark):
    got = run(spark, "registry_incremental_new_keys")
    new = got.where("source like 'new %'").count()
    assert got.count() == count(spark, "documents") and 0.4 < new / got.count() < 0.6


def test_outer_join_of_whole_tables(spark):
    got = run(spark, "full_outer_indicator")
    assert got.where("_merge <> 'right_only'").count() == count(spark, "documents")


def test_folds_by_one_rule_at_every_size(spark):
    from pyspark.sql import functions as F

    from granary.operators import splits

    for n in (3_000, 300_000):  # a third of the rows in one group, the rest in groups of one row
        df = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("g"))
        folded = splits.balanced_group_folds(df, "g", 5)
        assert folded.columns == ["id", "g", "fold"] and folded.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
        rows = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
        assert sum(rows) == n and rows[-1] == n // 3 and rows[3] - rows[0] <= n / 1000, rows
    assert splits.balanced_group_folds(df.where("false"), "g", 5).count() == 0


def test_balance_is_returned(spark):
    got = registry.QUERIES["group_kfold_balance"](spark, FOLDER).collect()
    rows = [r["rows"] for r in got]
    assert len(got) == 5 and sum(rows) == count(spark, "orders") and max(rows) - min(rows) <= 40, rows
