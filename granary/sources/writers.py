"""Writers of tables and graphs; all go through Spark's commit protocol, so a lost task leaves no half file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def json_report(df: DataFrame) -> dict:
    """The one row of a report as plain values; NaN and infinities become null."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    return json.loads(json.dumps(rows[0].asDict(recursive=True), default=str), parse_constant=lambda _: None)


def _json(properties: str = "properties"):
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def write_bulk_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and relationship files for bulk import: id:ID, :LABEL, properties_json / :START_ID, :TYPE, :END_ID, relationship_id, properties_json."""
    write_csv(nodes.select(F.col("id").alias("id:ID"), F.concat_ws(";", F.array_sort("labels")).alias(":LABEL"), _json().alias("properties_json")), f"{path}/nodes")
    write_csv(edges.select(F.col("src").alias(":START_ID"), F.col("type").alias(":TYPE"), F.col("dst").alias(":END_ID"), F.col("rel_id").alias("relationship_id"), _json().alias("properties_json")), f"{path}/relationships")


def write_graph_lines(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "labels", "properties")).alias("value"))
    e = edges.select(F.to_json(F.struct(F.lit("relationship").alias("kind"), F.col("rel_id").alias("id"), F.col("src").alias("source"), "type", F.col("dst").alias("target"), "properties")).alias("value"))
    n.write.text(f"{path}/nodes")
    e.write.text(f"{path}/relationships")


def json_ld_lines(nodes: DataFrame, context: str) -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.lit(context).alias("@context"), F.col("id").alias("@id"), F.col("labels").alias("@type"), "properties")).alias("value"))


def xml_safe(c):
    """Text for XML: no control characters that XML forbids, the five special ones escaped."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def graphml_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node and edge elements of a GraphML document, one a row; its head and foot are two fixed lines."""
    data = lambda: F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(F.lit('<data key="'), xml_safe(e.key), F.lit('">'), xml_safe(e.value), F.lit("</data>"))), "")
    n = nodes.select(F.concat(F.lit('<node id="'), xml_safe(F.col("id")), F.lit('">'), data(), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), xml_safe(F.col("src")), F.lit('" target="'), xml_safe(F.col("dst")), F.lit('">'), data(), F.lit("</edge>")).alias("value"))
    return n.union(e)


def content_manifest(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of every file that is missing, unexpected or changed."""
    j = found.select("path", F.col("sha256").alias("a")).join(manifest.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", status.alias("status")).where("status is not null")
