"""Single documents made of many rows: GraphML, JSON-LD, and CSV whose header unites the keys of all records.

Spark's text writer makes the parts, in parallel and under its commit protocol; then the parts are joined in their
order, between a head and a foot, by copying bytes from stream to stream in the store. A document is one file, so one
stream writes it; nothing of it is held in memory, and no row passes through Spark's driver or a single task.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.shared import delete, file_system, shared_folder
from granary.sources.writers import xml_safe

#: More different keys than this are refused as a header.
MOST_KEYS = 10_000


def write_document(lines: DataFrame, path: str, head: str = "", foot: str = "", separator: str = "\n") -> None:
    """One file at path: head, the rows of `lines` (one text column, nulls left out) with the separator between them, foot.

    Rows come in the order of the frame's partitions. The file is written beside its place and renamed at the end, so
    readers see a whole document or the one that was there before. No rows: head and foot alone.
    """
    spark = lines.sparkSession
    parts, beside = shared_folder(spark, "document"), f"{path}.part"
    lines.where(F.col(lines.columns[0]).isNotNull()).write.option("lineSep", separator).text(parts)
    fs, folder = file_system(spark, parts)
    to, target = file_system(spark, beside)
    io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    found = sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: int(s.getPath().getName().split("-")[1]))
    out = to.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for k, status in enumerate(found):
            last = len(separator.encode()) if k == len(found) - 1 else 0
            part = fs.open(status.getPath())
            try:
                io.copyLarge(part, out, 0, status.getLen() - last)
            finally:
                part.close()
        out.write(bytearray(foot.encode()))
    finally:
        out.close()
    delete(spark, parts)
    final = file_system(spark, path)[1]
    to.delete(final, False)
    if not to.rename(target, final):
        raise OSError(f"could not move the document to {path}")


def _json(properties: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, name: str = "graph") -> None:
    """A GraphML document of nodes (id, labels, properties map) and edges (rel_id, src, type, dst, properties map).

    Characters that XML forbids go; labels are joined by semicolons and properties are JSON with sorted keys, each under
    a declared key. Null properties are an empty object. Every node and edge is one line: ends of lines inside values are
    character references, so that read_graphml() reads the document in splits.
    """
    safe = lambda c: F.replace(F.replace(xml_safe(c), F.lit("\n"), F.lit("&#10;")), F.lit("\r"), F.lit("&#13;"))
    data = lambda key, value: F.concat(F.lit(f'<data key="{key}">'), safe(value), F.lit("</data>"))
    properties = _json(F.coalesce("properties", F.create_map().cast("map<string,string>")))
    n = nodes.select(F.concat(F.lit('<node id="'), safe(F.col("id")), F.lit('">'), data("label", F.concat_ws(";", F.array_sort("labels"))), data("node_properties", properties), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(
        F.lit('<edge id="'), safe(F.col("rel_id")), F.lit('" source="'), safe(F.col("src")), F.lit('" target="'), safe(F.col("dst")), F.lit('">'),
        data("relationship_type", F.col("type")), data("relationship_properties", properties), F.lit("</edge>"),
    ).alias("value"))
    declared = "\n".join(f'<key id="{key}" for="{kind}" attr.name="{attr}" attr.type="string" />' for key, kind, attr in (
        ("label", "node", "label"), ("node_properties", "node", "properties_json"), ("relationship_type", "edge", "type"), ("relationship_properties", "edge", "properties_json"),
    ))
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{declared}\n<graph id="{name}" edgedefault="directed">\n'
    write_document(n.union(e), path, head, "\n</graph>\n</graphml>\n")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document of write_graphml(): the attributes id, and source and target, and data, an array of (_VALUE, _key).

    Elements are lines, so the one file is read in splits; each is parsed by the XML parser.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    data = "data array<struct<_VALUE:string, _key:string>>"
    read = lambda tag, more: lines.where(F.col("value").startswith(f"<{tag} ")).select(F.from_xml("value", f"_id string, {more} {data}", {"ignoreSurroundingSpaces": "false"}).alias("x")).select("x.*")
    return read("node", ""), read("edge", "_source string, _target string,")


def write_jsonld(nodes: DataFrame, edges: DataFrame, path: str, context: Mapping[str, object], prefix: str = "") -> None:
    """A JSON-LD document: one @context, and a @graph of all nodes and then all edges, each with its properties beside its @id and @type.

    A property that has the name of one of the document's own members (@id, @type, source, target) gives way.
    """
    own = lambda names: F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(names))
    item = lambda members, names: _json(F.map_concat(own(names), F.create_map(*(x for n, c in members.items() for x in (F.lit(n), F.coalesce(c, F.lit("")))))))
    at = lambda c: F.concat(F.lit(prefix), c)
    n = nodes.select(item({"@id": at(F.col("id")), "@type": at(F.concat_ws(";", F.array_sort("labels")))}, ["@id", "@type"]).alias("value"))
    e = edges.select(item({"@id": at(F.col("rel_id")), "@type": at(F.col("type")), "source": at(F.col("src")), "target": at(F.col("dst"))}, ["@id", "@type", "source", "target"]).alias("value"))
    write_document(n.union(e), path, '{"@context": ' + json.dumps(context, ensure_ascii=False) + ', "@graph": [\n', "\n]}\n", ",\n")


def united_columns(records: DataFrame, column: str, order: str, most: int = MOST_KEYS) -> DataFrame:
    """records with a text column for each key of their maps, in the order in which keys first occur by `order`, then by name.

    Keys are found in one pass that sends one row for each key and task; more than `most` keys are an error.
    """
    keys = records.select(F.col(order).alias("_at"), F.explode(F.map_keys(column)).alias("_key")).groupBy("_key").agg(F.min("_at").alias("_at")).orderBy("_at", "_key").limit(most + 1).collect()
    if len(keys) > most:
        raise ValueError(f"more than {most} different keys")
    rest = [c for c in records.columns if c not in (column, order)]
    return records.select(*(F.col(f"`{c}`") for c in rest), *(F.element_at(column, r["_key"]).alias(r["_key"]) for r in keys if r["_key"] not in rest))


def write_united_csv(records: DataFrame, column: str, order: str, path: str) -> None:
    """One CSV file of records with differing keys: its header unites them, missing values are empty; rows sorted by `order` within ranges."""
    laid = united_columns(records.repartitionByRange(order).sortWithinPartitions(order), column, order)
    names = laid.columns
    head = laid.sparkSession.range(1).select(F.to_csv(F.struct(*(F.lit(n).alias(f"c{k}") for k, n in enumerate(names))))).first()[0]
    rows = laid.select(F.to_csv(F.struct(*(F.col("`" + n.replace("`", "``") + "`").cast("string").alias(f"c{k}") for k, n in enumerate(names))), {"escape": '"', "quote": '"'}).alias("value"))
    write_document(rows, path, head + "\n", "\n")
