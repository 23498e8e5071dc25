"""Readers of record files: everything as text, headers united in first-seen order, file order kept as `_seq`."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that are results of earlier runs, not records.
BLOCKED = re.compile(r"^(all_records|paper_summaries|accepted|rejected|duplicate|integration|audit)", re.I)


def plain_names(columns: Sequence[str]) -> list[str]:
    """A header's names as they stand in the file: without a byte order mark, and without the number that Spark adds to doubled ones."""
    plain = []
    for k, name in enumerate(columns):
        bare = re.sub(rf"(?<=.){k}$", "", name)
        plain.append((bare if bare != name and any(bare == re.sub(rf"(?<=.){j}$", "", other) for j, other in enumerate(columns) if j != k) else name).removeprefix("\ufeff"))
    return plain


def read_csv(spark: SparkSession, path: str | Sequence[str], ladder: Sequence[str] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """All columns of a CSV file or folder as text, each file in its own encoding; see read_csv_files()."""
    from granary.sources.encodings import read_csv_files

    return read_csv_files(spark, path, ladder)[0].drop("_file_seq", "_source_file")


def record_files(spark: SparkSession, folder: str, glob: str = "*.csv", blocked: re.Pattern = BLOCKED) -> list[str]:
    """Paths of the folder's record files from the oldest to the newest; their names are listed, not their contents."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime").collect()
    return [r["path"] for r in sorted(rows, key=lambda r: (r["modificationTime"], r["path"])) if not blocked.match(r["path"].rsplit("/", 1)[-1])]


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several CSV files with differing headers as one table, with `_file_seq` (place in `paths`) and `_source_file`."""
    from granary.sources.encodings import read_csv_files

    if not paths:
        return spark.createDataFrame([], "_file_seq int, _source_file string")
    return read_csv_files(spark, list(paths), in_order=True)[0]


def prefer_json(spark: SparkSession, csv: DataFrame, json: DataFrame, stem: str = "_stem") -> DataFrame:
    """Rows of the JSON files, and those of the CSV files of which there is no JSON file of that stem."""
    return json.unionByName(csv.join(json.select(stem).distinct(), stem, "left_anti"), allowMissingColumns=True)


def read_events(spark: SparkSession, path: str, schema: str, event: str | None = None) -> DataFrame:
    """A JSON-lines log; blank and broken lines go."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    names = [c for c in df.columns if c != "_corrupt_record"]
    df = df.where(F.col("_corrupt_record").isNull() & F.coalesce(*(F.col(c).cast("string") for c in names)).isNotNull()).select(*names)
    return df.where(F.col("event") == event) if event else df


def read_text_artifacts(spark: SparkSession, folder: str, order: Sequence[str] = ("performance", "reference_device", "summary", "stability"), most: int = 20, chars: int = 1_000_000) -> DataFrame:
    """(slug, text): of each slug (the name before two underscores) up to `most` files, joined by the order of words in their names, then name."""
    from pyspark.sql.window import Window

    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_name").alias("name"), F.substring("value", 1, chars).alias("value"))
    rank = None
    for k, word in enumerate(order):
        hit = F.lower("name").contains(word)
        rank = F.when(hit, k) if rank is None else rank.when(hit, k)
    named = files.withColumn("slug", F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "__.*$", "")).withColumn("_rank", rank.otherwise(len(order)))
    w = Window.partitionBy("slug").orderBy("_rank", "name")
    kept = named.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    listed = kept.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("l"))
    return listed.select("slug", F.array_join(F.transform("l", lambda s: s["value"]), "\n").alias("text"))


def read_settings(spark: SparkSession, path: str) -> dict:
    """A JSON object of settings, an ontology or a summary, small enough for the driver; {} if there is none or it can't be read."""
    import json

    try:
        rows = spark.read.option("wholetext", True).text(path).limit(2).collect()
        found = json.loads(rows[0]["value"].removeprefix("\ufeff")) if len(rows) == 1 else {}
    except Exception as e:
        if isinstance(e, ValueError) or "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return found if isinstance(found, dict) else {}
