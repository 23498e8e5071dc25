"""CSV files of mixed encodings, headers and line rules as one table; every file is judged by all of its bytes.

Spark's text reader gives the bytes of each line as they are, in splits of any size, so one pass over all files tells
which encodings fit, which header each file has and whether quoted fields go over several lines. Files that agree in all
of that are read together: the plan grows with the number of different headers, not of files.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granary.sources.readers import plain_names
from granary.sources.shared import qualified, written

#: The encodings that are tried in turn for files without a byte order mark.
LADDER = ("UTF-8", "ISO-8859-1")
#: More different (encoding, header, line rule) than this are refused: each is a branch of the plan.
MOST_KINDS = 500
#: Bytes that windows-1252 doesn't define.
UNDEFINED_1252 = "[\x81\x8d\x8f\x90\x9d]"
#: What windows-1252 has where ISO-8859-1, as which it is read, has control characters.
FROM_1252 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if not re.match(UNDEFINED_1252, chr(b))}


def _fails(line: Column, encoding: str) -> Column:
    if encoding == "UTF-8":
        return ~F.is_valid_utf8(line)
    latin = F.decode(line.cast("binary"), "ISO-8859-1")
    if encoding == "windows-1252":
        return latin.rlike(UNDEFINED_1252)
    if encoding == "US-ASCII":
        return latin.rlike("[^\x00-\x7f]")
    if encoding == "ISO-8859-1":
        return F.lit(False)
    raise ValueError(f"no rule says whether a line is {encoding}")


def survey_files(spark: SparkSession, paths: str | Sequence[str], ladder: Sequence[str] = LADDER, glob: str | None = None, in_order: bool = False) -> DataFrame:
    """(path, seq, encoding, header, multi_line, lines) of every file; seq: from the oldest file to the newest, then by path, or (in_order) the place in paths.

    encoding: UTF-16 by a byte order mark, else the first of the ladder that all lines fit, null if none. header: the
    bytes of the first line. multi_line: some line has an odd number of quotes, so a quoted field may go on in the next.
    Empty files have no line and are left out. Lines are read in splits; only a few figures of each file are shuffled.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("time"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"), F.col("value").alias("line"),
    )
    quotes = F.length(F.decode(F.col("line").cast("binary"), "ISO-8859-1")) - F.length(F.replace(F.decode(F.col("line").cast("binary"), "ISO-8859-1"), F.lit('"'), F.lit("")))
    files = raw.groupBy("path", "time").agg(
        F.min_by(F.col("line").cast("binary"), "at").alias("header"), F.count("*").alias("lines"), F.max(quotes % 2 == 1).alias("multi_line"),
        *(F.max(_fails(F.col("line"), e)).alias(f"_fails{k}") for k, e in enumerate(ladder)),
    )
    start = F.hex(F.substring("header", 1, 2))
    fits = reduce(lambda found, k: found.when(~F.col(f"_fails{k}"), ladder[k]), range(len(ladder)), F.when(start.isin("FFFE", "FEFF"), "UTF-16"))
    if in_order:  # as long as the list that the driver has
        place = spark.createDataFrame([(_plain_uri(qualified(spark, p)), k) for k, p in enumerate(paths)], "_path string, _place int")
        files, seq = files.join(F.broadcast(place), F.regexp_replace("path", "^(\\w+):/+", "$1:/") == F.col("_path")), F.col("_place")
    else:
        seq = F.row_number().over(Window.orderBy("time", "path")) - 1  # a row for each file
    return files.select("path", seq.alias("seq"), fits.alias("encoding"), "header", (F.col("multi_line") | start.isin("FFFE", "FEFF")).alias("multi_line"), "lines")


def _plain_uri(uri: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def read_csv_files(spark: SparkSession, paths: str | Sequence[str], ladder: Sequence[str] = LADDER, glob: str | None = None, in_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of all CSV files under paths, each read in its own encoding.

    rows: all columns as text under the names of all headers, in the order in which the files first have them (a byte
    order mark before a name goes, of equal names the first stays), then _file_seq and _source_file; a column that a
    file lacks is null there. Lines with fewer fields than their header have nulls at the end. skipped: _source_file and
    line of those with more fields, which are no rows. Files with quoted line ends, or of UTF-16, are one task each;
    all others are split. Files of which no encoding fits raise an error that names some. No files: no rows, no columns
    but the two.
    """
    files = written(survey_files(spark, paths, ladder, glob, in_order), "files")
    if bad := [r.path for r in files.where("encoding is null").limit(5).collect()]:
        raise ValueError(f"none of {', '.join(ladder)} fits {', '.join(bad)}")
    odd = F.when(F.length(F.decode("header", "ISO-8859-1")) - F.length(F.replace(F.decode("header", "ISO-8859-1"), F.lit('"'), F.lit(""))) != 0, F.col("path"))
    kinds = files.groupBy("encoding", "header", "multi_line", F.when(F.col("multi_line"), odd).alias("alone")).agg(F.min("seq").alias("first"), F.collect_list("path").alias("paths")).orderBy("first").limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} different headers and encodings")
    names: list[str] = []
    parts, skipped = [], []
    for kind in kinds:
        windows = kind.encoding == "windows-1252"
        reader = spark.read.option("encoding", "ISO-8859-1" if windows else kind.encoding).option("multiLine", kind.multi_line).option("quote", '"').option("escape", '"').option("header", True)
        decoded = (lambda c: F.translate(c, "".join(FROM_1252), "".join(FROM_1252.values()))) if windows else (lambda c: c)
        own = [n.translate(str.maketrans(FROM_1252)) if windows else n for n in plain_names(reader.csv(kind.paths[0]).columns)]
        schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(own))] + [T.StructField("_bad", T.StringType())])
        found = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(kind.paths).withColumn("_path", F.col("_metadata.file_path"))
        fields = 1 + F.regexp_count(F.regexp_replace(F.coalesce("_bad", F.lit("")), r'"(?:[^"]|"")*"?', ""), F.lit(","))
        parsed = F.coalesce(F.length("_c0"), F.lit(0)) >= 0  # true of all lines; Spark doesn't give broken lines alone, without a column of theirs
        over = F.col("_bad").isNotNull() & (fields > len(own)) & parsed
        kept = defaultdict(lambda: None) | {n: f"_c{k}" for k, n in reversed(list(enumerate(own)))}
        names += [n for n in dict.fromkeys(own) if n not in names]
        parts.append((found.where(~over), kept, decoded))
        skipped.append(found.where(over).select("_path", decoded(F.col("_bad")).alias("line")))
    where = files.select(F.col("path").alias("_path"), F.col("seq").alias("_file_seq"), F.element_at(F.split("path", "/"), -1).alias("_source_file"))
    if not parts:
        return spark.createDataFrame([], "_file_seq int, _source_file string"), spark.createDataFrame([], "_source_file string, line string")
    rows = reduce(DataFrame.unionAll, (df.select("_path", *((decoded(F.col(kept[n])) if kept[n] else F.lit(None).cast("string")).alias(n) for n in names)) for df, kept, decoded in parts))
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    return (
        rows.join(where, "_path").select(*quoted, "_file_seq", "_source_file"),
        reduce(DataFrame.unionAll, skipped).join(where, "_path").select("_source_file", "line"),
    )


def newest_file(spark: SparkSession, folder: str, glob: str = "*") -> str | None:
    """The path of the file that was changed last (of equal times the last by name); contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    row = found.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"]


def count_rows(spark: SparkSession, path: str, ladder: Sequence[str] = LADDER) -> int:
    """Rows of CSV files without their headers and the lines that are skipped."""
    return read_csv_files(spark, path, ladder)[0].count()


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows; Spark stops reading when it has them."""
    return df.limit(rows)


def tail_lines(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    """The last lines of the text files under path, in their order; Spark runs from the last partition back until it has them."""
    return [r["value"] for r in spark.read.text(path).tail(lines)]
