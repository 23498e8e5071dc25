"""Token ids in Parquet list columns, laid out for selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import new_path, parts, table
from granary.llm.tokens import WORD_LEVEL, encoder

END_ID = 1
#: Texts that a task encodes at once: the more, the fewer words are looked up again.
TEXT_BYTES, TEXT_ROWS = 4 << 20, 1250
#: Ids are dictionary-encoded (a vocabulary fits in one dictionary page), keys and counts delta-encoded; row groups and
#: pages are small enough for the column and offset indexes, which the writer adds, to skip what a read doesn't need.
LAYOUT = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": 32 << 20, "parquet.page.size": 256 << 10, "parquet.page.row.count.limit": 2000, "parquet.dictionary.page.size": 1 << 20,
    "parquet.enable.dictionary": True, "parquet.enable.dictionary#doc_id": False, "parquet.enable.dictionary#n_tokens": False,
}


def _sized(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes of text in column 1 and at most so many rows."""
    for part in parts(batches, rows):
        share = np.cumsum(pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False)) // size
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), part.num_rows]
        yield from (part.slice(lo, hi - lo) for lo, hi in pairwise(cuts))


def _encode(name: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(name).encode_all
        for part in _sized(batches, TEXT_BYTES, TEXT_ROWS):
            found, n = encode_all(part.column(1).to_pylist(), end)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), ids], ["doc_id", "n_tokens", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = WORD_LEVEL, end_id: int = END_ID) -> None:
    """doc_id, n_tokens and tokens of every whole text (null: empty), with end_id at the end, in files under path.

    Rows are dealt by ranges of doc_id, repeated ids by a hash of their text too, and sorted inside a range; files in
    the order of their partition numbers hold ascending ids, null ids first. The texts are shuffled once, before they are encoded.
    An empty table gives a table without rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    dealt.mapInArrow(_encode(vocabulary, end_id), "doc_id long, n_tokens int, tokens array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens int, tokens array<int>").parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        ids = np.asarray(lists.values).astype("<u4", copy=False)
        ends = np.asarray(lists.offsets)
        crc = [zlib.crc32(ids[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["_part", "_file", "_row", "doc_id", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    A running sum inside each file and a sum over the files before it: only keys, counts and checksums are shuffled,
    and one row for each file meets in one task.
    """
    file = F.col("_metadata.file_name")
    # names are padded to five digits only; files of one partition end in c000, c001, ...
    part = F.regexp_extract(file, r"part-(\d+)", 1).cast("long")
    rows = read_tokens(spark, path).select(part.alias("_part"), file.alias("_file"), F.col("_metadata.row_index").alias("_row"), "doc_id", "tokens")
    digests = rows.mapInArrow(_digest, "_part long, _file string, _row long, doc_id long, n_tokens long, ids_crc32 long")
    counts = read_tokens(spark, path).select(part.alias("_part"), file.alias("_file"), "n_tokens").groupBy("_part", "_file").agg(F.sum("n_tokens").alias("_n"))
    before = counts.select("_file", (F.sum("_n").over(Window.orderBy("_part", "_file")) - F.col("_n")).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_file").orderBy("_row")) - F.col("n_tokens")
    return digests.withColumn("_inside", inside).join(before, "_file").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def op3_parquet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
