"""Packing documents into sequences of a fixed length by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm.common import carried, map_carrying, materialize, parts, set_aside, table
from granary.llm.tokens import BYTE_LEVEL, encoder

CAPACITY, END_ID = 1024, 2
#: Pieces that are packed together, in one task; its memory holds their keys and lengths.
GROUP_PIECES = 100_000


def sum_of_squares_bins(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest items first.

    Of the open bins with room, an item takes the one after which the sum over all gaps of the squared number of open
    bins with that gap is smallest (of equal choices the smallest gap); it opens a bin only if it fits in none, which
    needs fewer bins than to weigh a new one like the others.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    n = np.zeros(capacity, np.int64)  # open bins by gap
    full = int(np.count_nonzero(lengths == capacity))
    bins[order[:full]] = np.arange(full)
    used = full
    for i in order[full:]:
        size = int(lengths[i])
        gaps = size + np.flatnonzero(n[size:])
        if len(gaps):
            left = gaps - size
            gap = int(gaps[np.argmin(np.where(left > 0, 2 * n[left] + 1, 0) - 2 * n[gaps] + 1)])
            b = open_at[gap].pop()
            n[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_at[gap - size].append(b)
            n[gap - size] += 1
    return bins, offsets


def _cut(name: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name).encode
        for batch in parts(batches, 500):
            keys, rows, ids = [], [], []
            for at, text in enumerate(batch.column(0)):
                found = encode(text.as_py()) + end
                total = len(found) // 4
                lo = 0
                hi = total % capacity or capacity  # the first piece may be shorter
                for piece in range(-(-total // capacity)):
                    own = found[4 * lo : 4 * hi]
                    keys.append(at)
                    rows.append((piece, lo, hi - lo, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, np.int32))
                    lo, hi = hi, hi + capacity
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] or [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            carried = batch.take(pa.array(keys, pa.int64())) if keys else batch.slice(0, 0)
            yield pa.RecordBatch.from_arrays([*carried.columns[1:], *cols], [*batch.schema.names[1:], "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return run


def cut_documents(docs: DataFrame, carry: list[str] | None = None, vocabulary: str = BYTE_LEVEL, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of every whole text: the carried columns, piece (from 0), start, length, ids_crc32 and, if wanted, ids.

    Only documents of more than `capacity` ids, the end id counted, are cut, and only their first piece is shorter.
    Null and empty texts have the end id alone. Each row is cut alone: ties and repeated rows change nothing.
    Columns of docs with a name that pieces or packed pieces have give way to theirs.
    """
    carry = carried([c for c in docs.columns if c != "text"] if carry is None else carry, ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"))
    own = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_carrying(docs, F.coalesce(F.col("text"), F.lit("")), carry, _cut(vocabulary, capacity, end_id, with_ids), own)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (of cut_documents, written first) with sequence_id and offset, gapless from 0 in each sequence of at most `capacity` ids.

    Rows are dealt at random, whatever their keys, into groups of about group_pieces that are packed apart, so no
    document, source or group of copies meets in one task; the groups cost at most a few open sequences each. With
    token ids among the columns take smaller groups: a group is held in memory. An empty table gives an empty result.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    pieces, back = set_aside(pieces, "length", "ids_crc32", "start")

    def pack(key, rows):
        rows = rows.sort_values(["length", "ids_crc32", "start"], ascending=False, kind="stable")
        bins, offsets = sum_of_squares_bins(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 40) + bins, offset=offsets).drop(columns="_group")

    schema = StructType([*pieces.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    dealt = pieces.withColumn("_group", F.floor(F.rand(17) * groups).cast("int"))
    return dealt.groupBy("_group").applyInPandas(pack, schema).select(*back, "sequence_id", "offset")


def pack_documents(docs: DataFrame, carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    return pack_pieces(materialize(cut_documents(docs, carry, with_ids=with_ids), "pieces"), group_pieces=GROUP_PIECES // (8 if with_ids else 1))


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), ["doc_id"])
