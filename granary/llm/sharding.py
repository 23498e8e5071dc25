"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import materialize, table

#: The ring is cut into this many equal arcs; every count that reaches the driver is one of an arc.
RING_ARCS, ARC_ROWS = 8192, 50_000
VIRTUAL_NODES = 64


def ring_order(shards: int, arcs: int = RING_ARCS, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For every arc, the shards in the order in which a clockwise walk from it meets their virtual nodes."""
    walk = sorted((int.from_bytes(hashlib.md5(f"{shard}/{v}".encode()).digest()[:8], "big") % arcs, shard) for shard in range(shards) for v in range(virtual_nodes))
    met: list[list[int]] = []  # by the virtual node that the walk begins with
    for first in range(len(walk)):
        met.append(list(dict.fromkeys(walk[(first + k) % len(walk)][1] for k in range(len(walk)))))
    places = [at for at, _ in walk]
    return [met[bisect.bisect_left(places, arc) % len(walk)] for arc in range(arcs)]


def bounded_plan(counts: Mapping[int, int], shards: int, arcs: int = RING_ARCS, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int, int]]:
    """Fill the shards arc by arc; keys that find their shard full go on clockwise to the next one with room.

    Shard capacities differ by one at most and add up to the number of keys, so every shard ends exactly full.
    Returns (arc, shard, lo, hi, base, ring): the keys ranked lo..hi-1 of the arc take the slots from base on in the
    shard; ring is the shard that the ring alone, without bounds, would give them.
    """
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    plan = []
    orders = ring_order(shards, arcs, virtual_nodes)
    for arc in sorted(counts):
        lo, left = 0, counts[arc]
        for shard in orders[arc]:
            if take := min(left, free[shard]):
                plan.append((arc, shard, lo, lo + take, filled[shard], orders[arc][0]))
                free[shard] -= take
                filled[shard] += take
                lo += take
                left -= take
    return plan


PLAN = "_arc int, shard int, _lo long, _hi long, _base long, ring_shard int"


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", arcs: int | None = None, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, ring_shard, more_shard, more_ring_shard) for every row; row counts of shards at most one apart.

    A row lies on the ring where the hash of its key puts it, rows without a key anywhere; inside an arc rows rank by
    hash, key, checksum and size, so ties between equal rows change nothing that is returned. Only the counts of the
    arcs reach the driver, RING_ARCS or as many as keep an arc at about ARC_ROWS rows; the plan that comes back has a
    row per arc and one more per shard at most and is broadcast. ring_shard is where the ring alone would put a row;
    more_shard and more_ring_shard are shard and ring_shard with one more shard. By law `rows` grown_shard is null.
    Null texts count as empty; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    anywhere = F.xxhash64(F.rand(7), F.rand(8))  # drawn once: the rows are written
    point = F.when(F.col(key).isNull(), anywhere).otherwise(F.xxhash64(F.col(key).cast("string")))
    rows = materialize(docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), point.alias("_point")), "ring")
    arcs = arcs or max(RING_ARCS, 1 << (max(1, rows.count() // ARC_ROWS) - 1).bit_length())
    rows = rows.withColumn("_arc", F.pmod("_point", F.lit(arcs)).cast("int"))
    counts = {r["_arc"]: r["count"] for r in rows.groupBy("_arc").count().collect()}  # at most `arcs` rows
    planned = lambda n: F.broadcast(spark.createDataFrame(bounded_plan(counts, n, arcs, virtual_nodes), PLAN))
    rank = F.row_number().over(Window.partitionBy("_arc").orderBy("_point", key, "text_crc32", "size")) - 1
    placed = rows.withColumn("_rank", rank).join(planned(shards), "_arc").where("_rank >= _lo and _rank < _hi")
    placed = placed.withColumn("slot", (F.col("_base") + F.col("_rank") - F.col("_lo")).cast("long")).drop("_lo", "_hi", "_base")
    more = planned(shards + 1).withColumnsRenamed({"shard": "more_shard", "ring_shard": "more_ring_shard"})
    placed = placed.join(more, "_arc").where("_rank >= _lo and _rank < _hi")
    return placed.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "ring_shard", "more_shard", "more_ring_shard")


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)
