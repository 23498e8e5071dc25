"""Splits by group."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups are dealt to folds by so many buckets of a hash, those of more than APART of the rows one by one.
BUCKETS, APART = 1 << 14, 1e-4


def group_key(group: str, row: str, policy: str = "pool") -> Column:
    """Null groups pooled as NO_GROUP, or (policy 'row') made unique for each row."""
    alone = F.lit("NO_GROUP") if policy == "pool" else F.concat(F.lit("missing_group_row_"), F.col(row).cast("string"))
    return F.coalesce(F.col(group).cast("string"), alone)


def hash_group_fold(group: Column, folds: int, seed: int = 42) -> Column:
    """A fold for each group by a hash; no pass over the data and no table of groups, for any number of them."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group)), 1, 8), 16, 10).cast("long"), F.lit(folds))


def balanced_group_folds(df: DataFrame, group: str, folds: int, buckets: int = BUCKETS, share: float = APART) -> DataFrame:
    """df with fold: groups go to the lightest fold so far, from the largest to the smallest.

    Groups of more than that share of the rows, of which there can't be more than 1 / share, go one by one; all others go
    by buckets of a hash of the group. The rule is the same for every number of groups, and the driver never holds more
    than `buckets` + 1 / share rows.
    """
    bucket = F.pmod(F.xxhash64(F.col(group)), F.lit(buckets))
    sizes = df.groupBy(F.col(group).alias("_g"), bucket.alias("_bucket")).agg(F.count("*").alias("n"))
    apart = F.col("n") > df.count() * share
    parts = sizes.groupBy(F.when(~apart, F.col("_bucket")).alias("_bucket"), F.when(apart, F.col("_g")).alias("_g")).agg(F.sum("n").alias("n"))
    heap = [(0, k) for k in range(folds)]
    dealt: tuple[list, list] = [], []  # buckets, groups apart
    for r in parts.orderBy(F.desc("n"), "_bucket", "_g").collect():
        load, k = heapq.heappop(heap)
        dealt[r["_bucket"] is None].append((r["_g"] if r["_bucket"] is None else r["_bucket"], k))
        heapq.heappush(heap, (load + r["n"], k))
    make = df.sparkSession.createDataFrame
    by_bucket = make(dealt[0], "_bucket long, _fold long")
    by_group = make(dealt[1], T.StructType([T.StructField("_g", df.schema[group].dataType), T.StructField("_own", T.LongType())]))
    placed = df.withColumn("_bucket", bucket).join(F.broadcast(by_bucket), "_bucket", "left").join(F.broadcast(by_group), F.col(group).eqNullSafe(F.col("_g")), "left")
    return placed.withColumn("fold", F.coalesce("_own", "_fold")).drop("_bucket", "_fold", "_g", "_own")


def group_holdout(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: about that share of groups, by a hash of seed and group."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return df.withColumn("is_test", u < share)


def exclude_keys(df: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't frozen; rows without a key stay."""
    return df.join(frozen.select(key).distinct(), key, "left_anti")


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """per_stratum rows of each stratum in the order of a hash; a sampling operator."""
    from pyspark.sql.window import Window

    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= per_stratum)
