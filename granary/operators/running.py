"""Running sums in one global order without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _cuts(df: DataFrame, order: str, ranges: int) -> list:
    """At most ranges - 1 values that cut a column into parts of about one size."""
    if isinstance(df.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        cuts = df.agg(F.percentile_approx(order, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(10_000))).first()[0] or []
    else:  # the first keys in the order of a hash, a fixed number
        seen = sorted(r[0] for r in df.select(order).orderBy(F.xxhash64(order)).limit(100 * ranges).collect() if r[0] is not None)
        cuts = [seen[k * len(seen) // ranges] for k in range(1, ranges)] if seen else []
    return sorted(set(cuts))


def _placed(order: str, cuts: list) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)


def running_before(df: DataFrame, order: str, columns: Sequence[str], ranges: int = 128) -> DataFrame:
    """df (one row for each value of `order`, none null) with `<column>_before`: the sum over all rows with smaller values.

    Values are cut into ranges at approximate quantiles, or at those of a hashed sample where they are no numbers or dates; sums run inside a range, and the sums of whole ranges, as many
    rows as there are ranges, are added by a broadcast join. The cuts decide only how evenly rows are dealt.
    """
    laid = df.withColumn("_range", _placed(order, _cuts(df, order, ranges)))
    totals = laid.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    w = Window.orderBy("_range")
    starts = totals.select(F.col("_range").alias("_r"), *((F.sum(f"_{c}").over(w) - F.col(f"_{c}")).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = laid.withColumns({f"{c}_before": F.sum(c).over(inside) - F.col(c) for c in columns})
    joined = summed.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return joined.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in columns}).select(*df.columns, *(f"{c}_before" for c in columns))


def place_within(df: DataFrame, group: str, order: str, ranges: int = 128) -> DataFrame:
    """df with `_place`, the place (from 1) of each row among its group's in the order of a column, equal ones in any order.

    Groups are cut into ranges of the column, as in running_before(), so that a group that holds most rows is many
    partitions; counts of a group's ranges, at most `ranges` rows each, say where each range begins.
    """
    cuts = _cuts(df, order, ranges)
    laid = df.withColumn("_range", _placed(order, cuts))
    w = Window.partitionBy(group).orderBy("_range")
    counts = laid.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), (F.sum("_n").over(w) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    ranked = laid.withColumn("_inside", inside)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_place", F.col("_inside") + F.col("_start")).drop("_g", "_r", "_start", "_inside", "_range")
