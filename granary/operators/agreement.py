"""Agreement of two orders of the same things: Kendall's tau, top-k overlap, and the gate that combines them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.metrics import spearman
from granary.sources.shared import written

#: Different pairs of values that one task counts; and at most so many ranges of each of the two values.
GROUP_PAIRS, MOST_RANGES = 200_000, 1024


def inversions(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> int:
    """Summed products of weights of pairs in which the smaller first has the larger second; ties in either count nothing.

    A merge sort from the bottom: at each level the halves of all blocks are laid in the order of second at once.
    """
    order = np.lexsort((second, first))
    rank, w = np.unique(second[order], return_inverse=True)[1].astype(np.int64), weight[order].astype(np.int64)
    at, total, half = np.arange(len(rank)), 0, 1
    while half < len(rank):
        block = at // (2 * half)
        laid = np.lexsort((at, -rank, block))  # larger seconds first, of equal ones the left half's after none of their own
        left = (at[laid] // half) % 2 == 0
        b, r, own = block[laid], rank[laid], w[laid]
        before = np.cumsum(np.where(left, own, 0))
        new = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (r[1:] != r[:-1]))))
        starts = np.repeat(np.append(0, before)[new], np.diff(np.append(new, len(b))))  # left weights with a larger second, or of blocks before
        fresh = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        offset = np.repeat(np.append(0, before)[fresh], np.diff(np.append(fresh, len(b))))
        total += sum((own[~left].astype(object) * (starts - offset)[~left].astype(object)).tolist())
        half *= 2
    return total


def _counted(table: pa.Table) -> pa.Table:
    n = inversions(*(table.column(c).to_numpy() for c in ("first", "second", "n")))
    return pa.table({"d": pa.array([str(n)])})


def _cuts(df: DataFrame, c: str, ranges: int) -> list[float]:
    if ranges < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(c, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(10_000))).first()[0] or []))


def kendall_tau(df: DataFrame, a: str, b: str, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """One row (n, concordant, discordant, tied_a, tied_b, tied_both, tau): Kendall's tau-b over rows with both values; null if one value is all there is.

    Rows become counts of different pairs (a, b). Both values are cut into ranges at approximate quantiles, values that
    are many ranges of their own. A pair of rows either differs in both ranges, and is counted from the table of range
    counts (at most MOST_RANGES squared numbers, in the driver), or shares a's range, or shares only b's; the latter two
    are inversions within a range, counted by merging in one task each. No table of pairs of rows is made. NaN counts as
    no value.
    """
    value = lambda c: F.col(c).cast("double")
    rows = df.where(value(a).isNotNull() & value(b).isNotNull() & ~F.isnan(value(a)) & ~F.isnan(value(b)))
    cells = written(rows.groupBy(value(a).alias("a"), value(b).alias("b")).agg(F.count("*").alias("n")), "pairs")
    pairs = lambda c: (F.col(c).cast("decimal(38,0)") * (F.col(c) - 1) / 2).cast("decimal(38,0)")
    ties = lambda *by: cells.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0))).first()[0]
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tied_a, tied_b, tied_both = int(ties("a")), int(ties("b")), int(ties("a", "b"))
    ranges = min(MOST_RANGES, -(-n[1] // group_pairs))

    def placed(c: str, cuts: list[float]):
        # twice the number of smaller cuts, and one more on a cut: a value that is a cut is a range of its own
        below = lambda inside: F.size(F.filter(F.array(*map(F.lit, cuts)), inside)) if cuts else F.lit(0)
        return (below(lambda x: x < F.col(c)) + below(lambda x: x <= F.col(c))).cast("int")

    laid = written(cells.withColumns({"ra": placed("a", _cuts(cells, "a", ranges)), "rb": placed("b", _cuts(cells, "b", ranges))}), "ranges")
    table = laid.groupBy("ra", "rb").agg(F.sum("n").alias("n")).collect()  # at most (2 * MOST_RANGES)^2 numbers, whatever the input
    side = max([max(r["ra"], r["rb"]) for r in table], default=0) + 1
    grid = np.zeros((side, side), object)
    for r in table:
        grid[r["ra"], r["rb"]] += int(r["n"])
    beyond = np.cumsum(np.cumsum(grid, 0)[:, ::-1], 1)[:, ::-1]  # smaller or equal a-range, larger or equal b-range
    discordant = int((grid[1:, :-1] * beyond[:-1, 1:]).sum()) if side > 1 else 0
    inside = laid.where("ra % 2 = 0").select(F.concat_ws(":", F.lit("a"), "ra").alias("key"), F.col("a").alias("first"), F.col("b").alias("second"), "n")
    across = laid.where("rb % 2 = 0").select(F.concat_ws(":", F.lit("b"), "rb").alias("key"), F.col("ra").cast("double").alias("first"), F.col("b").alias("second"), "n")
    counted = inside.union(across).groupBy("key").applyInArrow(_counted, "d string").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]
    discordant += int(counted or 0)
    all_pairs = n[0] * (n[0] - 1) // 2
    concordant = all_pairs - tied_a - tied_b + tied_both - discordant
    scale = math.sqrt(all_pairs - tied_a) * math.sqrt(all_pairs - tied_b)
    row = (n[0], str(concordant), str(discordant), str(tied_a), str(tied_b), str(tied_both), (concordant - discordant) / scale if scale else None)
    out = df.sparkSession.createDataFrame([row], "n long, c string, d string, ta string, tb string, t string, tau double")
    names = {"c": "concordant", "d": "discordant", "ta": "tied_a", "tb": "tied_b", "t": "tied_both"}
    return out.select("n", *(F.col(k).cast("decimal(38,0)").alias(v) for k, v in names.items()), "tau")


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int = 20) -> DataFrame:
    """One row (k, overlap): how many of the k largest by a are among the k largest by b; ties by key, nulls never."""
    top = lambda c: df.where(F.col(c).isNotNull()).orderBy(F.desc(c), key).limit(k).select(key)
    return top(a).join(F.broadcast(top(b)), key).agg(F.lit(k).alias("k"), F.count("*").alias("overlap"))


def importance_agreement(
    values: DataFrame, group: str, approximate: str, exact: str, residual: str | None = None, least_spearman: float = 0.9, top: int = 20, least_overlap: int = 15, most_relative_error: float = 0.25, most_residual: float = 1e-8
) -> DataFrame:
    """The whole gate, one row: does an approximation of attributions agree with the exact ones?

    values: a row for each (row, group) with both. Mean absolute values by group are compared by Spearman's and
    Kendall's rank correlation and by their `top` largest; values by Pearson's correlation and mean absolute error
    relative to the mean absolute exact value. residual: by how much prediction and sum of exact values differ, per row.
    passed: all four limits hold (without a residual, three).
    """
    means = written(values.groupBy(F.col(group).alias("group")).agg(F.avg(F.abs(F.col(approximate))).alias("approximate"), F.avg(F.abs(F.col(exact))).alias("exact")), "importance")
    whole = values.agg(
        F.corr(approximate, exact).alias("pearson"), F.try_divide(F.avg(F.abs(F.col(approximate) - F.col(exact))), F.greatest(F.avg(F.abs(F.col(exact))), F.lit(float(np.finfo(float).eps)))).alias("relative_mae"),
        (F.max(F.abs(F.col(residual))) if residual else F.lit(None).cast("double")).alias("reconstruction_max"),
    )
    one = spearman(means, "exact", "approximate").select("spearman")
    for more in (kendall_tau(means, "exact", "approximate").select(F.col("tau").alias("kendall")), top_overlap(means, "group", "exact", "approximate", top).select("overlap"), whole):
        one = one.crossJoin(F.broadcast(more))  # one row each
    passed = (F.col("spearman") >= least_spearman) & (F.col("overlap") >= least_overlap) & (F.col("relative_mae") <= most_relative_error)
    return one.withColumn("passed", F.coalesce(passed & (F.col("reconstruction_max") <= most_residual) if residual else passed, F.lit(False)))
