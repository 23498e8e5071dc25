"""Coverage, completeness, eligibility, and the counts that reports are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.normalize import MISSING, is_present
from granary.operators.running import running_before


def column_coverage(df: DataFrame, columns: Sequence[str], missing: Sequence[str] = MISSING) -> DataFrame:
    """(column, present, rows, fraction) for every column, in one pass: wide sums, then a fixed-size unpivot."""
    wide = df.agg(F.count("*").alias("_n"), *(F.count_if(is_present(c, missing)).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("present"), F.col("_n").alias("rows")) for c in columns)))
    return wide.select(pairs.alias("p")).select("p.*").withColumn("fraction", F.try_divide(F.col("present").cast("double"), F.col("rows")))


def group_coverage(groups: Mapping[str, Sequence[str]], every: bool = False, missing: Sequence[str] = MISSING) -> dict[str, Column]:
    """For each named group of columns: whether any (or every) one is present."""
    fold = (lambda a, b: a & b) if every else (lambda a, b: a | b)
    return {name: reduce(fold, (is_present(c, missing) for c in columns)) for name, columns in groups.items()}


def fill_ratio(columns: Sequence[str], missing: Sequence[str] = MISSING) -> Column:
    return sum((is_present(c, missing).cast("int") for c in columns), F.lit(0)).cast("double") / len(columns)


def completeness_filter(df: DataFrame, columns: Sequence[str], source: str, least_coverage: float = 0.005, least_fill: float = 0.15) -> DataFrame:
    """df with fill_ratio and counted_columns; rows under least_fill of the columns that their source covers go.

    Coverage by source is one combined aggregate; it comes back through a join on the source that is as small as there
    are sources, so Spark broadcasts it by its measured size and splits hot sources otherwise.
    """
    share = df.groupBy(source).agg(*((F.count_if(is_present(c)) / F.count("*") >= least_coverage).alias(f"_use_{c}") for c in columns))
    joined = df.join(share.withColumnRenamed(source, "_source"), df[source].eqNullSafe(F.col("_source")))
    counted = sum((F.col(f"_use_{c}").cast("int") for c in columns), F.lit(0))
    filled = sum(((F.col(f"_use_{c}") & is_present(c)).cast("int") for c in columns), F.lit(0))
    out = joined.withColumn("counted_columns", counted.cast("long")).withColumn("fill_ratio", F.try_divide(filled.cast("double"), counted))
    return out.where(F.col("fill_ratio") >= least_fill).select(*df.columns, "fill_ratio", "counted_columns")


def year_filter(df: DataFrame, year: Column, first: int, keep_unknown: bool = True) -> DataFrame:
    return df.where(F.coalesce(year >= first, F.lit(keep_unknown)))


def year_report(df: DataFrame, year: Column, first: int) -> DataFrame:
    y = df.select(year.alias("y"))
    return y.agg(F.count("*").alias("rows"), F.count("y").alias("known"), F.count_if(F.col("y").isNull()).alias("unknown"), F.count_if(F.col("y") >= first).alias("kept_known"), F.count_if(F.col("y") < first).alias("dropped"), F.min("y").cast("long").alias("first_year"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """(value, count, share), nulls counted too; the total is one row, summed from the same counts and joined to them."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("_total")).alias("share"))  # one row


def list_value_counts(df: DataFrame, items: Column) -> DataFrame:
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("count"))


def cohort_summary(df: DataFrame, cohorts: Column, value: str, group: str) -> DataFrame:
    """Mean, median, sample standard deviation, quartiles and groups by cohort; a row may be in several cohorts (an array)."""
    rows = df.select(F.explode(cohorts).alias("cohort"), F.col(value).alias("v"), F.col(group).alias("g"))
    return rows.groupBy("cohort").agg(F.count("*").alias("rows"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_samp("v").alias("std"), F.percentile("v", 0.25).alias("q25"), F.percentile("v", 0.75).alias("q75"), F.count_distinct("g").alias("groups"))


def first_examples(df: DataFrame, key: str, value: str, order: str, n: int = 5) -> DataFrame:
    """(key, examples): the first n distinct values in the given order, joined; ranked before they are collected, so a list holds n values at most."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    ranked = firsts.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_at", value))).where(F.col("_rank") <= n)
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", value))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda s: s[value].cast("string")), "; ").alias("examples"))


def top_per_family(df: DataFrame, family: str, state: str, group: str, least: int = 5, n: int = 3) -> DataFrame:
    """The n most frequent states of each family with at least `least` rows; ties by groups, then state."""
    counts = df.groupBy(family, state).agg(F.count("*").alias("count"), F.count_distinct(group).alias("groups")).where(F.col("count") >= least)
    rank = F.row_number().over(Window.partitionBy(family).orderBy(F.desc("count"), F.desc("groups"), state))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def quantile_gap(df: DataFrame, family: str | None, importance: str, coverage: str, q: float = 0.75, least_coverage: float = 50.0) -> DataFrame:
    """df with gap: importance at or above the family's quantile (above the whole table's without a family) though coverage is low."""
    if family:
        cut = df.groupBy(F.col(family).alias("_f")).agg(F.percentile(importance, q).alias("_cut"))
        return df.join(cut, df[family].eqNullSafe(F.col("_f"))).withColumn("gap", (F.col(importance) >= F.col("_cut")) & (F.col(coverage) < least_coverage)).drop("_f", "_cut")
    cut = df.agg(F.percentile(importance, q).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("gap", (F.col(importance) > F.col("_cut")) & (F.col(coverage) < least_coverage)).drop("_cut")  # one row


def pivot_first(df: DataFrame, index: str, mode: str, modes: Sequence[str], value: str, order: Sequence[str], baseline: str) -> DataFrame:
    """index × mode with the first value in order, and each mode's difference from the baseline."""
    wide = df.groupBy(index).agg(*(F.min_by(F.col(value), F.when(F.col(mode) == m, F.struct(*order))).alias(m) for m in modes))
    return wide.withColumns({f"{m}_minus_{baseline}": F.col(m) - F.col(baseline) for m in modes if m != baseline})


def metric_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Mapping[str, bool]) -> DataFrame:
    """Long table (keys, metric, before, after, improvement); metrics: name to whether larger is better."""
    long = lambda df, name: df.select(*keys, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", name))
    both = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full_outer")
    better = F.create_map(*(x for m, up in metrics.items() for x in (F.lit(m), F.lit(1.0 if up else -1.0))))
    return both.withColumn("improvement", (F.col("after") - F.col("before")) * F.element_at(better, F.col("metric")))


def eligibility(flags: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()]


def issues(checks: Mapping[str, Column]) -> Column:
    """The names of the checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))


def evenly_spaced(df: DataFrame, key: str, k: int) -> DataFrame:
    """Of the distinct keys in order, those at the k positions spread evenly from first to last (half to even)."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    n = keys.count()
    at = sorted({round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)}) if n else []
    ranked = running_before(keys.withColumn("position", F.lit(1).cast("long")), key, ["position"]).select(key, F.col("position_before").alias("position"))
    return ranked.where(F.col("position").isin(at)) if at else ranked.where(F.lit(False))
