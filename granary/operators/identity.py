"""Deduplication, upserts and the joins that must not lose or multiply rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order; rows whose key is null in every part all stay."""
    w = Window.partitionBy(*key).orderBy(*order)
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    nothing = F.coalesce(*(p.cast("string") for p in parts)).isNull()
    return df.withColumn("_rank", F.when(nothing, 1).otherwise(F.row_number().over(w))).where("_rank = 1").drop("_rank")


def duplicate_report(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """df with group_size, group_rank and selected (the best of its key)."""
    w = Window.partitionBy(*key)
    return df.withColumn("group_size", F.count("*").over(w)).withColumn("group_rank", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("selected", F.col("group_rank") == 1)


def upsert_keep_existing(registry: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The registry and the first incoming row of each key that it doesn't have yet; an anti join, so null keys are never 'seen'."""
    new = keep_first(incoming, [key], order).join(registry.select(key).distinct(), key, "left_anti")
    return registry.unionByName(new, allowMissingColumns=True)


def one_to_one_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if the key repeats on either side: the sides are counted in the same plan, not by an extra job."""
    def unique(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn("_ok", F.assert_true(n == 1, F.lit(f"{key} repeats"))).where("_ok is null").drop("_ok")

    return unique(a).join(unique(b), key)


def outer_indicator(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join with `_merge`: both, left_only or right_only."""
    left, right = a.withColumn("_l", F.lit(True)), b.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("_merge", side).drop("_l", "_r")


def lookup_by_keys(df: DataFrame, row_id: str, keys: Sequence[Sequence[str]], evidence: DataFrame, value: str, order: Sequence[Column | str]) -> DataFrame:
    """(row_id, value, key_rank): the first present value under the first key list that has one.

    All key lists go through one join: both sides are exploded to (rank, key text).
    """
    def keyed(frame: DataFrame) -> Column:
        own = [F.when(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) == 0, F.struct(F.lit(k).alias("key_rank"), F.concat_ws("\x1f", *(F.col(c).cast("string") for c in cols)).alias("_key"))) for k, cols in enumerate(keys)]
        return F.explode(F.array_compact(F.array(*own)))

    a = df.select(row_id, keyed(df).alias("_k")).select(row_id, "_k.*")
    b = evidence.withColumn("_k", keyed(evidence)).select("_k.*", value, *order).where(F.col(value).isNotNull())
    hit = a.join(b, ["key_rank", "_key"])
    return hit.groupBy(row_id).agg(F.min_by(F.struct(value, "key_rank"), F.struct("key_rank", *order)).alias("best")).select(row_id, "best.*")


def longest_prefix(names: DataFrame, name: str, columns: Sequence[str]) -> Column:
    """The longest of `columns` that equals the name or is followed by an underscore in it; columns are a schema's, so few."""
    ranked = sorted(columns, key=lambda c: (-len(c), c))
    return F.coalesce(*(F.when((F.col(name) == c) | F.col(name).startswith(f"{c}_"), F.lit(c)) for c in ranked))


def split_conflicts(df: DataFrame, key: str, target: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows of one id with different target values get ids of their own, named after the value (21.61: _21p61)."""
    n = F.size(F.collect_set(target).over(Window.partitionBy(key)))
    suffix = F.regexp_replace(F.format_string("%.2f", F.col(target).cast("double")), r"\.", "p")
    return df.withColumn(key, F.when((n > 1) & F.col(target).isNotNull(), F.concat(F.col(key), F.lit("_"), suffix)).otherwise(F.col(key)))


def coalesce_partial(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each id, every column its first present value."""
    rest = [c for c in df.columns if c != key]
    rank = F.struct(*order)
    return df.groupBy(key).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest))


def evidence_gate(records: DataFrame, evidence: DataFrame, row: str, targets: Sequence[str]) -> DataFrame:
    """Targets without a row of evidence (row, field) become null; `_dropped` lists them."""
    has = evidence.where(F.trim(F.coalesce("evidence", F.lit(""))) != "").groupBy(row).agg(F.collect_set("field").alias("_fields"))
    joined = records.join(has, row, "left").withColumn("_fields", F.coalesce("_fields", F.array().cast("array<string>")))
    dropped = F.array_compact(F.array(*(F.when(F.col(t).isNotNull() & ~F.array_contains("_fields", t), F.lit(t)) for t in targets)))
    out = joined.withColumn("_dropped", dropped)
    return out.withColumns({t: F.when(F.array_contains("_fields", t), F.col(t)) for t in targets}).drop("_fields")


def identity_issues(df: DataFrame, key: str, value: str, scientific: Sequence[str], tolerance: float = 0.02) -> DataFrame:
    """(key, issue): ids whose `_pce_14p82` part differs from the value, and ids that share all scientific columns with another id."""
    stated = F.regexp_replace(F.regexp_extract(key, r"_pce_(\d+p\d+)", 1), "p", ".").try_cast("double")
    mismatch = df.where(F.abs(stated - F.col(value)) > tolerance).select(key, F.lit("sample_id_pce_mismatch").alias("issue"))
    n = F.count("*").over(Window.partitionBy(*scientific))
    twice = df.withColumn("_n", n).where("_n > 1").select(key, F.lit("duplicate_final_device_identity").alias("issue"))
    return mismatch.union(twice)


def copy_context(df: DataFrame, group: str, targets: Sequence[str], context: Sequence[str], order: str) -> DataFrame:
    """Rows with a target, their missing context filled from the group's rows without one, first seen first; rows that only gave context go.

    Rows without a target stay where no row of their group has one, and rows without a group stay as they are. Targets
    are never merged, so conflicting ones remain rows of their own.
    """
    has = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(True)) for c in targets), F.lit(False))
    known = F.col(group).isNotNull()
    given = df.where(known & ~has).groupBy(group).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_c_{c}") for c in context))
    filled = df.where(known & has).join(given, group, "left").withColumns({c: F.coalesce(c, f"_c_{c}") for c in context}).select(*df.columns)
    with_target = df.where(known & has).select(group).distinct()
    alone = df.where(known & ~has).join(with_target, group, "left_anti").select(*df.columns)
    return filled.unionByName(alone).unionByName(df.where(~known))
