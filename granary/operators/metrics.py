"""Evaluation of predictions, distribution shift, and cluster-bootstrap intervals from sufficient statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.md5 import md5_words
from granary.operators.running import running_before


def regression_sums(actual: Column, predicted: Column) -> list[Column]:
    e = predicted - actual
    return [F.count(e).alias("n"), F.sum(actual).alias("sy"), F.sum(actual * actual).alias("syy"), F.sum(e * e).alias("se2"), F.sum(F.abs(e)).alias("sae")]


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, r2, rmse, mae; R² of a constant target is 1 without error and 0 with."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    s = rows.groupBy(*by).agg(*regression_sums(F.col(actual).cast("double"), F.col(predicted).cast("double")))
    return s.select(*by, "n", *scores())


def scores(suffix: str = "") -> list[Column]:
    n, sy, syy, se2, sae = (F.col(x) for x in ("n", "sy", "syy", "se2", "sae"))
    sst = syy - F.try_divide(sy * sy, n)
    flat = sst <= 1e-12 * syy
    r2 = F.when(flat & (se2 == 0), 1.0).when(flat, 0.0).otherwise(1 - F.try_divide(se2, sst))
    return [r2.alias(f"r2{suffix}"), F.sqrt(F.try_divide(se2, n)).alias(f"rmse{suffix}"), F.try_divide(sae, n).alias(f"mae{suffix}")]


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df with the average rank of tied values. Counts of distinct values are summed, so ties, however many, are one row there."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = running_before(counts, "_v", ["_n"]).select("_v", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[value] == F.col("_v"), "left").drop("_v")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc by rank sums over distinct scores, ties counted half; null if there is only one class."""
    by = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    s = running_before(by, score, ["q"]).select("p", "q", (F.col("p") * (F.col("q_before") + F.col("q") / 2)).alias("u")).agg(F.sum("u").alias("u"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return s.select("positives", "negatives", F.try_divide(F.col("u"), F.col("positives") * F.col("negatives")).alias("auc"))


def classification_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return s.select(*by, "n", "tp", "fp", "fn", "tn", ratio(tp + tn, n).alias("accuracy"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) over rows with both labels; 1 if chance alone agrees always."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    pa, pb = cells.groupBy("a").agg(F.sum("c").alias("x")), cells.groupBy("b").agg(F.sum("c").alias("y"))
    chance = pa.join(pb, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    out = total.crossJoin(F.broadcast(chance))  # one row each
    observed, expected = F.try_divide(F.col("same").cast("double"), F.col("n")), F.try_divide(F.col("xy"), F.col("n").cast("double") * F.col("n"))
    return out.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected == 1, 1.0).otherwise(F.try_divide(observed - expected, 1 - expected)).alias("kappa"))


def macro_f1(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over all classes that either side has (by group); a wrong prediction is a miss of one class and a false hit of another."""
    each = df.select(*by, F.explode(F.array_distinct(F.array(gold, predicted))).alias("class"), F.col(gold).alias("g"), F.col(predicted).alias("p")).where(F.col("class").isNotNull())
    c = F.col("class")
    s = each.groupBy(*by, "class").agg(F.count_if((F.col("g") == c) & (F.col("p") == c)).alias("tp"), F.count_if((F.col("p") == c) & ~F.col("g").eqNullSafe(c)).alias("fp"), F.count_if((F.col("g") == c) & ~F.col("p").eqNullSafe(c)).alias("fn"))
    return s.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("classes"))


def estimate_seed(*parts: str, base: int = 42) -> int:
    """A seed of its own for each estimate, from its name."""
    return base + int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:8], 16) % 1_000_000


def unit_number(text: Column) -> Column:
    """A number in [0, 1) from a hash of a text, the same in every task."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Draws that share one hash: each takes eight of its 32 hexadecimal digits.
SHARED = 4


def _poisson_steps() -> list[float]:
    """The distribution function of Poisson(1) at 0, 1, ..., 10; more has a chance of one in 10^8."""
    out, p, total = [], float(np.exp(-1.0)), 0.0
    for k in range(1, 12):
        total += p
        out.append(total)
        p /= k
    return out


def _digest(seed: int, number: Column, group: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"), F.lit(":"), group))


def _unit_of(digest: Column, k: Column) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def _count_at(u: Column) -> Column:
    out = F.lit(11)
    for m, step in reversed(list(enumerate(_poisson_steps()))):
        out = F.when(u < step, m).otherwise(out)
    return out


def poisson_multiplicities(group: Column, draws: int, seed: int) -> Column:
    """How often each group enters each draw: Poisson(1) counts from a hash of seed, draw and group.

    Independent of any order, so every task gets the same counts for a group, and a lost one again.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.lit(-(-draws // SHARED) - 1)), lambda h: _digest(seed, h, group))
    numbers = F.flatten(F.transform(hashes, lambda d: F.array(*(_unit_of(d, F.lit(k)) for k in range(SHARED)))))
    return F.slice(F.transform(numbers, _count_at), 1, draws)


def _spread(sums: DataFrame) -> DataFrame:
    """The rows of groups over as many tasks as a shuffle has, however few bytes they are: every row is worth thousands of draws.

    Dealt by a hash of the group: a second shuffle by the group itself is left out of the plan, and the tasks of the first are joined by their bytes.
    """
    return sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("g"))


#: Groups whose draws are numbers of one array at a time.
GROUPS_AT_ONCE = 100


def _poisson_sums(columns: Sequence[str], draws: int, seed: int, shared: int):
    """What a task adds up: for each draw the sums of its groups' columns, each as often as the group enters the draw."""
    heads = [f"{seed}:{h}:".encode() for h in range(-(-draws // shared))]
    steps = np.array(_poisson_steps())

    def counts(names: list[bytes]) -> np.ndarray:
        words = md5_words(heads, names)
        if shared == 1:  # 13 hexadecimal digits
            u = ((words[0].astype(np.int64) << 20) | (words[1] >> 12)) / float(1 << 52)
        else:
            u = np.stack(words[:shared], 2).reshape(len(names), -1)[:, :draws] / float(1 << 32)
        return np.searchsorted(steps, u, side="right").astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(columns)))
        for batch in batches:
            names = [g.encode() for g in batch.column(0).to_pylist()]
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            plain = np.isfinite(x).all(1)  # a sum that isn't finite counts only in draws that its group enters
            for lo in range(0, len(names), GROUPS_AT_ONCE):
                at = slice(lo, lo + GROUPS_AT_ONCE)
                m, own = counts(names[at]), plain[at]
                total += m[own].T @ x[at][own]
                for k in np.flatnonzero(~own):
                    total += np.where(m[k, :, None] > 0, m[k, :, None] * x[lo + k], 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int64()), *(pa.array(total[:, k]) for k in range(len(columns)))], ["draw", *columns])

    return run


def _weighed(sums: DataFrame, draws: int, seed: int, law: str, columns: Sequence[str], shared: int) -> DataFrame:
    """(draw, columns): the sums over all groups, each as often as it enters the draw; draws that no group enters are left out. The first column is the number of rows."""
    if law == "poisson":
        rows = _spread(sums).select("g", *(F.col(c).cast("double").alias(c) for c in columns))
        each = rows.mapInArrow(_poisson_sums(columns, draws, seed, shared), "draw long, " + ", ".join(f"{c} double" for c in columns))
        return each.groupBy("draw").agg(*(F.sum(c).alias(c) for c in columns)).where(F.col(columns[0]) > 0)
    if law != "multinomial":
        raise ValueError(law)
    n = sums.count()
    numbered = running_before(sums.withColumn("_one", F.lit(1)), "g", ["_one"]).withColumnRenamed("_one_before", "_k")
    tickets = sums.sparkSession.range(draws * n).select((F.col("id") / n).cast("int").alias("draw"), (F.col("id") % n).alias("_t"))
    taken = F.floor(unit_number(F.concat_ws(":", F.lit(str(seed)), "draw", "_t")) * n).cast("long")
    counts = tickets.select("draw", taken.alias("_k")).groupBy("draw", "_k").agg(F.count("*").alias("m"))
    return counts.join(numbered, "_k").groupBy("draw").agg(*(F.sum(F.col("m") * F.col(x)).alias(x) for x in columns))


def cluster_bootstrap(df: DataFrame, actual: str, predicted: str, group: str, draws: int = 2000, seed: int = 42, no_group: str = "NO_GROUP", law: str = "poisson", shared: int = SHARED) -> DataFrame:
    """(metric, estimate, ci_lower, ci_upper, draws, rows, groups): percentile intervals over resampled groups.

    Rows are summed to one row of sufficient statistics for each group first; a draw weighs those sums. Sums over
    groups are combined in each task, so what is shuffled is a row for each draw and task, whatever the table's size.
    law: `poisson`, or `multinomial`, which draws as many groups as there are with replacement, in the order of their
    names, and costs one row for each draw and group. shared: how many Poisson draws, 1 or up to 4, share one hash.
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit(no_group))
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    sums = rows.groupBy(g.alias("g")).agg(*regression_sums(F.col(actual).cast("double"), F.col(predicted).cast("double")))
    total = sums.agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in ("sy", "syy", "se2", "sae")), F.count("*").alias("groups"))
    point = total.select("n", "groups", *scores())
    weighed = _weighed(sums, draws, seed, law, ["n", "sy", "syy", "se2", "sae"], shared).select("draw", *scores())
    names = ("r2", "rmse", "mae")
    limits = weighed.agg(*(F.percentile(x, p).alias(f"{x}_{k}") for x in names for k, p in (("lo", 0.025), ("hi", 0.975))))
    both = point.crossJoin(F.broadcast(limits))  # one row each
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("estimate"), F.col(f"{x}_lo").alias("ci_lower"), F.col(f"{x}_hi").alias("ci_upper")) for x in names)))
    return both.select(each.alias("e"), F.col("n").alias("rows"), "groups").select("e.*", F.lit(draws).cast("long").alias("draws"), "rows", "groups")


def paired_bootstrap(df: DataFrame, actual: str, first: str, second: str, group: str, draws: int = 2000, seed: int = 42, law: str = "poisson", shared: int = 1) -> DataFrame:
    """Differences second - first of r2, rmse and mae, both models weighed by the same draws; rows that lack the value or a prediction count for neither.

    Every group has a hash of its own for each draw (`shared`: for so many draws), see cluster_bootstrap().
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit("NO_GROUP"))
    y, a, b = (F.col(c).cast("double") for c in (actual, first, second))
    names = ["n", "sy", "syy", "se2_a", "sae_a", "se2_b", "sae_b"]
    each = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), *(c for tag, p in (("a", a), ("b", b)) for c in (F.sum((p - y) * (p - y)).alias(f"se2_{tag}"), F.sum(F.abs(p - y)).alias(f"sae_{tag}")))]
    sums = df.where(y.isNotNull() & a.isNotNull() & b.isNotNull()).groupBy(g.alias("g")).agg(*each)
    out = _weighed(sums, draws, seed, law, names, shared)
    for tag in "ab":
        out = out.withColumns({"se2": F.col(f"se2_{tag}"), "sae": F.col(f"sae_{tag}")}).select("*", *scores(f"_{tag}")).drop("se2", "sae")
    deltas = out.select("draw", *((F.col(f"{x}_b") - F.col(f"{x}_a")).alias(x) for x in ("r2", "rmse", "mae")))
    long = deltas.select(F.explode(F.create_map(*(v for x in ("r2", "rmse", "mae") for v in (F.lit(x), F.col(x))))).alias("metric", "delta"))
    return long.groupBy("metric").agg(F.percentile("delta", 0.5).alias("median_delta"), F.percentile("delta", 0.025).alias("ci_lower"), F.percentile("delta", 0.975).alias("ci_upper"), F.count("*").alias("draws"))


def ks_statistic(df: DataFrame, value: str, cohort: Column) -> DataFrame:
    """Largest distance between two cohorts' distribution functions (cohort: true or false), over counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(cohort).alias("a"), F.count_if(~cohort).alias("b"))
    total = F.broadcast(counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))  # one row
    upto = lambda c, n: F.try_divide((F.col(f"{c}_before") + F.col(c)).cast("double"), F.col(n))
    gap = F.abs(upto("a", "na") - upto("b", "nb"))
    return running_before(counts, "v", ["a", "b"]).crossJoin(total).select(gap.alias("d"), "a", "b").agg(F.max("d").alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def standardized_difference(df: DataFrame, value: str, cohort: Column) -> DataFrame:
    x = F.col(value).cast("double")
    a, b = F.when(cohort, x), F.when(~cohort, x)
    s = df.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    return s.select("mean_a", "mean_b", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("smd"))


def total_variation(df: DataFrame, category: str, cohort: Column) -> DataFrame:
    """Half the sum of absolute differences of shares; and of cohort b, the share of rows whose category a doesn't have."""
    c = df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("<null>")).alias("c")).agg(F.count_if(cohort).alias("a"), F.count_if(~cohort).alias("b"))
    whole = F.broadcast(c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))  # one row
    shares = c.crossJoin(whole).select("a", "b", F.try_divide(F.col("a").cast("double"), F.col("na")).alias("x"), F.try_divide(F.col("b").cast("double"), F.col("nb")).alias("y"))
    return shares.agg((0.5 * F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))).alias("tvd"), F.sum(F.when(F.col("a") == 0, F.col("y")).otherwise(0.0)).alias("unseen_rate"), F.count_if(F.col("a") > 0).alias("categories_a"), F.count_if(F.col("b") > 0).alias("categories_b"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def fold_integrity(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that lie in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")
