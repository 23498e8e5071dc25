"""Models whose every prediction comes from rows of other folds: encoders, forests, residual stages, ridge, cohorts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.shared import shared_folder, written

#: Levels of a category that occur less often in a training set are one level, OTHER; more levels than MOST_LEVELS are an error.
MIN_FREQUENCY, MOST_LEVELS = 5, 5000
#: A target is modelled from so many rows; a class target also needs so many rows of its rarer class.
LEAST_ROWS, LEAST_MINORITY = 300, 40
#: Rows of a training set that one task holds.
ROWS_PER_TASK = 200_000
#: Forests that are fitted at the same time.
FORESTS_AT_ONCE = 6
PENALTIES = (0.1, 1.0, 10.0, 100.0)


def by_fold(df: DataFrame, fold: str) -> DataFrame:
    """df written once, a folder for each fold: what asks for one fold, or for all but one, reads no other."""
    path = shared_folder(df.sparkSession, "folds")
    df.write.partitionBy(fold).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@dataclass
class Encoder:
    """What a training set says about the features: medians, scales, kept levels and the most frequent one of each category."""

    numeric: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    frequent: dict[str, str] = field(default_factory=dict)

    def stages(self) -> list:
        """Spark ML stages that make the vector _x: scaled numbers without gaps, and one place for each kept level and for all others."""
        from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler

        tick = lambda c: "`" + c.replace("`", "``") + "`"
        text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        made = [f"coalesce(nanvl(cast({tick(c)} as double), null), {m!r}D) / {s!r}D as _n{k}" for k, (c, (m, s)) in enumerate(self.numeric.items())]
        made += [f"coalesce(cast({tick(c)} as string), {text(self.frequent[c])}) as _c{k}" for k, c in enumerate(self.levels)]
        out = [SQLTransformer(statement=f"select *, {', '.join(made)} from __THIS__")]
        into = [f"_n{k}" for k in range(len(self.numeric))]
        if self.levels:
            cats = [f"_c{k}" for k in range(len(self.levels))]
            out.append(StringIndexerModel.from_arrays_of_labels([v or [""] for v in self.levels.values()], cats, [f"{c}i" for c in cats], handleInvalid="keep"))
            out.append(OneHotEncoder(inputCols=[f"{c}i" for c in cats], outputCols=[f"{c}v" for c in cats], dropLast=False))
            into += [f"{c}v" for c in cats]
        return [*out, VectorAssembler(inputCols=into, outputCol="_x")]


def fit_encoders(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold: str, folds: int, min_frequency: int = MIN_FREQUENCY, most_levels: int = MOST_LEVELS) -> list[Encoder]:
    """An encoder for each fold, of all rows outside of it, and one of all rows at the end.

    Numbers: gaps take the median; values are divided by the standard deviation after that, 1 if it is 0. Categories:
    gaps take the most frequent level (of equal ones the first by name); levels under min_frequency and unseen ones are
    one. A column without any value is 0, or all other. All encoders come from one pass for the numbers and one for the
    levels: what a training set has is what all have less what its fold has.
    """
    out = [Encoder() for _ in range(folds + 1)]
    if numeric:
        outside = lambda k: F.lit(True) if k == folds else F.coalesce(F.col(fold) != k, F.lit(True))
        own = lambda c, k: F.when(outside(k), F.nanvl(F.col(c).cast("double"), F.lit(None)))
        row = df.agg(*(F.struct(
            F.percentile_approx(own(c, k), 0.5, 10_000).alias("median"), F.count(own(c, k)).alias("n"), F.sum(own(c, k)).alias("s"), F.sum(own(c, k) * own(c, k)).alias("q"), F.count_if(outside(k)).alias("rows"),
        ).alias(f"m{j}_{k}") for j, c in enumerate(numeric) for k in range(folds + 1))).first()
        for j, c in enumerate(numeric):
            for k in range(folds + 1):
                r = row[f"m{j}_{k}"]
                m, gaps, n = r["median"] or 0.0, r["rows"] - r["n"], max(1, r["rows"])
                mean = ((r["s"] or 0.0) + gaps * m) / n
                spread = ((r["q"] or 0.0) + gaps * m * m) / n - mean * mean
                out[k].numeric[c] = (float(m), float(np.sqrt(spread)) if spread > 1e-12 * max(1.0, mean * mean) else 1.0)
    if categorical:
        stacked = df.select(F.col(fold).alias("_f"), F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical))).alias("x")).where("x.v is not null")
        counts = stacked.groupBy("x.c", "x.v", "_f").agg(F.count("*").alias("n"))
        often = counts.groupBy("c", "v").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("_f", F.lit(-1)), "n"))).alias("by")).where(F.col("all") >= min_frequency)
        found = often.limit(most_levels + 1).collect()
        if len(found) > most_levels:
            raise ValueError(f"more than {most_levels} levels that occur {min_frequency} times")
        for k in range(folds + 1):
            for c in categorical:
                kept = sorted((-(r["all"] - r["by"].get(k, 0)), r["v"]) for r in found if r["c"] == c and r["all"] - r["by"].get(k, 0) >= min_frequency)
                out[k].levels[c] = sorted(v for _, v in kept)
                out[k].frequent[c] = kept[0][1] if kept else ""
    return out


def support_by(df: DataFrame, by: Sequence[str], target: str, task: str = "regression", least_rows: int = LEAST_ROWS, least_minority: int = LEAST_MINORITY) -> DataFrame:
    """(by, target, n, status) for each group: trained, skipped_insufficient_rows, or for classes skipped_insufficient_class_support.

    Rows without a target, or with another class than 0 and 1, don't count. Without `by` there is one row, of an empty
    table too.
    """
    y = F.col(target).cast("double")
    usable = F.coalesce(y.isNotNull() & ~F.isnan(y) & (y.isin(0.0, 1.0) if task == "classification" else F.lit(True)), F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(usable).alias("n"), F.count_if(usable & (y == 1)).alias("_ones"))
    enough = (F.col("n") >= least_rows) & (F.least(F.col("_ones"), F.col("n") - F.col("_ones")) >= least_minority if task == "classification" else F.lit(True))
    short = "skipped_insufficient_class_support" if task == "classification" else "skipped_insufficient_rows"
    return counts.select(*by, F.lit(target).alias("target"), "n", F.when(enough, "trained").otherwise(short).alias("status"))


def support(df: DataFrame, target: str, task: str = "regression", least_rows: int = LEAST_ROWS, least_minority: int = LEAST_MINORITY) -> dict:
    """{status, n} of a whole table, see support_by()."""
    row = support_by(df, [], target, task, least_rows, least_minority).first()
    return {"status": row["status"], "n": row["n"]}


def out_of_fold(
    df: DataFrame, features: Sequence[str], target: str, fold: str, folds: int, categorical: Sequence[str] = (), task: str = "regression", weight: str | None = None, outside: bool = False, trees: int = 50, depth: int = 8, seed: int = 42
) -> DataFrame:
    """df with oof: each fold's rows predicted by a forest, and features encoded, by the rows of all other folds alone.

    Classes are predicted as the probability of 1. weight: a column of row weights. Rows without a target are predicted,
    not learned from; with `outside`, they are predicted by one more forest of all rows that have one. Rows without a
    fold have no prediction. df is written once by folds and the result is a written table, so that stages that follow
    each other read each other's result and not the plan that made it.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    rows = by_fold(df, fold)
    y = F.col(target).cast("double")
    usable = y.isNotNull() & ~F.isnan(y)
    encoders = fit_encoders(rows.where(usable), [c for c in features if c not in categorical], [c for c in features if c in categorical], fold, folds)
    common = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "oof", "numTrees": trees, "maxDepth": depth, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": seed} | ({"weightCol": weight} if weight else {})
    sizes = rows.groupBy(fold).agg(F.count_if(usable).alias("usable"), F.count("*").alias("all")).collect()  # a row for each fold
    count = lambda of, which: sum(of(r) for r in sizes if which(r[fold]))

    def told_of(k: int) -> DataFrame | None:
        if k < folds:
            n, own_n = count(lambda r: r["usable"], lambda f: f is not None and f != k), count(lambda r: r["usable" if outside else "all"], lambda f: f == k)
        else:
            n, own_n = count(lambda r: r["usable"], lambda f: True), count(lambda r: r["all"] - r["usable"], lambda f: True)
        if not n or not own_n:
            return None
        train = rows.where(usable & (F.col(fold) != k) if k < folds else usable)
        own = rows.where((F.col(fold) == k) & (usable if outside else F.lit(True)) if k < folds else ~usable)
        forest = RandomForestClassifier(**common | {"predictionCol": "_class", "probabilityCol": "_p"}) if task == "classification" else RandomForestRegressor(**common)
        # forests draw rows by their place; they read them several times, so the order is made once
        laid = train.repartition(-(-n // ROWS_PER_TASK), *features).sortWithinPartitions(*features, target).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = Pipeline(stages=[*encoders[k].stages(), forest]).fit(laid.withColumn("_y", y))
        finally:
            laid.unpersist()
        told = model.transform(own)
        told = told.withColumn("oof", vector_to_array("_p")[1]) if task == "classification" else told
        return told.select(*df.columns, "oof")

    # folds don't wait for each other: one forest alone has fewer tasks than there are cores
    with ThreadPoolExecutor(min(folds + outside, FORESTS_AT_ONCE)) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(told_of), range(folds + outside)))
    out = None
    for told in found:
        if told is not None:
            out = told if out is None else out.unionAll(told)
    left = rows.where(F.col(fold).isNull() & (usable if outside else F.lit(True))).withColumn("oof", F.lit(None).cast("double"))
    return written(left if out is None else out.unionAll(left), "oof")


def residual_stages(df: DataFrame, blocks: Sequence[Sequence[str]], target: str, fold: str, folds: int, **model) -> DataFrame:
    """Stage after stage predicts what the earlier ones left over; adds oof_stage_1, ... and oof, their sum.

    Each stage reads the written result of the one before, so its scans don't grow with the number of stages.
    """
    out = df.withColumn("_rest", F.col(target).cast("double"))
    for k, block in enumerate(blocks, 1):
        out = out_of_fold(out, block, "_rest", fold, folds, **model).withColumnRenamed("oof", f"oof_stage_{k}")
        out = out.withColumn("_rest", F.col("_rest") - F.col(f"oof_stage_{k}"))
    return out.withColumn("oof", sum((F.col(f"oof_stage_{k}") for k in range(2, len(blocks) + 1)), F.col("oof_stage_1"))).drop("_rest")


def with_added_cohort(base: DataFrame, added: DataFrame, weight: float = 1.0, completeness: Column | None = None) -> DataFrame:
    """base and the rows of another cohort under each other, with is_added and sample_weight (1, and `weight` for added rows); columns that one lacks are null there.

    completeness: only added rows whose value is at least the exact median of all added rows' come in.
    """
    if completeness is not None:
        scored = added.withColumn("_c", completeness)
        middle = scored.agg(F.percentile("_c", 0.5).alias("_middle"))
        added = scored.crossJoin(F.broadcast(middle)).where(F.col("_c") >= F.col("_middle")).drop("_c", "_middle")  # one row
    mark = lambda df, a, w: df.withColumn("is_added", F.lit(a)).withColumn("sample_weight", F.lit(float(w)))
    return mark(base, False, 1.0).unionByName(mark(added, True, weight), allowMissingColumns=True)


@dataclass
class Ridge:
    """scores: (penalty, rmse, r2) of out-of-fold predictions; coefficients and intercept of each left-out fold and, last, of all rows, at the best penalty."""

    features: list[str]
    scores: list[tuple[float, float, float]]
    penalty: float
    coefficients: list[np.ndarray]
    intercepts: list[float]

    def predicted(self, fold: str | None = None) -> Column:
        """The prediction for a row: by the model without its fold, or by that of all rows."""
        told = [sum((F.col(c).cast("double") * float(w) for c, w in zip(self.features, ws, strict=True)), F.lit(float(b))) for ws, b in zip(self.coefficients, self.intercepts, strict=True)]
        if fold is None:
            return told[-1]
        out = F.when(F.col(fold) == 0, told[0])
        for k in range(1, len(told) - 1):
            out = out.when(F.col(fold) == k, told[k])
        return out


def gram_by_fold(df: DataFrame, features: Sequence[str], target: str, fold: str, folds: int, weight: str | None = None) -> np.ndarray:
    """For each fold the sums of products of (1, features, target), in one pass; rows with a gap in any of them, or without a fold, are left out.

    Each task adds up its own rows and sends one number for each fold and product.
    """
    p = len(features) + 2
    upper = np.triu_indices(p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, len(upper[0])))
        for batch in batches:
            f, w, *xs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            x = np.column_stack([np.ones(len(f)), *xs]).astype(float)
            for k in np.unique(f):
                own = x[f == k]
                total[int(k)] += ((own * w[f == k, None]).T @ own)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(folds), len(upper[0])), pa.int32()), pa.array(np.tile(np.arange(len(upper[0])), folds), pa.int32()), pa.array(total.ravel())], ["fold", "at", "s"])

    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    picked = df.select(F.col(fold).cast("int").alias("_f"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), *(number(c).alias(f"_x{k}") for k, c in enumerate([*features, target])))
    rows = picked.dropna().where(f"_f between 0 and {folds - 1}").mapInArrow(sums, "fold int, at int, s double").groupBy("fold", "at").agg(F.sum("s").alias("s")).collect()  # folds times p squared numbers
    out = np.zeros((folds, p, p))
    for r in rows:
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[r["fold"], i, j] = out[r["fold"], j, i] = r["s"]
    return out


def solve_ridge(gram: np.ndarray, penalty: float, scaled: bool = True) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from sums of products; the intercept isn't penalised, features are (if `scaled`) of standard deviation 1 when they are."""
    n = gram[0, 0]
    if n <= 0:
        return np.zeros(len(gram) - 2), 0.0
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0) / n) if scaled else np.ones(len(gram) - 2)
    scale = np.where(spread > 1e-9 * np.maximum(1, np.abs(mean[:-1])), spread, 1.0)
    a = cov[:-1, :-1] / np.outer(scale, scale) + penalty * np.eye(len(scale))
    w = np.linalg.lstsq(a, cov[:-1, -1] / scale, rcond=None)[0] / scale
    return w, float(mean[-1] - w @ mean[:-1])


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, fold: str, folds: int, penalties: Sequence[float] = PENALTIES, weight: str | None = None, scaled: bool = True) -> Ridge:
    """Ridge regression whose penalty has the smallest out-of-fold RMSE (of equal ones the first), from one pass over df.

    What a model of all folds but one has learned is the sum of all folds' products less its own; and the error on the
    fold follows from the fold's own products, so neither another penalty nor another fold reads the rows again. The
    driver holds folds times features squared numbers. Rows with gaps are not learned from and have no prediction.
    """
    own = gram_by_fold(df, features, target, fold, folds, weight)
    whole = own.sum(0)
    if whole[0, 0] <= 0:
        raise ValueError("no row has all features and a target")
    n, sst = whole[0, 0], whole[-1, -1] - whole[0, -1] ** 2 / whole[0, 0]
    scores, kept = [], {}
    for a in penalties:
        models = [solve_ridge(whole - g, a, scaled) for g in own]
        sse = 0.0
        for g, (w, b) in zip(own, models, strict=True):
            e = np.array([b, *w, -1.0])
            sse += float(e @ g @ e)
        scores.append((float(a), float(np.sqrt(max(0.0, sse) / n)), float(1 - sse / sst) if sst > 0 else float(sse <= 0)))
        kept[a] = [*models, solve_ridge(whole, a, scaled)]
    best = min(scores, key=lambda s: s[1])[0]
    return Ridge(list(features), scores, best, [w for w, _ in kept[best]], [b for _, b in kept[best]])
