"""Predictions don't see their own fold, scans don't grow with folds to the power of stages, ridge equals a brute-force fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import models as L

SCHEMA = "id long, a double, b double, y double, fold int"


def test_residual_stages_without_leakage(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 2))
    rows = [(k, float(a), float(b), 12 + 1.5 * float(a) + float(b), k % 3) for k, (a, b) in enumerate(x)]
    fit = lambda rs: L.residual_stages(spark.createDataFrame(rs, SCHEMA), [["a"], ["b"]], "y", "fold", 3, trees=5, depth=4)
    told = fit(rows)
    got, spoilt = ({r.id: r for r in df.collect()} for df in (told, fit([(i, a, b, y + 1000 * (fold == 0), fold) for i, a, b, y, fold in rows])))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # the last stage's table and nothing before it
    assert all(abs(r.oof - r.oof_stage_1 - r.oof_stage_2) < 1e-9 for r in got.values())
    for i, r in got.items():  # a fold's own targets change nothing in the first stage's predictions for it, all others do change
        assert (abs(r.oof_stage_1 - spoilt[i].oof_stage_1) < 1e-9) == (r.fold == 0)
    y = np.array([12 + 1.5 * a + b for a, b in x])
    assert np.mean((y - [got[i].oof for i in range(60)]) ** 2) < 0.7 * y.var()


def test_encoders_are_of_the_other_folds(spark):
    rows = [(k, None if k == 5 else float(k), ["x", "y", "it's"][k % 3] if k < 27 else None, k % 3) for k in range(30)] + [(30, 1000.0, "only here", 0)] * 6
    enc = L.fit_encoders(spark.createDataFrame(rows, "id int, n double, c string, fold int"), ["n"], ["c"], "fold", 3, 5)
    for k in range(4):
        own = [r for r in rows if r[3] != k]
        values = sorted(r[1] for r in own if r[1] is not None)
        median, scale = enc[k].numeric["n"]
        assert median in values and abs(values.index(median) - len(values) / 2) <= 1
        assert abs(scale - np.std([median if r[1] is None else r[1] for r in own])) < 1e-9
        counts = {v: sum(r[2] == v for r in own) for v in ("x", "y", "it's", "only here")}
        assert enc[k].levels["c"] == sorted(v for v, n in counts.items() if n >= 5)
        assert enc[k].frequent["c"] == min(counts, key=lambda v: (-counts[v], v))


def test_categories_classes_weights_and_rows_outside(spark):
    rng = np.random.default_rng(1)
    rows = [(k, None if k % 17 == 0 else float(rng.normal()), None if k % 29 == 3 else ["p", "q", "r"][k % 3], float(k % 3 == 0) if k % 10 else None, k % 4 if k % 25 else None, 1.0 + k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, n double, c string, y double, fold int, w double")
    got = {r.id: r for r in L.out_of_fold(df, ["n", "c"], "y", "fold", 4, ["c"], "classification", "w", outside=True, trees=5, depth=4).collect()}
    assert len(got) == 300
    for r in got.values():
        if r.y is None:
            assert 0 <= r.oof <= 1  # predicted by the model of all rows
        elif r.fold is None:
            assert r.oof is None
        elif r.c:
            assert (r.oof > 0.5) == (r.c == "p")
    inside = L.out_of_fold(df, ["n", "c"], "y", "fold", 4, ["c"], "classification", trees=3, depth=3).where("fold is not null")
    assert inside.count() == inside.where("oof is not null").count()


def test_support_gates(spark):
    df = lambda ys: spark.createDataFrame([(y,) for y in ys], "y double")
    assert L.support(df([1.0] * 300), "y") == {"status": "trained", "n": 300}
    assert L.support(df([1.0] * 299 + [None, float("nan")]), "y") == {"status": "skipped_insufficient_rows", "n": 299}
    assert L.support(df([1.0] * 270 + [0.0] * 39 + [2.0]), "y", "classification") == {"status": "skipped_insufficient_class_support", "n": 309}
    assert L.support(df([1.0] * 270 + [0.0] * 40), "y", "classification")["status"] == "trained"
    assert L.support(df([]), "y", "classification")["n"] == 0


def test_added_cohorts(spark):
    base, added = spark.createDataFrame([(1, 2.0)], "id int, y double"), spark.createDataFrame([(k, 1.0, k / 10) for k in range(10, 15)], "id int, y double, filled double")
    rows = L.with_added_cohort(base, added, 0.5, F.col("filled")).collect()
    assert [(r.id, r.is_added, r.sample_weight, r.filled) for r in sorted(rows, key=lambda r: r.id)] == [(1, False, 1.0, None), (12, True, 0.5, 1.2), (13, True, 0.5, 1.3), (14, True, 0.5, 1.4)]
    assert L.with_added_cohort(base, added.limit(0), 0.5, F.col("filled")).count() == 1


@pytest.mark.parametrize("weight", [None, "w"])
def test_ridge_like_brute_force(spark, weight):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (90, 3)) * [1, 100, 0.01]
    y = x @ [1.0, 0.02, 30.0] + rng.normal(0, 1, 90) + 7
    w = rng.integers(1, 4, 90).astype(float) if weight else np.ones(90)
    rows = [(*map(float, a), float(b), int(k % 4), float(c)) for k, (a, b, c) in enumerate(zip(x, y, w))]
    rows += [(None, 1.0, 1.0, 1.0, 0, 1.0), (1.0, 1.0, 1.0, None, 0, 1.0), (1.0, float("nan"), 1.0, 5.0, 1, 1.0), (1.0, 1.0, 1.0, 5.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int, w double").repartition(3)
    fit = L.fit_ridge(df, ["a", "b", "c"], "y", "fold", 4, (0.5, 5.0, 500.0), weight)
    fold, scores = np.arange(90) % 4, []

    def solve(rows, penalty):
        m = np.average(x[rows], axis=0, weights=w[rows])
        s = np.sqrt(np.average((x[rows] - m) ** 2, axis=0, weights=w[rows]))
        z, my = (x[rows] - m) / s, np.average(y[rows], weights=w[rows])
        c = np.linalg.solve(z.T @ (z * w[rows, None]) + penalty * np.eye(3), z.T @ (w[rows] * (y[rows] - my))) / s
        return c, my - c @ m

    for penalty in (0.5, 5.0, 500.0):
        p = np.zeros(90)
        for k in range(4):
            c, b = solve(np.flatnonzero(fold != k), penalty)
            p[fold == k] = x[fold == k] @ c + b
        scores.append(np.sqrt(np.average((y - p) ** 2, weights=w)))
    assert np.allclose([s[1] for s in fit.scores], scores) and fit.penalty == (0.5, 5.0, 500.0)[int(np.argmin(scores))]
    for k in range(5):
        c, b = solve(np.flatnonzero(fold != k), fit.penalty)
        assert np.allclose(fit.coefficients[k], c) and np.isclose(fit.intercepts[k], b)
    told = df.where("fold = 2 and a is not null").select("a", "b", "c", fit.predicted("fold").alias("p")).first()
    assert np.isclose(told.p, fit.coefficients[2] @ [told.a, told.b, told.c] + fit.intercepts[2])
    with pytest.raises(ValueError):
        L.fit_ridge(df.limit(0), ["a"], "y", "fold", 4)


def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading

    from pyspark.ml import Pipeline

    fit, together, laid = Pipeline.fit, threading.Barrier(3, timeout=60), []

    def waits(self, df, *more):
        laid.append(df.storageLevel is not None and "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString())
        together.wait()
        return fit(self, df, *more)

    monkeypatch.setattr(Pipeline, "fit", waits)
    df = spark.createDataFrame([(k, float(k % 7), float(k % 5), k % 3 if k else None) for k in range(60)], "id int, a double, y double, fold int")
    got = L.out_of_fold(df, ["a"], "y", "fold", 3, trees=2, depth=2)
    assert got.count() == 60 and [r.id for r in got.where("oof is null").collect()] == [0] and laid == [True] * 3
