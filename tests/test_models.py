"""Folds, penalised logistic models, calibration and neighbours against plain programs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.operators import models, resampling


def newton(x, y, weight, strength, steps=100):
    """Balanced ridge-penalised logistic regression on standardised columns."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    s, ridge, w = np.where(y == 1, weight[1], weight[0]), np.r_[0, np.full(x.shape[1], strength)], np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (s * (p - y)) + ridge * w)
    return w[0] - (w[1:] / scale) @ mean, w[1:] / scale, z, s, w


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)) * [1, 5, 0.1, 1] + [0, 100, 0, 3]
    x[:, 3] = 7  # constant
    y = (x[:, 0] + (x[:, 1] - 100) / 5 + rng.logistic(size=600) > 0.8).astype(int)
    fold = rng.integers(0, 4, 600)
    data = [(int(i), *map(float, v), int(c), int(f)) for i, (v, c, f) in enumerate(zip(x, y, fold, strict=True))]
    extra = [(9000, None, 1.0, 1.0, 1.0, 1, 0), (9001, 1.0, 1.0, 1.0, 1.0, None, 0), (9002, 1.0, float("nan"), 1.0, 1.0, 1, 0), (9003, 1.0, 1.0, 1.0, 1.0, 0, None)]
    df = spark.createDataFrame(data + extra, "id long, a double, b double, c double, d double, y int, fold int").repartition(6)
    return df, x, y, fold


def test_fits_of_all_folds_equal_newton_on_the_driver(rows):
    df, x, y, fold = rows
    penalties = [models.Penalty("l2", c) for c in (0.01, 1.0)] + [models.Penalty("l1", c) for c in (0.02, 0.5)]
    found = models.logistic_folds(df, ["a", "b", "c", "d"], "y", "fold", penalties).collect()
    assert len(found) == 16 and all(r.converged for r in found)
    for r in found:
        own = fold != r.fold
        weight = [own.sum() / (2 * (y[own] == k).sum()) for k in (0, 1)]
        kind, c = r.candidate.split("_")[1], float(r.candidate.split("_C")[1])
        intercept, coefficients, z, s, _ = newton(x[own], y[own], weight, 1 / c)
        if kind == "l2":
            assert math.isclose(r.intercept, intercept, rel_tol=1e-7) and np.allclose(r.coefficients, coefficients, rtol=1e-7, atol=1e-10)
        else:  # the conditions of a minimum with an absolute penalty
            scale = np.where(x[own].std(axis=0) > 0, x[own].std(axis=0), 1)
            w = np.array(r.coefficients) * scale
            p = 1 / (1 + np.exp(-(r.intercept + x[own] @ np.array(r.coefficients))))
            g = z.T @ (s * (p - y[own]))
            assert abs(g[0]) < 1e-5
            for j, (own_w, own_g) in enumerate(zip(w, g[1:], strict=True)):
                assert abs(own_g + np.sign(own_w) / c) < 1e-5 if own_w else abs(own_g) <= 1 / c + 1e-5, j
    whole = models.logistic_folds(df, ["a", "b"], "y", None, penalties[:1]).first()
    usable = np.r_[x[:, :2], [[1.0, 1.0]]], np.r_[y, 0]  # the row without a fold counts here
    want = newton(*usable, [len(usable[1]) / (2 * (usable[1] == k).sum()) for k in (0, 1)], 100.0)
    # the fit on all rows has no nulls in a and b but those of rows 9000 and 9002
    assert np.allclose(whole.coefficients, want[1], rtol=1e-6)


def test_out_of_fold_probabilities_and_report(rows):
    df, x, y, fold = rows
    clean = df.where("id < 9000")
    predicted, report = models.cross_validated(clean, ["a", "b"], "y", "fold", [models.Penalty("l2", 1.0)])
    got = {r.id: r.probability for r in predicted.collect()}
    aurocs = []
    for f in range(4):
        train, own = fold != f, fold == f
        weight = [train.sum() / (2 * (y[train] == k).sum()) for k in (0, 1)]
        intercept, coefficients, *_ = newton(x[train][:, :2], y[train], weight, 1.0)
        p = 1 / (1 + np.exp(-(intercept + x[own][:, :2] @ coefficients)))
        assert np.allclose([got[int(i)] for i in np.flatnonzero(own)], p, rtol=1e-7)
        pos, neg = p[y[own] == 1], p[y[own] == 0]
        aurocs.append((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2)
    r = report.first()
    assert math.isclose(r.cv_mean, np.mean(aurocs), rel_tol=1e-9) and math.isclose(r.cv_std, np.std(aurocs), rel_tol=1e-6)


def test_fits_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(1.0, 1, 0), (2.0, 1, 1), (3.0, 1, 0)], "a double, y int, fold int")
    found = models.logistic_folds(df, ["a"], "y", "fold", [models.Penalty("l2", 1.0)]).collect()
    assert len(found) == 2 and all(r.coefficients is None and not r.converged for r in found)
    assert models.logistic_folds(df.limit(0), ["a"], "y", "fold", [models.Penalty("l2", 1.0)]).count() == 0


def test_folds_keep_groups_whole_and_classes_even(spark):
    rng = np.random.default_rng(5)
    data, row = [], 0
    for g in range(3000):
        common = rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1])
        for _ in range(1000 if g == 7 else min(60, int(rng.pareto(1.5) * 2) + 1)):
            data.append((row, f"g{g}", str(common if rng.random() < 0.8 else rng.choice(["a", "b", "c"]))))
            row += 1
    df = spark.createDataFrame(data + [(-1, None, "a")], "id long, grp string, y string")
    folds = models.stratified_group_folds(df, "grp", "y", 5, 1)
    own = {r.grp: r.fold for r in folds.collect()}
    assert len(own) == 3000 and set(own.values()) == set(range(5))
    counts = {}
    for _, g, y in data:
        counts[own[g], y] = counts.get((own[g], y), 0) + 1
    share = {y: sum(v for (_, c), v in counts.items() if c == y) / len(data) for y in "abc"}
    for f in range(5):
        size = sum(counts[f, y] for y in "abc")
        assert abs(size / len(data) - 0.2) < 0.02
        assert all(abs(counts[f, y] / size - share[y]) < 0.02 for y in "abc"), f
    assert {r.grp: r.fold for r in models.stratified_group_folds(df.repartition(3), "grp", "y", 5, 1).collect()} == own


def test_platt_scaling(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=500) * 3, 1)
    y = (0.5 * x - 0.4 + rng.logistic(size=500) > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 1), (float("nan"), 1), (1.0, None)], "x double, y int")
    slope, intercept = models.platt(df, "x", "y")
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, h = np.array([((p - y) * x).sum() + a, (p - y).sum()]), p * (1 - p)
        a, b = np.array([a, b]) - np.linalg.solve([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum()]], g)
    assert math.isclose(slope, a, rel_tol=1e-9) and math.isclose(intercept, b, rel_tol=1e-9)
    assert models.platt(df.where("y = 1"), "x", "y") == (1.0, 0.0) == models.platt(df.limit(0), "x", "y")


def test_nearest_neighbours_in_many_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (230, 3)).astype(float)  # many ties and equal vectors
    data = [(i, x[i].tolist(), int(i % 3)) for i in range(230)]
    df = spark.createDataFrame(data, "id long, v array<double>, label int")
    queries, known = df.where("id % 4 = 0"), df.where("id % 4 <> 0")
    near = models.nearest_neighbours(queries, known, "id", "v", "label", 7, per_block=40)
    got = {r.id: [(n.distance, n.other, n.label) for n in r.near] for r in near.collect()}
    for i in range(0, 230, 4):
        want = sorted((math.sqrt(((x[i] - x[j]) ** 2).sum()), j, j % 3) for j in range(230) if j % 4)[:7]
        assert got[i] == want
    for k, weights in ((5, "distance"), (7, "uniform")):
        votes = {}
        for r in models.neighbour_votes(near, "id", k, weights).collect():
            votes.setdefault(r.id, {})[r.label] = r.share
        for i, own in got.items():
            w = {}
            zero = any(d == 0 for d, _, _ in own[:k])
            for d, _, label in own[:k]:
                w[label] = w.get(label, 0) + (1 if weights == "uniform" else (d == 0) if zero else 1 / d)
            assert np.allclose([votes[i][c] for c in sorted(w)], [w[c] / sum(w.values()) for c in sorted(w)]) and set(votes[i]) == set(w)
    assert models.nearest_neighbours(queries, known.limit(0), "id", "v", "label", 3).count() == 0
    assert models.nearest_neighbours(queries, known.limit(2), "id", "v", "label", 5).select(F.max(F.size("near"))).first()[0] == 2


def test_lines_far_from_zero(spark):
    """Lines of values around 1e8 are those of the values moved to zero."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 4, float(x), float(2 * x + e)) for i, (x, e) in enumerate(zip(rng.normal(size=80), rng.normal(size=80), strict=True))]
    near = spark.createDataFrame(rows, "id int, fold int, x double, y double")
    far = near.selectExpr("id", "fold", "x + 1e8 AS x", "y + 1e8 AS y")
    for run in (lambda d: resampling.out_of_fold(d, "x", "y", "fold"), lambda d: resampling.leave_one_out(d, "x", "y")):
        a, b = ({r.id: r.predicted for r in run(d).collect()} for d in (near, far))
        assert all(abs(b[i] - 1e8 - a[i]) < 1e-5 for i in a)


def test_few_rows_may_be_nearest():
    """Products choose little more than the nearest, all ties among them, and everything where they say nothing."""
    rng = np.random.default_rng(8)
    known = np.r_[rng.normal(size=(500, 16)), np.zeros((40, 16))]
    x = np.r_[rng.normal(size=(20, 16)), np.zeros((1, 16))]
    chosen = list(models.maybe_nearest(x, known, (known**2).sum(axis=1), 7))
    square = ((x[:, None] - known[None]) ** 2).sum(axis=2)
    for own, row in zip(chosen, square, strict=True):
        assert set(np.argsort(row, kind="stable")[:7]) <= set(own)
    assert all(len(own) < 60 for own in chosen) and len(chosen[-1]) == 40
    known[3, 2] = np.nan
    assert len(next(models.maybe_nearest(x, known, (known**2).sum(axis=1), 7))) == 540
