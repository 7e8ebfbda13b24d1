"""Dual coordinate ascent: gaps, weights and bias against plain minimisation, several tasks, awkward rows."""

import numpy as np
import pytest

from tessera.operators import dual as S


def sample(n=60, seed=3):
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)
    x = rng.normal(size=(n, 2)) * [1.0, 3.0]
    x[:, 0] += 2 * y + 1
    return x, y


def table(spark, x, y, c=None, parts=3):
    rows = [([float(v) for v in a], float(b), float(w)) for a, b, w in zip(x, y, np.ones(len(y)) if c is None else c, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, y double, c double").repartition(parts)


def objective(loss, x, y, c, lam, multiplier, w, b):
    f = x @ w + b
    return lam / 2 * (w @ w + (b / multiplier) ** 2) + float(c @ S.losses(loss, f, y)) / len(y)


@pytest.mark.parametrize("loss", ["hinge", "hinge2", "l1", "l2", "logistic"])
@pytest.mark.parametrize("tasks", [1, 3])
def test_gap_and_optimum(spark, loss, tasks):
    x, y = sample()
    epsilon, multiplier = (1e-3, 10.0) if tasks == 1 else (5e-2, 1.0)  # tasks that don't see each other's rows settle later
    fit = S.dual_fit(table(spark, x, y), "x", "y", loss, lam=0.05, bias_multiplier=multiplier, epsilon=epsilon, tasks=tasks)
    primal, dual, gap = fit.history[-1]
    assert gap <= epsilon and primal >= dual - 1e-12
    one = np.ones(len(y))
    assert objective(loss, x, y, one, 0.05, multiplier, fit.weights, fit.bias) == pytest.approx(primal, rel=1e-9)
    rng = np.random.default_rng(1)
    for size in (1e-3, 1e-2, 0.1, 0.5):  # no point is better than the dual bound
        for _ in range(60):
            w, b = fit.weights + rng.normal(size=2) * size, fit.bias + rng.normal() * size
            assert objective(loss, x, y, one, 0.05, multiplier, w, b) >= dual - 1e-9


def test_row_weights_count_as_copies(spark):
    x, y = sample(40)
    c = np.where(np.arange(40) < 10, 3.0, 1.0)
    weighted = S.dual_fit(table(spark, x, y, c), "x", "y", "hinge2", lam=0.1, weight="c", epsilon=1e-6)
    times = c.astype(int)
    copies = S.dual_fit(table(spark, np.repeat(x, times, 0), np.repeat(y, times)), "x", "y", "hinge2", lam=0.1 * 40 / times.sum(), epsilon=1e-6)
    assert np.allclose(weighted.weights, copies.weights, atol=5e-3)
    assert weighted.bias == pytest.approx(copies.bias, abs=5e-3)


def test_awkward_rows_and_limits(spark):
    x, y = sample(20)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)]
    awkward = [([float("nan"), 1.0], 1.0), ([None, 1.0], 1.0), (None, -1.0), ([1.0, 2.0], None)]
    df = spark.createDataFrame(rows + awkward, "x array<double>, y double")
    plain = S.dual_fit(spark.createDataFrame(rows, "x array<double>, y double"), "x", "y", lam=0.1, epsilon=1e-5)
    assert np.allclose(S.dual_fit(df, "x", "y", lam=0.1, epsilon=1e-5).weights, plain.weights, atol=0.05)
    with pytest.raises(RuntimeError, match="gap"):
        S.dual_fit(df, "x", "y", lam=1e-6, epsilon=1e-12, rounds=2)
    with pytest.raises(ValueError, match="no rows"):
        S.dual_fit(df.where("false"), "x", "y")
    with pytest.raises(ValueError, match="loss"):
        S.dual_fit(df, "x", "y", "huber")


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert S.scores(df, "x", S.Fit(np.array([3.0, -1.0]), 0.5)).first()["score"] == 1.5
