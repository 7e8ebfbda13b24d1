"""Fits against their own objective, computed plainly: no point around a solution is better."""

import numpy as np
import pytest

from tessera.operators import linear as L

NAMES = [f"x{i}" for i in range(5)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    f = x @ [1.5, -1.0, 0.0, 0.0, 0.3] + 0.4
    y = np.where(f + rng.normal(size=300) > 0, 1.0, -1.0)
    flag = np.digitize(f, [-1, 1]).astype(float)
    value, part = f + 0.1 * rng.normal(size=300), np.arange(300) % 3
    rows = [(*map(float, r), float(a), float(b), (int(p), float(v)), float(1 + (a > 0))) for r, a, b, p, v in zip(x, y, flag, part, value, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", y double, flag double, price struct<task:int,label:double>, c double").repartition(3)
    return df, x, y, flag, value, part


@pytest.fixture
def plainly(data, monkeypatch):
    """Fits sum over arrays instead of a table, by the function that tasks call."""
    _, x, y, flag, value, part = data

    def sums(_df, _features, target, loss, w, mode="one", weight=None, width=1.0):
        label = {"y": y, "flag": flag, "price": value}[target]
        return L.unpacked(L.partial_sums(x, label, 1.0 + (y > 0) if weight else np.ones(len(x)), part, w, loss, mode, width), *w.shape)

    monkeypatch.setattr(L, "second_order", sums)


def test_sums_of_tasks(data):
    df, x, y, flag, value, part = data
    w = np.random.default_rng(6).normal(size=(3, 6))
    for target, label, mode, weight in (("y", y, "one", "c"), ("flag", flag, "class", None), ("price", value, "task", None)):
        own = w[:1] if mode == "one" else w
        got = L.second_order(df, NAMES, target, "logistic", own, mode, weight)
        want = L.unpacked(L.partial_sums(x, label, 1.0 + (y > 0) if weight else np.ones(len(x)), part, own, "logistic", mode, 1.0), *own.shape)
        for a, b in zip(got, want, strict=True):
            assert np.allclose(a, b)


def test_fit_of_a_table(data):
    df, x, y, *_ = data
    w = L.newton_fit(df, NAMES, "y", "l2")[0][0]
    assert np.allclose(w, np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0])


def true_loss(kind, f, y):
    m = y * f
    return {"logistic": np.logaddexp(0, -m), "hinge": np.maximum(1 - m, 0), "hinge2": np.maximum(1 - m, 0) ** 2, "l1": np.abs(f - y), "l2": (f - y) ** 2}[kind]


def margin(x, w):
    return x @ w[:-1] + w[-1]


def assert_least(objective, w, tolerance, project=lambda w: w):
    rng, best = np.random.default_rng(1), objective(w)
    for size in (0.3, 0.1, 0.03, 0.01, 0.001):
        for _ in range(60):
            other = project(w + size * rng.normal(size=w.shape) * (rng.random(w.shape) < 0.5))
            assert objective(other) >= best - tolerance


def inner(fn):
    """A projection of the weights, with the intercepts as they are."""

    def project(w):
        out = w.copy()
        out[..., :-1] = fn(w[..., :-1].ravel().copy(), 1.0).reshape(w[..., :-1].shape)
        return out

    return project


@pytest.mark.parametrize("loss", ["hinge", "hinge2", "l1", "l2", "logistic"])
def test_losses(data, loss, plainly):
    df, x, y, *_ = data
    w, history = L.newton_fit(df, NAMES, "y", loss, ridge=0.1)

    def objective(w):
        return true_loss(loss, margin(x, w), y).mean() + 0.05 * (w[:-1] ** 2).sum()

    assert_least(objective, w[0], 0.006 if loss in ("hinge", "l1") else 1e-7)
    assert history[-1] == pytest.approx(objective(w[0]), abs=0.006)


def test_lasso_ball_and_signs(data, plainly):
    df, x, y, *_ = data

    def loss(w):
        return true_loss("logistic", margin(x, w), y).mean()

    prox, penalty = L.lasso_penalty(0.05)
    w = L.newton_fit(df, NAMES, "y", "logistic", prox, penalty)[0][0]
    assert (w[:-1] == 0).any()
    assert_least(lambda w: loss(w) + 0.05 * np.abs(w[:-1]).sum(), w, 1e-7)
    heavy = L.newton_fit(df, NAMES, "y", "logistic", prox, penalty, weight="c")[0][0]
    c = 1 + (y > 0)
    assert_least(lambda w: (c * true_loss("logistic", margin(x, w), y)).sum() / c.sum() + 0.05 * np.abs(w[:-1]).sum(), heavy, 1e-7)
    prox, penalty = L.lasso_penalty(0.05, nonnegative=True)
    w = L.newton_fit(df, NAMES, "y", "logistic", prox, penalty)[0][0]
    assert (w[:-1] >= 0).all()
    assert_least(lambda w: loss(w) + 0.05 * w[:-1].sum(), w, 1e-7, inner(lambda v, s: np.maximum(v, 0)))
    for ball in (L.l1_ball(0.8), L.nonnegative_ball(0.8)):
        w = L.newton_fit(df, NAMES, "y", "logistic", ball)[0][0]
        assert np.abs(w[:-1]).sum() <= 0.8 + 1e-9
        assert_least(loss, w, 1e-6, inner(ball))


def test_groups_fused_and_nonconvex(data, plainly):
    df, x, y, *_ = data
    groups = [[0, 1], [2, 3], [4]]

    def group(w):
        return 0.05 * sum(np.sqrt(len(g)) * np.linalg.norm(w[g]) for g in groups)

    def fused(w):
        return 0.02 * np.abs(w).sum() + 0.05 * np.abs(np.diff(w)).sum()

    cases = [("logistic", L.shrink_groups(groups)(0.05), group), ("logistic", L.fused(0.02, 0.05), fused)]
    for kind in ("capped", "log", "scad", "mcp"):
        cases += [(loss, L.nonconvex(kind, 0.05, 3.0), L.nonconvex_penalty(kind, 0.05, 3.0)) for loss in ("logistic", "hinge2")]
    for loss, prox, penalty in cases:
        w = L.newton_fit(df, NAMES, "y", loss, prox, penalty)[0][0]
        rng = np.random.default_rng(2)

        def objective(w, loss=loss, penalty=penalty):
            return true_loss(loss, margin(x, w), y).mean() + penalty(w[:-1])

        for _ in range(200):  # a local minimum: penalties without convexity may have others
            assert objective(w + 0.003 * rng.normal(size=w.shape)) >= objective(w) - 1e-6


def test_classes_and_tasks_share_features(data, plainly):
    df, x, _, flag, value, part = data
    sign = np.where(flag[:, None] == np.arange(3), 1.0, -1.0)

    def shared(w):
        return np.linalg.norm(w[:, :-1], axis=0).sum()

    def classes(kind):
        return lambda w: sum(true_loss(kind, margin(x, w[b]), sign[:, b]).mean() for b in range(3))

    def tasks(w):
        return sum(true_loss("l2", margin(x[part == b], w[b]), value[part == b]).sum() for b in range(3)) / len(x)

    prox, penalty = L.rows_together(0.1, 3)
    for kind in ("logistic", "l2"):
        w, _ = L.newton_fit(df, NAMES, "flag", kind, prox, penalty, mode="class", blocks=3)
        assert_least(lambda w, kind=kind: classes(kind)(w) + 0.1 * shared(w), w, 1e-6)
        assert ((w[:, :-1] == 0).all(0) | (w[:, :-1] != 0).all(0)).all()
    w, _ = L.newton_fit(df, NAMES, "price", "l2", prox, penalty, mode="task", blocks=3)
    assert_least(lambda w: tasks(w) + 0.1 * shared(w), w, 1e-6)
    ball = L.rows_ball(1.5, 3)
    w, _ = L.newton_fit(df, NAMES, "flag", "logistic", ball, mode="class", blocks=3)
    assert shared(w) <= 1.5 + 1e-9
    assert_least(classes("logistic"), w, 1e-6, inner(ball))


def test_path_gains_features(data, plainly):
    df, *_ = data
    found = L.newton_path(df, NAMES, "y", "logistic", [0.01, 0.2, 0.05])
    assert [lam for lam, _ in found] == [0.2, 0.05, 0.01]
    support = [int((w[:-1] != 0).sum()) for _, w in found]
    assert support == sorted(support)
