"""Measures whose rule was once misread: small cases with numbers worked out by hand."""

import math

import numpy as np
import pytest

from tessera.operators import grid as G
from tessera.operators import linear as L
from tessera.operators import records as R
from tessera.operators import similarity as M


def test_zero_crossings_are_shared_by_all_rows(spark):
    df = spark.createDataFrame([(i, float((-1) ** i), 0.0) for i in range(4)], "k int, a double, b double")
    assert tuple(M.zero_crossings(df, "k").first()) == (3, 0.75)
    assert tuple(M.zero_crossings(df.where("false"), "k").first()) == (0, None)


@pytest.mark.parametrize(("rows", "n", "picks"), [(4, 3, [1, 3, 4]), (4, 4, [1, 2, 3, 4]), (4, 9, [1, 2, 3, 4]), (10, 1, [10]), (15, 5, [1, 5, 8, 12, 15]), (1, 3, [1]), (12, 0.1, [12]), (0, 3, [])])
def test_uniform_picks_are_rounded_half_up(spark, rows, n, picks):
    df = spark.createDataFrame([(i + 1,) for i in range(rows)], "k int")
    assert [r["k"] for r in R.subset(df, "uniform", n, ["k"]).collect()] == picks


def test_shares_are_rounded(spark):
    df = spark.createDataFrame([(i,) for i in range(12)], "k int")
    assert R.subset(df, "first", 0.1, ["k"]).count() == 1
    assert R.subset(df, "first", 0.125, ["k"]).count() == 2


def gates(spark, values, n=3, **options):
    return [tuple(r) for r in G.gate_centroids(spark.createDataFrame([(v,) for v in values], "v double"), "v", n, **options).orderBy("gate").collect()]


def test_gates_of_a_constant_series_and_of_none(spark):
    assert gates(spark, [5.0] * 7) == [(0, 5.0, None)]
    assert gates(spark, [None, None]) == []
    assert gates(spark, []) == []


def test_gates_over_empty_bins(spark):
    low, high = 100 / 256, 100 * 255 / 256  # bin 1 and bin 255: half of the rows are in bin 0, half in bin 255
    got = gates(spark, [0.0] * 50 + [100.0] * 50)
    assert [g for g, *_ in got] == [0, 1, 2]
    assert [c for _, c, _ in got] == pytest.approx([high, (low + high) / 2, low])
    assert [t for *_, t in got] == pytest.approx([(high - low) / 4] * 3)


def image(a, b):
    return [(i, j, float(a[i, j]), float(b[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]


def edge_count(v):
    p = np.pad(v, 1, mode="edge")
    gx = sum(w * (p[i : i + v.shape[0], 2:] - p[i : i + v.shape[0], :-2]) for i, w in ((0, 1), (1, 2), (2, 1))) / 8
    gy = sum(w * (p[2:, j : j + v.shape[1]] - p[:-2, j : j + v.shape[1]]) for j, w in ((0, 1), (1, 2), (2, 1))) / 8
    gx, gy = abs(gx), abs(gy)
    g = gx * gx + gy * gy
    q = np.pad(g, 1, mode="edge")
    rows = (gx >= gy - 2e-14) & (q[1:-1, :-2] <= g) & (g > q[1:-1, 2:])
    cols = (gy >= gx - 2e-14) & (q[:-2, 1:-1] <= g) & (g > q[2:, 1:-1])
    return int(((g > 4 * g.mean()) & (rows | cols)).sum())


def test_gradient_entropy_compares_two_images(spark):
    rng = np.random.default_rng(2)
    a, b = np.zeros((12, 14)), np.zeros((12, 14))
    a[3:9, 4:10] = 5
    b[5:11, 2:7] = 3
    a += rng.normal(size=a.shape) * 0.1
    want = 0.5 * (math.log2(edge_count(a)) + math.log2(edge_count(b))) / math.log2(edge_count(abs(a - b)))
    df = spark.createDataFrame(image(a, b), "r int, c int, a double, b double")
    assert M.gradient_entropy(df, "r", "c").first()["gre"] == pytest.approx(want)
    absent = df.where("NOT (r = 4 AND c = 5)")
    a[4, 5] = b[4, 5] = 0
    want = 0.5 * (math.log2(edge_count(a)) + math.log2(edge_count(b))) / math.log2(edge_count(abs(a - b)))
    assert M.gradient_entropy(absent, "r", "c").first()["gre"] == pytest.approx(want)
    assert M.gradient_entropy(df.withColumn("b", df["a"]), "r", "c").first()["gre"] is None


def besov(v, levels, p=1.0, beta=4 / 9, gamma=4.0):
    out, low = 0.0, v.astype(float)
    for j in range(1, levels + 2):
        if j <= levels:
            parts = [low]
            for axis in range(v.ndim):
                split = []
                for x in parts:
                    if x.shape[axis] % 2:
                        x = np.concatenate([x, np.zeros_like(x.take([0], axis))], axis)
                    even, odd = x.take(range(0, x.shape[axis], 2), axis), x.take(range(1, x.shape[axis], 2), axis)
                    split += [(even + odd) / math.sqrt(2), (even - odd) / math.sqrt(2)]
                parts = split
            low, details = parts[0], parts[1:]
        else:
            details = [low]
        s = sum((abs(d) ** beta).sum() for d in details) ** (1 / beta)
        out += (2 ** (-j * (p + 0.5 - 1 / beta)) * s) ** gamma
    return out ** (1 / gamma)


@pytest.mark.parametrize("shape", [(11,), (9, 8), (5, 6, 7)])
def test_besov_norm_of_images(spark, shape):
    v = np.random.default_rng(5).normal(size=shape)
    axes = ["x", "y", "z"][: v.ndim]
    df = spark.createDataFrame([(*map(int, at), float(x)) for at, x in np.ndenumerate(v) for at in [at]], ", ".join(f"{k} int" for k in axes) + ", v double")
    assert M.besov(df, axes, "v", levels=3).first()["besov"] == pytest.approx(besov(v, 3))


@pytest.mark.parametrize("kind", ["capped", "log", "scad", "mcp"])
@pytest.mark.parametrize("step", [0.3, 1.0, 2.5, 7.0])
def test_nonconvex_prox_is_the_least_point(kind, step):
    lam, theta = 0.8, 3.0
    a = np.random.default_rng(7).normal(0, 3, 40)
    penalty = L.nonconvex_penalty(kind, lam, theta)
    fine = np.linspace(0, 14, 40001)
    values = np.array([penalty(np.array([z])) for z in fine])
    for x, z in zip(a, L.nonconvex(kind, lam, theta)(a.copy(), step), strict=True):
        assert (abs(z) - abs(x)) ** 2 / 2 + step * penalty(np.array([z])) <= ((fine - abs(x)) ** 2 / 2 + step * values).min() + 1e-9
        assert z == 0 or np.sign(z) == np.sign(x)


def test_known_prox_points():
    assert L.nonconvex("mcp", 1.0, 3.0)(np.array([2.37]), 1.0)[0] == pytest.approx(2.055)
    assert L.nonconvex("log", 1.0, 3.0)(np.array([2.37]), 1.0)[0] == pytest.approx((2.37 - 3 + math.sqrt(5.37**2 - 4)) / 2)


def test_a_fit_that_its_steps_cut_short_raises(spark):
    df = spark.createDataFrame([(float(i), float(i % 2 * 2 - 1)) for i in range(20)], "x double, y double")
    with pytest.raises(RuntimeError, match="not settled"):
        L.newton_fit(df, ["x"], "y", "logistic", steps=1)
