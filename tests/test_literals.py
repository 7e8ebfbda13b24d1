"""Hand cases and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bins, curves, grid, linear, records, sampling, transforms, vectors
from tessera.plans.prefix import global_row_number, prefix_scan


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(range(len(labels)), labels, scores, strict=True)), "id int, label int, score double")


def one(df):
    return df.first().asDict()


def test_perfect_scores(spark):
    df = scored(spark, [1, 1, -1, -1, -1], [5.0, 4.0, 3.0, 2.0, 1.0])
    rows = curves.roc(df, "label", "score", "id").orderBy("rank").collect()
    assert [r["tpr"] for r in rows] == [0, 0.5, 1, 1, 1, 1]
    assert [round(r["tnr"], 6) for r in rows] == [1, 1, 1, round(2 / 3, 6), round(1 / 3, 6), 0]
    s = one(curves.roc_summary(df, "label", "score", "id"))
    assert s["auc"] == pytest.approx(1) and s["eer"] == pytest.approx(0)
    p = one(curves.pr_summary(df, "label", "score", "id"))
    assert p["ap"] == pytest.approx(1) and p["ap11"] == pytest.approx(1) and p["auc"] == pytest.approx(1)


def test_swapped_scores(spark):
    df = scored(spark, [1, 1, -1, -1, -1], [5.0, 3.0, 4.0, 2.0, 1.0])
    s = one(curves.roc_summary(df, "label", "score", "id"))
    assert s["auc"] == pytest.approx(5 / 6) and s["eer"] == pytest.approx(1 / 3)
    p = one(curves.pr_summary(df, "label", "score", "id"))
    assert p["auc"] == pytest.approx(0.5 + 0.5 * (0.5 + 2 / 3) / 2)
    assert p["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert p["ap11"] == pytest.approx((6 + 5 * 2 / 3) / 11)


def test_infinite_scores_are_not_retrieved(spark):
    df = scored(spark, [1, 1, -1, -1, -1, -1], [1.0, -math.inf, -1.0, -1.0, -1.0, -1.0])
    assert curves.tp_fp(df, "label", "score", "id").count() == 6
    assert curves.tp_fp(df, "label", "score", "id", infinite=True).count() == 7


def test_bin_search(spark):
    df = spark.createDataFrame([(-11.0,), (-10.0,), (9.5,), (10.0,), (float("nan"),)], "x double")
    edges = [float(e) for e in range(-10, 11)]
    assert [r[0] for r in df.select(bins.bin_of(F.col("x"), edges)).collect()] == [0, 1, 20, 21, None]


def test_weighted_histogram_of_one_edge(spark):
    df = spark.createDataFrame([(1.0, float(w)) for w in range(1, 11)], "x double, w double")
    assert [tuple(r) for r in bins.weighted_histogram(df, "x", "w", [1.0]).collect()] == [(1, 55.0)]


def test_integral_of_ones(spark):
    df = spark.createDataFrame([(r, c, 1) for r in range(1, 6) for c in range(1, 7)], "r int, c int, v int")
    assert all(x["integral"] == x["r"] * x["c"] for x in grid.integral(df, "r", "c", "v").collect())


def test_natural_order(spark):
    df = spark.createDataFrame([(s,) for s in ("B1", "B2", "B12", "A12", "A1", "A2")], "s string")
    assert [r[0] for r in df.orderBy(records.natural_key(F.col("s"))).collect()] == ["A1", "A2", "A12", "B1", "B2", "B12"]


def test_natural_order_of_runs_longer_than_the_width(spark):
    want = ["v2", "v" + "0" * 30 + "3", "v" + "9" * 20, "v1" + "0" * 20, "v1" + "0" * 19 + "1x", "v2" + "0" * 20, "v1" + "0" * 25]
    df = spark.createDataFrame([(s,) for s in reversed(want)], "s string")
    got = [r[0] for r in df.orderBy(records.natural_key(F.col("s"))).collect()]
    number = {s: int(s[1:].rstrip("x")) for s in want}
    assert got == sorted(want, key=lambda s: (number[s], s))



def test_prefix_scan_equals_running_sum(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(100)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, v int").repartition(5)
    got = prefix_scan(df, [F.asc("i")], {"s": F.col("v")}, {"m": F.col("v")}).orderBy("i").collect()
    total, top = 0, -1
    for r in got:
        total, top = total + r["v"], max(top, r["v"])
        assert (r["s"], r["m"]) == (total, top)
    assert [r["n"] for r in global_row_number(df, [F.asc("i")], "n").orderBy("i").collect()] == list(range(1, 501))
    assert global_row_number(df.limit(0), [F.asc("i")], "n").count() == 0


def test_vlad_toy(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (0, [3.0])], "g int, v array<double>")
    got = vectors.vlad(df, "g", "v", [[0.0], [10.0]], normalise=False).collect()
    assert [(r["cluster"], r["value"]) for r in got] == [(0, 6.0)]


def test_nearest_equals_distance_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = vectors.nearest(df.where("id < 10"), df, 4).collect()
    d = ((x[:10, None] - x[None]) ** 2).sum(2)
    for r in got:
        assert r["b"] == np.argsort(d[r["a"]])[r["rank"] - 1]


def test_kmeans_energy_falls_and_square_is_fixed(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(100, 8)))], "id long, v array<double>")
    _, energy = vectors.kmeans_l2(df, "v", vectors.plus_plus(df, "v", "id", 4), 8)
    assert all(b <= a + 1e-9 for a, b in zip(energy, energy[1:], strict=False))
    square = [[1.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(square)], "id long, v array<double>")
    assert sorted(vectors.kmeans_l2(df, "v", square, 3)[0]) == sorted(square)


def test_lasso_optimality(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(200, 5))
    y = a @ [1.0, 0, -2.0, 0, 0.5] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(a, y, strict=True)], "a double, b double, c double, d double, e double, y double")
    w = linear.lasso(df, list("abcde"), "y", 0.1)
    lam = 0.1 * np.abs(a.T @ y).max()
    g = a.T @ (a @ w - y)
    assert np.all(np.abs(g) <= lam * (1 + 1e-6))
    assert np.allclose(g[w != 0], -lam * np.sign(w[w != 0]), atol=1e-4 * lam)


def test_tv_denoise_is_optimal(spark):
    rng = np.random.default_rng(5)
    x = np.repeat([0.0, 3.0, 1.0], 10) + 0.3 * rng.normal(size=30)
    df = spark.createDataFrame([(1, x.tolist()), (2, [2.0] * 6), (3, [1.0])], "id int, x array<double>")
    got = {r["id"]: np.array(r["denoised"]) for r in transforms.tv_denoise(df, "x", 0.5).collect()}
    z = got[1]
    u = np.cumsum(x - z)[:-1]
    assert np.all(np.abs(u) <= 0.5 + 1e-9) and abs((x - z).sum()) < 1e-9
    jump = np.flatnonzero(np.abs(np.diff(z)) > 1e-9)
    assert np.allclose(u[jump], -0.5 * np.sign(np.diff(z)[jump]))
    assert np.allclose(got[2], 2) and np.allclose(got[3], 1)


def test_wavelet_round_trip(spark):
    x = np.random.default_rng(6).normal(size=64)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    out = transforms.wavelet_denoise(df, "x", factor=0.0).first()["denoised"]
    assert np.allclose(out, x, atol=1e-9)


def test_poisson_disc_is_maximal(spark):
    cells = spark.createDataFrame([(x, y, 2.5) for x in range(12) for y in range(12)], "x int, y int, r double")
    kept = [(r["x"], r["y"]) for r in sampling.poisson_disc(cells, "x", "y", "r", seed=1).collect()]
    assert all(math.dist(a, b) >= 2.5 for a in kept for b in kept if a != b)
    assert all(any(math.dist((x, y), k) < 2.5 for k in kept) for x in range(12) for y in range(12))


def test_information_merge(spark):
    rows = [("c0", "f1", 3), ("c0", "f2", 3), ("c1", "f3", 2), ("c1", "f4", 2)]
    got = sampling.merge_by_information(spark.createDataFrame(rows, "c string, f string, n int"), "c", "f", "n").collect()
    parents = {r["node"]: r["parent"] for r in got}
    assert parents["f1"] == parents["f2"] and parents["f3"] == parents["f4"] and parents["f1"] != parents["f3"]


def test_mask_text_round_trip_and_error(spark):
    lines = spark.createDataFrame([(0, "--x-"), (1, "xx0x"), (2, "x*O-")], "row int, line string")
    got = sampling.mask_rows(lines)
    assert [r["bit"] for r in got.orderBy("row", "col").collect()] == [0, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1, 0]
    assert sampling.mask_text(got, "row", "col", "bit").count() == 3
    with pytest.raises(Exception, match="unknown mask character"):
        sampling.mask_rows(spark.createDataFrame([(0, "q")], "row int, line string")).collect()
