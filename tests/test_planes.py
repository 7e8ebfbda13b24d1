"""Principal components and what is built on their plane, on more rows than a quadratic or nested form gets through."""

import time

import numpy as np
import pytest

from tessera.operators import vectors
from tessera.plans.catalog import QUERIES


def written(spark, folder, x):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_modes_there_and_back_of_thousands_of_vectors(spark, tmp_path):
    """0.2 s a row where each score was worked out anew for each component."""
    x = np.random.default_rng(11).normal(size=(4000, 64)) / np.arange(1, 65)
    folder, began = written(spark, tmp_path, x), time.monotonic()
    whole = {r["id"]: r["y"] for r in QUERIES["a20_pca_round_trip"](spark, folder).collect()}
    part = {r["id"]: (r["modes"], r["y"]) for r in QUERIES["a20_pca_filter"](spark, folder).collect()}
    assert time.monotonic() - began < 60
    at = np.arange(1, 65)
    assert np.allclose([whole[i] for i in range(4000)], x @ at, atol=1e-6)
    c = x - x.mean(0)
    _u, s, modes = np.linalg.svd(c, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s * s) / (s * s).sum(), 0.9)) + 1
    assert {m for m, _ in part.values()} == {k}
    assert np.allclose([part[i][1] for i in range(4000)], (c @ modes[1:k].T @ modes[1:k] + x.mean(0)) @ at, atol=2e-6)


def test_projections_of_missing_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, None), (3, [3.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0])], "id long, v array<double>").coalesce(1)
    out, modes, values = vectors.pca(df, "v", 2)
    got = {r["id"]: r["projected"] for r in out.collect()}
    assert got[2] is None and all(len(got[i]) == 2 for i in (1, 3, 4)) and modes.shape == (2, 3) and len(values) == 2
    back = vectors.pca_back(out, "projected", modes, np.array([4, 3, 6]) / 3).orderBy("id").collect()
    assert back[1]["restored"] is None and np.allclose(back[0]["restored"], [1, 2, 5])
    assert vectors.project(df.where("v is null"), "v", modes, np.zeros(3)).first()["projected"] is None


def shifted(x, y, w, of):
    """(density, parent) of some points by all pairs."""
    d2 = (x[of, None] - x) ** 2 + (y[of, None] - y) ** 2
    return d2, np.round(np.where(d2 <= 2.25, np.exp(-d2 / 0.5), 0) @ w, 9)


def parents(d2, density, mine, of):
    far = (d2 > 1) | (density < mine[:, None]) | ((density == mine[:, None]) & (np.arange(len(density)) >= of[:, None]))
    d2 = np.where(far, np.inf, d2)
    return [int(r.argmin()) if np.isfinite(r).any() else None for r in d2]


@pytest.mark.parametrize("crowd", [16, 4096])
def test_shift_in_crowded_cells(spark, monkeypatch, crowd):
    """Points on a grid, so that densities and distances tie; the fine cells and the parts of a cell are taken at 16."""
    monkeypatch.setattr(vectors, "CROWD", crowd)
    rng = np.random.default_rng(12)
    x, y = np.round(rng.normal(size=(2, 700)) * 2, 1)
    x[:150], y[:150], x[150:160], y[150:160] = rng.integers(0, 4, 150) / 10, rng.integers(0, 4, 150) / 10, rng.uniform(-60, 60, 10), -40.0
    w = rng.integers(1, 4, 700).astype(float)
    rows = [(i, float(x[i]), float(y[i]), int(w[i])) for i in range(700)] + [(900, None, 0.0, 1), (901, float("nan"), 0.0, 1), (902, float("inf"), 0.0, 1)]
    got = {r["id"]: r for r in vectors.quick_shift(spark.createDataFrame(rows, "id long, x double, y double, w long"), "id", "x", "y", 0.5, 1.0, "w").collect()}
    every = np.arange(700)
    d2, density = shifted(x, y, w, every)
    assert sorted(got) == list(range(700))
    assert np.allclose([got[i]["density"] for i in range(700)], density, rtol=0, atol=2e-9)
    density = np.array([got[i]["density"] for i in range(700)])  # whose last digits decide ties
    assert [got[i]["parent"] for i in range(700)] == parents(d2, density, density, every)


def test_shift_of_many_points_in_a_few_cells(spark):
    """By rows of pairs, 15,000 points took minutes."""
    rng = np.random.default_rng(13)
    x, y = rng.uniform(0, 1.5, size=(2, 15_000))
    df = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(15_000)], "id long, x double, y double")
    began = time.monotonic()
    got = {r["id"]: r for r in vectors.quick_shift(df, "id", "x", "y", 0.5, 1.0).collect()}
    assert time.monotonic() - began < 90 and len(got) == 15_000
    density, some = np.array([got[i]["density"] for i in range(15_000)]), np.arange(0, 15_000, 75)
    d2, want = shifted(x, y, np.ones(15_000), some)
    assert np.allclose(density[some], want, rtol=0, atol=2e-9)
    assert [got[i]["parent"] for i in some] == parents(d2, density, density[some], some)


@pytest.fixture(scope="module")
def close_vectors(spark, tmp_path_factory):
    """15,000 vectors (by rows of pairs, minutes) whose plane is a few cells wide, and where they lie in it."""
    x = np.random.default_rng(14).normal(size=(15_000, 3)) * [0.01, 0.06, 0.05]
    c = x - x.mean(0)
    return written(spark, tmp_path_factory.mktemp("close"), x), np.round(c @ np.linalg.svd(c, full_matrices=False)[2][:2].T * 10, 2)


def test_shift_of_thousands_of_vectors(spark, close_vectors):
    folder, p = close_vectors
    began = time.monotonic()
    got = {r["id"]: r for r in QUERIES["l16_quick_shift_pca"](spark, folder).collect()}
    assert time.monotonic() - began < 90 and len(got) == len(p)
    some = np.arange(0, len(p), 75)
    d2, want = shifted(*p.T, np.ones(len(p)), some)
    assert np.allclose([got[i]["density"] for i in some], want, rtol=0, atol=1e-6)
    density = np.array([got[i]["density"] for i in range(len(p))])
    assert [got[i]["parent"] for i in some] == parents(d2, density, density[some], some)


def test_cut_trees_of_thousands_of_vectors(spark, close_vectors):
    """Every place's root is where its links end that are no longer than half the reach."""
    folder, p = close_vectors
    links = {r["id"]: r["parent"] for r in QUERIES["l16_quick_shift_pca"](spark, folder).collect()}
    began = time.monotonic()
    got = {r["id"]: r["root"] for r in QUERIES["l16_tree_cut"](spark, folder).collect()}
    assert time.monotonic() - began < 90
    _places, first = np.unique(p, axis=0, return_index=True)  # the least id of a place
    assert sorted(got) == sorted(first.tolist())

    def end(i):
        while links[i] is not None and ((p[i] - p[links[i]]) ** 2).sum() <= 0.25:
            i = links[i]
        return i

    assert all(got[i] == end(i) for i in got)
