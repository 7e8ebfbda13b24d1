"""Block Lanczos against numpy's own decomposition, badly conditioned matrices, many small blocks."""

import numpy as np
import pytest

from tessera.operators import lanczos as Z


def table(spark, a, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(a)], "id long, vector array<double>").repartition(parts)


def matrix(rows, columns, values, seed=2):
    rng = np.random.default_rng(seed)
    u = np.linalg.qr(rng.normal(size=(rows, len(values))))[0]
    v = np.linalg.qr(rng.normal(size=(columns, len(values))))[0]
    return u * values @ v.T


def left(out, rows):
    u = np.full((rows, len(out.first()["u"])), np.nan)
    for r in out.collect():
        u[r["id"]] = r["u"]
    return u


@pytest.mark.parametrize("fan", [64, 3])
def test_residual_and_orthonormal_vectors_at_condition_1e9(spark, monkeypatch, fan):
    monkeypatch.setattr(Z, "FAN", fan)
    a = matrix(420, 30, 10.0 ** -np.linspace(0, 9, 30))
    out, values, right = Z.block_lanczos(table(spark, a), "id", "vector", k=6, its=2, rows=16)
    u = left(out, len(a))
    true = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a - u * values @ right, 2) <= 1.01 * true[6]
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-8 and np.abs(right @ right.T - np.eye(6)).max() < 1e-12
    assert values == pytest.approx(true[:6], rel=1e-6)


def test_all_components_keep_small_singular_values(spark):
    """The product of the matrix with itself would lose everything below 1e-8 of the largest value."""
    a = matrix(200, 8, 10.0 ** -np.linspace(0, 11, 8))
    out, values, right = Z.block_lanczos(table(spark, a), "id", "vector", k=8, its=1, block=8, rows=16)
    assert values == pytest.approx(np.linalg.svd(a, compute_uv=False), rel=1e-4)
    u = left(out, len(a))
    assert np.abs(u.T @ u - np.eye(8)).max() < 1e-8


def test_flat_spectrum_nulls_and_wrong_sizes(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 12))
    df = table(spark, a).unionByName(spark.createDataFrame([(1000, None)], "id long, vector array<double>"))
    out, values, _ = Z.block_lanczos(df, "id", "vector", k=3, its=5)
    assert values == pytest.approx(np.linalg.svd(a, compute_uv=False)[:3], rel=1e-6)
    assert out.where("id = 1000").count() == 0 and out.count() == 300
    zero, none, _ = Z.block_lanczos(table(spark, np.zeros((10, 4))), "id", "vector", k=2)
    assert none.tolist() == [0.0, 0.0] and np.isfinite(left(zero, 10)).all()
    with pytest.raises(ValueError, match="components"):
        Z.block_lanczos(table(spark, a), "id", "vector", k=20)
    with pytest.raises(ValueError, match="no vectors"):
        Z.block_lanczos(df.where("false"), "id", "vector")
