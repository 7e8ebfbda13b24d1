"""Window rows and their Gramian against plain loops."""

import numpy as np
import pytest

from tessera.operators import windows as W


def table(spark, x, skip=lambda i, j, c: False):
    rows = [(int(i), int(j), f"c{c}", float(v)) for (c, i, j), v in np.ndenumerate(x) if not skip(i, j, c)]
    return spark.createDataFrame(rows, "r int, c int, ch string, v double")


def windows(x, h, w):
    return np.array([x[:, i : i + h, j : j + w].ravel() for i in range(x.shape[1] - h + 1) for j in range(x.shape[2] - w + 1)])


@pytest.mark.parametrize(("shape", "window", "tile"), [((2, 13, 11), (3, 3), 4), ((2, 13, 11), (3, 2), 256), ((1, 5, 9), (3, 4), 3), ((3, 4, 4), (4, 4), 2), ((1, 6, 7), (1, 1), 4), ((2, 3, 20), (2, 5), 6)])
def test_gram_of_all_windows(spark, shape, window, tile):
    x = np.random.default_rng(1).normal(size=shape)
    m = windows(x, *window)
    names, gram = W.window_gram(table(spark, x), "r", "c", "ch", "v", *window, tile=tile)
    assert names == [f"c{i}" for i in range(shape[0])]
    assert np.allclose(gram, m.T @ m)


def test_window_rows(spark):
    x = np.random.default_rng(2).normal(size=(2, 5, 6))
    got = {(r["r"], r["c"]): r["window"] for r in W.window_rows(table(spark, x), "r", "c", "ch", "v", 3, 2).collect()}
    assert len(got) == 3 * 5
    assert np.allclose([got[k] for k in sorted(got)], windows(x, 3, 2))


def test_absent_cells_nulls_repeats_and_small_grids(spark):
    x = np.random.default_rng(3).normal(size=(2, 8, 8))
    hole = lambda i, j, c: (i * 8 + j + c) % 3 == 0 and (i, j) != (7, 7)
    y = x.copy()
    for c, i, j in np.ndindex(x.shape):
        if hole(i, j, c):
            y[c, i, j] = 0
    y[0, 2, 3] += 1.5
    df = table(spark, x, hole).unionByName(spark.createDataFrame([(2, 3, "c0", 1.5), (4, 4, "c0", None), (None, 1, "c0", 9.0)], "r int, c int, ch string, v double"))
    m = windows(y, 3, 3)
    assert np.allclose(W.window_gram(df, "r", "c", "ch", "v", 3, 3, tile=4)[1], m.T @ m)
    assert not W.window_gram(df, "r", "c", "ch", "v", 9, 2)[1].any()
    assert W.window_gram(df.where("false"), "r", "c", "ch", "v", 3, 3)[1].shape == (0, 0)
