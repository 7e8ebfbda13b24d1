"""Sliding windows over grids with several channels, as rows or as the Gramian of all of them.

The Gramian's entries are sums of lag products: for components (channel, dx, dy) and (channel', dx', dy') the product of two cells a
fixed lag apart, over all places where a window fits. Only the border rows and columns differ between entries of one lag,
so products are summed by lag and by how near they are to each border, and entries are put together from these few sums; no
window is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

TILE = 256


def window_rows(df: DataFrame, row: str, col: str, channel: str, value: str, height: int, width: int) -> DataFrame:
    """(row, col, window): for each place where a window fits, its cells by channel, then row, then column; absent cells count as 0.

    df: (row, col, channel, value) with keys from 0; the grid reaches to the largest keys, over all channels.
    """
    ends = df.agg(F.max(row).alias("_r"), F.max(col).alias("_c"))  # one row
    names = sorted(r[0] for r in df.select(channel).distinct().collect())  # channels of a measurement
    shifts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(height) for j in range(width)))
    places = df.crossJoin(F.broadcast(ends)).withColumn("_s", F.explode(shifts)).select((F.col(row) - F.col("_s.i")).alias(row), (F.col(col) - F.col("_s.j")).alias(col), channel, F.col("_s").alias("s"), F.col(value).alias("v"), "_r", "_c")
    fits = places.where((F.col(row) >= 0) & (F.col(col) >= 0) & (F.col(row) + height - 1 <= F.col("_r")) & (F.col(col) + width - 1 <= F.col("_c")))
    cells = [F.coalesce(F.sum(F.when((F.col(channel) == n) & (F.col("s.i") == i) & (F.col("s.j") == j), F.col("v"))), F.lit(0.0)) for n in names for i in range(height) for j in range(width)]
    return fits.groupBy(row, col).agg(F.array(*cells).alias("window"))


def border_class(at: np.ndarray, size: int, k: int) -> np.ndarray:
    """0 to k - 2 from the low end, k - 1 inside, k to 2k - 2 near the high end: places of one class are in the same windows' reach.

    In grids of fewer than 2k - 1 rows both ends are near, so the class is the place itself."""
    if size < 2 * k - 1:
        return at
    high = size - 1 - at
    return np.where(at < k - 1, at, np.where(high < k - 1, 2 * k - 2 - high, k - 1))


def covered(classes: int, size: int, k: int, shift: int) -> np.ndarray:
    """Which classes hold places shift to shift + size - k, the reach of a window's component."""
    if size < 2 * k - 1:
        at = np.arange(classes)
    else:
        at = np.concatenate([np.arange(k - 1), [k - 1], size - 1 - np.arange(k - 1)[::-1]])
    inside = (at >= shift) & (at <= shift + size - k)
    if size >= 2 * k - 1:
        inside[k - 1] = True  # the inner places are in every component's reach
    return inside


def window_gram(df: DataFrame, row: str, col: str, channel: str, value: str, height: int, width: int, tile: int = TILE) -> tuple[list, np.ndarray]:
    """(channels, Gramian of window_rows' windows, in their order of components).

    Tiles of the grid get a halo of the window's size; a task sums a tile's lag products by border class, and only these sums leave
    it. Null values and absent cells count as 0; several rows of a cell are added up; grids smaller than the window give zeros.
    """
    held = df.where(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(channel).isNotNull()).groupBy(F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"), F.col(channel).alias("ch")).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).cast("double").alias("v"))
    held = materialize(held, "cells")
    ends = held.agg(F.max("r"), F.max("c")).first()
    names = sorted(r[0] for r in held.select("ch").distinct().collect())  # channels of a measurement
    size = len(names) * height * width
    if not names:
        return [], np.zeros((0, 0))
    rows, cols = int(ends[0]) + 1, int(ends[1]) + 1
    if rows < height or cols < width:
        return names, np.zeros((size, size))
    number = {n: i for i, n in enumerate(names)}
    lags = [(x, y) for x in range(height) for y in range(-width + 1, width) if x or y >= 0]
    pairs = [(a, b) for a in range(len(names)) for b in range(len(names))]
    n_r, n_c = (2 * height - 1 if rows >= 2 * height - 1 else rows), (2 * width - 1 if cols >= 2 * width - 1 else cols)

    def task(table: pa.Table) -> pa.Table:
        tr, tc = table["tr"][0].as_py() * tile, table["tc"][0].as_py() * tile
        # the tile with its halo: rows below, columns on both sides
        x = np.zeros((len(names), tile + height - 1, tile + 2 * (width - 1)))
        at = table["r"].to_numpy() - tr, table["c"].to_numpy() - tc + width - 1
        x[[number[n] for n in table["ch"].to_pylist()], at[0], at[1]] = table["v"].to_numpy()
        rc = border_class(np.minimum(np.arange(tr, tr + tile), rows - 1), rows, height)
        cc = border_class(np.minimum(np.arange(tc, tc + tile), cols - 1), cols, width)
        by_row, by_col = np.eye(n_r)[:, rc], np.eye(n_c)[:, cc]
        out = np.zeros((len(pairs), len(lags), n_r, n_c))
        for p, (a, b) in enumerate(pairs):
            own = x[a, :tile, width - 1 : width - 1 + tile]
            for q, (dx, dy) in enumerate(lags):
                out[p, q] = by_row @ (own * x[b, dx : dx + tile, width - 1 + dy : width - 1 + dy + tile]) @ by_col.T
        flat = out.ravel()
        some = np.flatnonzero(flat)
        return pa.table({"at": pa.array(some, pa.int64()), "v": pa.array(flat[some], pa.float64())})

    low_r, high_r = F.greatest(F.floor((F.col("r") - height + 1) / tile), F.lit(0)), F.floor(F.col("r") / tile)
    low_c, high_c = F.greatest(F.floor((F.col("c") - width + 1) / tile), F.lit(0)), F.floor((F.col("c") + width - 1) / tile)
    tiles = held.withColumn("tr", F.explode(F.sequence(low_r.cast("long"), high_r.cast("long")))).withColumn("tc", F.explode(F.sequence(low_c.cast("long"), high_c.cast("long"))))
    sums = np.zeros(len(pairs) * len(lags) * n_r * n_c)
    for at, v in tiles.groupBy("tr", "tc").applyInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v")).collect():  # one row a pair, lag and class
        sums[at] = v
    sums = sums.reshape(len(names), len(names), len(lags), n_r, n_c)
    lag_at = {lag: i for i, lag in enumerate(lags)}
    gram = np.zeros((size, size))
    parts = [(a, i, j) for a in range(len(names)) for i in range(height) for j in range(width)]
    for p, (a, i, j) in enumerate(parts):
        for q, (b, i2, j2) in enumerate(parts):
            lag = (i2 - i, j2 - j)
            if lag in lag_at:
                inside = sums[a, b, lag_at[lag]][covered(n_r, rows, height, i)][:, covered(n_c, cols, width, j)]
                gram[p, q] = gram[q, p] = inside.sum()
    return names, gram
