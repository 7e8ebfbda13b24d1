"""Series of any length: blocks of consecutive rows that meet only what they need of other blocks.

Rows get their place in the series from a range-partitioned order, and places are cut into blocks of a fixed number of rows, so
no task holds a series. A function of near neighbours gets a halo: rows near a border are also sent to the block beyond it.
What may reach arbitrarily far (a filter's state, the last knot) is reduced to a few numbers a block, carried along the
blocks of the series, and handed to each block as it begins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.prefix import global_row_number
from tessera.plans.scratch import materialize

ROWS = 8192


def placed(df: DataFrame, series: str, order: list[str | Column]) -> DataFrame:
    """Adds place (0, 1, ... in the series, nulls first) and total (rows of the series); the order must be total within a series.

    Written once. Rows of a null series are one series.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    numbered = materialize(global_row_number(df, [F.col(series), *by], "_at"), "numbered")
    starts = numbered.groupBy(series).agg(F.min("_at").alias("_start"), F.count("*").alias("total")).withColumnRenamed(series, "_series")
    # a long series' one row is met by broadcast or by a join that is split; its rows don't gather
    return numbered.join(starts, F.col(series).eqNullSafe(F.col("_series"))).withColumn("place", F.col("_at") - F.col("_start")).drop("_at", "_start", "_series")


def with_halo(df: DataFrame, before: int, after: int, rows: int = ROWS) -> DataFrame:
    """placed rows, each in every block that needs it (column block): its own, and those it lies at most before rows ahead of or
    after rows behind of."""
    last = F.floor((F.col("total") - 1) / rows)
    low = F.greatest(F.floor((F.col("place") - after) / rows), F.lit(0))
    high = F.least(F.floor((F.col("place") + before) / rows), last)
    return df.withColumn("block", F.explode(F.sequence(low.cast("long"), high.cast("long"))))


def in_blocks(df: DataFrame, series: str, keep: list[str], value: str, before: int, after: int, fn: Callable[[np.ndarray, int, int], np.ndarray], out: str, edges: str | None = None, rows: int = ROWS) -> DataFrame:
    """placed rows -> (keep..., out): fn(values with before more in front and after more behind, before, after) gives one number for each own row.

    Beyond the ends of a series stand zeros, or for edges='repeat' its first and last value. A null value is NaN to fn, and a NaN result is null.
    """
    carried = [c for c in dict.fromkeys([series, *keep]) if c not in ("place", "total")]
    sent = with_halo(df.select(*carried, F.col(value).cast("double").alias("_v"), "place", "total"), before, after, rows)

    def task(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("place", "ascending")]))
        place, block, total = table["place"].to_numpy(), table["block"][0].as_py(), table["total"][0].as_py()
        x = table["_v"].to_numpy()
        first, end = block * rows, min((block + 1) * rows, total)
        mode = {"mode": "edge"} if edges == "repeat" else {"mode": "constant"}
        front, back = max(before - (first - int(place[0])), 0), max(after - (int(place[-1]) + 1 - end), 0)
        y = np.asarray(fn(np.pad(x, (front, back), **mode), before, after), float)
        own = table.slice(first - int(place[0]), end - first)
        return own.select(keep).append_column(out, pa.array(y, pa.float64(), from_pandas=True))

    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keep) + f", `{out}` double"
    return sent.groupBy(series, "block").applyInArrow(task, schema)


def smooth(df: DataFrame, series: str, keep: list[str], value: str, taps: dict[int, float], out: str = "y", rows: int = ROWS) -> DataFrame:
    """Convolution of the same size, zero padded; taps by offset."""
    before, after = max(0, -min(taps)), max(0, max(taps))

    def fn(x: np.ndarray, b: int, a: int) -> np.ndarray:
        n = len(x) - b - a
        y = np.zeros(n)
        for i, weight in taps.items():
            y += weight * x[b + i : b + i + n]
        return y

    return in_blocks(df, series, keep, value, before, after, fn, out, rows=rows)


def moving_median(df: DataFrame, series: str, keep: list[str], value: str, width: int, out: str = "y", rows: int = ROWS) -> DataFrame:
    """Median of width (odd) samples around each, border values repeated."""
    half = width // 2
    return in_blocks(df, series, keep, value, half, half, lambda x, _b, _a: np.median(np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1), axis=1), out, "repeat", rows)


def _neighbour(df: DataFrame, series: str, keep: list[str], value: str, offset: int, out: str, rows: int) -> DataFrame:
    """The value offset rows further on, null beyond the series."""
    before, after = max(0, -offset), max(0, offset)

    def fn(x: np.ndarray, b: int, a: int) -> np.ndarray:
        return x[b + offset : len(x) - a + offset]

    got = in_blocks(df, series, [*keep, "place", "total"], value, before, after, fn, out, rows=rows)
    beyond = (F.col("place") + offset < 0) | (F.col("place") + offset >= F.col("total"))
    return got.withColumn(out, F.when(~beyond, F.col(out)))


def find_peaks(df: DataFrame, series: str, order: str, value: str, keep: list[str], rows: int = ROWS) -> DataFrame:
    """As series.find_peaks, over placed rows without null values: (keep...) of the peaks that stay. order is a number that rises along the series."""

    def peak(x: np.ndarray, _b: int, _a: int) -> np.ndarray:
        return ((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])).astype(float)

    columns = list(dict.fromkeys([series, *keep, order, value]))
    marked = in_blocks(df, series, [*columns, "place", "total"], value, 1, 1, peak, "_peak", rows=rows)
    inner = (F.col("place") > 0) & (F.col("place") < F.col("total") - 1)
    peaks = placed(marked.where(inner & (F.col("_peak") > 0)).select(*columns), series, [order])
    ahead = materialize(_neighbour(peaks, series, columns, order, 1, "_next", rows).withColumn("_gap", F.col("_next") - F.col(order)), "peaks")
    means = ahead.groupBy(F.col(series).alias("_series")).agg(F.avg(value).alias("_mean"), F.avg("_gap").alias("_mean_gap"))
    met = ahead.join(means, F.col(series).eqNullSafe(F.col("_series")))
    low = F.coalesce((F.col(value) < F.col("_mean") / 1.5) & (F.col("_gap") < F.col("_mean_gap")), F.lit(False))
    return met.where(~low).select(*keep)


def _carried(summaries: DataFrame, series: str, step: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """One row a block -> one row a block, along each series; a series' summaries meet in one task, one for ROWS rows of it."""

    def task(table: pa.Table) -> pa.Table:
        order = table.sort_by([("block", "ascending")])
        got = step(order.to_pylist())
        names = [c.split()[0].strip("`") for c in schema.split(", ")]
        kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        types = [kinds.get(c.split()[1], None) for c in schema.split(", ")]
        key = order[series]
        return pa.table([key if n == "_series" else pa.array([r[n] for r in got], t) for n, t in zip(names, types, strict=True)], names=names)

    return summaries.groupBy(series).applyInArrow(task, schema)


def _pass(blocks: DataFrame, kind: str, b: np.ndarray, a: np.ndarray, backward: bool) -> DataFrame:
    """One run of a filter over (series, block, place, x): y beside them. Second order, transposed form: the state after a row is
    m · state + n · x, so a block's is m^rows · state + what it gives from rest."""
    m = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    sign = -1 if backward else 1

    def run(x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, z0, z1 = [], float(state[0]), float(state[1])
        for v in (x[::sign]).tolist():
            w = b[0] * v + z0
            z0, z1 = b[1] * v + z1 - a[1] * w, b[2] * v - a[2] * w
            y.append(w)
        return np.array(y)[::sign], np.array([z0, z1])

    def rest(batches):
        for batch in batches:
            ends = [run(np.array(x), np.zeros(2))[1].tolist() for x in batch["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["series"], batch["block"], batch["n"], pa.array(ends, pa.list_(pa.float64()))], ["series", "block", "n", "end"])

    def along(rows: list[dict]) -> list[dict]:
        state, out = np.zeros(2), {}
        for r in rows[::sign]:
            out[r["block"]] = {"block": r["block"], "state": state.tolist()}
            state = np.linalg.matrix_power(m, r["n"]) @ state + np.array(r["end"])
        return [out[r["block"]] for r in rows]

    ends = blocks.select("series", "block", "n", "x").mapInArrow(rest, f"series {kind}, block long, n long, end array<double>")
    states = _carried(ends, "series", along, f"_series {kind}, block long, state array<double>")

    def apply(batches):
        for batch in batches:
            y = [run(np.array(x), np.array(s))[0].tolist() for x, s in zip(batch["x"].to_pylist(), batch["state"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("series", "block", "n", "places")), pa.array(y, pa.list_(pa.float64()))], ["series", "block", "n", "places", "x"])

    met = blocks.join(states.withColumnRenamed("block", "_block"), F.col("series").eqNullSafe(F.col("_series")) & (F.col("block") == F.col("_block")))
    return materialize(met.select("series", "block", "n", "places", "x", "state").mapInArrow(apply, f"series {kind}, block long, n long, places array<long>, x array<double>"), "filtered")


def butterworth(low: float, high: float, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the first-order band-pass."""
    w0, w1 = (math.tan(math.pi * f / rate) for f in (low, high))
    band, centre = w1 - w0, w0 * w1
    norm = 1 + band + centre
    return np.array([band, 0.0, -band]) / norm, np.array([1.0, 2 * (centre - 1) / norm, (1 - band + centre) / norm])


def bandpass(df: DataFrame, series: str, value: str, low: float, high: float, rate: float = 1.0, rows: int = ROWS) -> DataFrame:
    """placed rows -> (series, place, filtered): first-order Butterworth band-pass, forward and backward from rest, exact over all blocks.

    A null value counts as 0.
    """
    b, a = butterworth(low, high, rate)
    kind = dict(df.dtypes)[series]
    held = df.select(F.col(series).alias("series"), F.floor(F.col("place") / rows).alias("block"), "place", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    packed = held.groupBy("series", "block").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("s"))  # at most `rows` of them
    blocks = materialize(packed.select("series", "block", F.size("s").cast("long").alias("n"), F.col("s.place").alias("places"), F.col("s.v").alias("x")), "blocks")
    for backward in (False, True):
        blocks = _pass(blocks, kind, b, a, backward)
    return blocks.select(F.col("series").alias(series), F.explode(F.arrays_zip("places", "x")).alias("r")).select(series, F.col("r.places").alias("place"), F.col("r.x").alias("filtered"))


def interpolate(knots: DataFrame, raster: DataFrame, series: str, x: str, y: str, rows: int = ROWS) -> DataFrame:
    """As series.interpolate, for knots and rasters of any length: each block gets the two knots before it and the two after it.

    Knots of one series have different x; without knots values are null, with one they are its own.
    """
    kind = dict(knots.dtypes)[series]
    both = knots.select(series, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(0).alias("later")).unionByName(raster.select(series, F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("later")))
    at = materialize(placed(both, series, ["x", "later"]).withColumn("block", F.floor(F.col("place") / rows)), "marks")
    knot = F.when(F.col("later") == 0, F.struct("x", "y"))
    ends = at.groupBy(F.col(series).alias("series"), "block").agg(F.array_sort(F.collect_list(knot)).alias("k")).select("series", "block", F.flatten(F.transform(F.slice("k", 1, 2), lambda s: F.array(s["x"], s["y"]))).alias("first"), F.flatten(F.transform(F.slice("k", F.greatest(F.size("k") - 1, F.lit(1)), F.lit(2)), lambda s: F.array(s["x"], s["y"]))).alias("last"))

    def along(items: list[dict]) -> list[dict]:
        out, seen = [{"block": r["block"]} for r in items], []
        for r, o in zip(items, out, strict=True):
            o["left"] = [v for k in seen for v in k]
            seen = [*seen, *zip(r["last"][::2], r["last"][1::2], strict=True)][-2:]
        seen = []
        for r, o in zip(items[::-1], out[::-1], strict=True):
            o["right"] = [v for k in seen for v in k]
            seen = [*zip(r["first"][::2], r["first"][1::2], strict=True), *seen][:2]
        return out

    carried = _carried(ends, "series", along, f"_series {kind}, block long, left array<double>, right array<double>")

    def fill(mine: pa.Table, carry: pa.Table) -> pa.Table:
        later, px, py = mine["later"].to_numpy(), mine["x"].to_numpy(), mine["y"].to_numpy()
        outer = np.array([*carry["left"][0].as_py(), *carry["right"][0].as_py()]).reshape(-1, 2)
        kx = np.concatenate([outer[:, 0], px[later == 0]])
        order = np.argsort(kx, kind="stable")
        kx, ky = kx[order], np.concatenate([outer[:, 1], py[later == 0]])[order]
        q = px[later == 1]
        if len(kx) > 1:
            i = np.clip(np.searchsorted(kx, q, "right") - 1, 0, len(kx) - 2)
            v = ky[i] + (ky[i + 1] - ky[i]) / (kx[i + 1] - kx[i]) * (q - kx[i])
        else:
            v = np.full(len(q), ky[0] if len(kx) else np.nan)
        asked = mine.filter(pa.array(later == 1)).select([series, "x"])
        return asked.append_column("y", pa.array(v, pa.float64(), from_pandas=True))

    mine = at.select(series, "block", "x", "y", "later")
    filled = mine.groupBy(series, "block").cogroup(carried.groupBy("_series", "block")).applyInArrow(fill, f"`{series}` {kind}, x double, y double")
    return filled.select(series, F.col("x").alias(x), F.col("y").alias(y))
