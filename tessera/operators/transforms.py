"""Transforms of many independent series held as arrays: Fourier, cosine, wavelets, filters, alignment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_map(df: DataFrame, column: str, outputs: list[str], fn: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Adds array columns outputs = fn(matrix), where a matrix holds a batch's series of one length as rows; null and empty series give null."""
    schema = df.select("*", *(F.lit(None).cast("array<double>").alias(o) for o in outputs)).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[column]
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            out = [np.empty(len(size), object) for _ in outputs]
            for n in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == n)
                for column_out, values in zip(out, fn(flat[begin[rows][:, None] + np.arange(n)]), strict=True):
                    for i, v in zip(rows.tolist(), values, strict=True):
                        column_out[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(o), pa.list_(pa.float64())) for o in out)], names=[*batch.schema.names, *outputs])

    return df.mapInArrow(task, schema)


def series_map(df: DataFrame, column: str, outputs: list[str], fn: Callable[[np.ndarray], tuple]) -> DataFrame:
    """matrix_map for a function of one series."""
    return matrix_map(df, column, outputs, lambda m: tuple(zip(*(fn(x) for x in m), strict=True)))


def dft(df: DataFrame, column: str, centred: bool = False, inverse: bool = False) -> DataFrame:
    """Adds re and im of the (centred) discrete Fourier transform of each series."""

    def fn(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.fft.ifftshift(x, axes=1) if centred else x
        y = np.fft.ifft(x) if inverse else np.fft.fft(x)
        y = np.fft.fftshift(y, axes=1) if centred else y
        return y.real, y.imag

    return matrix_map(df, column, ["re", "im"], fn)


def dct(values: Column, n: int) -> Column:
    """Orthonormal DCT-II of an array of n values, as an expression."""

    def term(k: Column) -> Column:
        total = F.aggregate(F.transform(values, lambda v, i: v.cast("double") * F.cos(math.pi * (2 * i + 1) * k / (2 * n))), F.lit(0.0), lambda s, v: s + v)
        return total * F.when(k == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), term)


def haar_step(values: Column) -> tuple[Column, Column]:
    """(approximation, detail) of an array of even length."""
    pairs = F.sequence(F.lit(1), F.size(values), F.lit(2))
    x, y = (lambda i: F.element_at(values, i)), (lambda i: F.element_at(values, i + 1))
    return F.transform(pairs, lambda i: (x(i) + y(i)) / math.sqrt(2)), F.transform(pairs, lambda i: (x(i) - y(i)) / math.sqrt(2))


#: Daubechies low-pass filter of four taps.
DAUBECHIES4 = (0.482962913144534, 0.836516303737808, 0.224143868042013, -0.129409522551260)


def wavelet_step(values: Column, taps: tuple[float, ...] = DAUBECHIES4) -> tuple[Column, Column]:
    """One periodised level: (approximation, detail) of an array of even length."""
    n = F.size(values)
    high = [(-1) ** j * h for j, h in enumerate(reversed(taps))]

    def filtered(filter_taps):
        return F.transform(F.sequence(F.lit(0), (n / 2 - 1).cast("int")), lambda k: sum((F.element_at(values, ((2 * k + j) % n + 1).cast("int")) * h for j, h in enumerate(filter_taps)), F.lit(0.0)))

    return filtered(taps), filtered(high)


def _analysis(x: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(taps))) % n
    high = taps[::-1] * (-1.0) ** np.arange(len(taps))
    return x[at] @ taps, x[at] @ high


def _synthesis(low: np.ndarray, high: np.ndarray, taps: np.ndarray) -> np.ndarray:
    n = 2 * len(low)
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(taps))) % n
    out = np.zeros(n)
    np.add.at(out, at, low[:, None] * taps)
    np.add.at(out, at, high[:, None] * (taps[::-1] * (-1.0) ** np.arange(len(taps))))
    return out


def threshold(high: np.ndarray, t: float, hard: bool) -> np.ndarray:
    return np.where(np.abs(high) > t, high, 0) if hard else np.sign(high) * np.maximum(np.abs(high) - t, 0)


def wavelet_denoise(df: DataFrame, column: str, levels: int = 3, factor: float = 3.0, hard: bool = False, out: str = "denoised", undecimated: bool = False) -> DataFrame:
    """Shrinks details at factor · median|finest detail| / 0.67, keeps the approximation.

    Series are mirrored at their end to a multiple of 2^levels and cut back. undecimated: every level keeps all places
    (filters with holes instead of halving), so that the result moves along with the series.
    """
    taps = np.array(DAUBECHIES4)
    high_taps = taps[::-1] * (-1.0) ** np.arange(len(taps))

    def decimated(x: np.ndarray) -> np.ndarray:
        details, low = [], x
        for _ in range(levels):
            low, high = _analysis(low, taps)
            details.append(high)
        t = factor * np.median(np.abs(details[0])) / 0.67
        for high in reversed(details):
            low = _synthesis(low, threshold(high, t, hard), taps)
        return low

    def everywhere(x: np.ndarray) -> np.ndarray:
        n, details, low = len(x), [], x
        for level in range(levels):
            at = (np.arange(n)[:, None] + np.arange(len(taps)) * 2**level) % n
            low, high = low[at] @ taps, low[at] @ high_taps
            details.append(high)
        t = factor * np.median(np.abs(details[0])) / 0.67
        for level in reversed(range(levels)):
            back = (np.arange(n)[:, None] - np.arange(len(taps)) * 2**level) % n
            low = (low[back] @ taps + threshold(details[level], t, hard)[back] @ high_taps) / 2
        return low

    def fn(x: np.ndarray) -> tuple[np.ndarray]:
        padded = np.pad(x, (0, -len(x) % (1 << levels)), mode="symmetric")
        return ((everywhere if undecimated else decimated)(padded)[: len(x)],)

    return series_map(df, column, [out], fn)


def wavelet_2d(df: DataFrame, column: str, width: int, levels: int = 1, inverse: bool = False, out: str = "coefficients") -> DataFrame:
    """Periodised 2-D wavelet transform of each series, read as rows of that width (or back): each level filters rows, then columns, of the block of approximations before it."""
    taps = np.array(DAUBECHIES4)

    def along(m: np.ndarray) -> np.ndarray:
        return np.stack([np.concatenate(_analysis(r, taps)) for r in m])

    def back(m: np.ndarray) -> np.ndarray:
        return np.stack([_synthesis(r[: len(r) // 2], r[len(r) // 2 :], taps) for r in m])

    def fn(x: np.ndarray) -> tuple[np.ndarray]:
        m = x.reshape(-1, width).copy()
        if width % (1 << levels) or len(m) % (1 << levels):
            raise ValueError(f"{len(m)} rows of {width} can't be halved {levels} times")
        for level in reversed(range(levels)) if inverse else range(levels):
            h, w = len(m) >> level, width >> level
            m[:h, :w] = back(back(m[:h, :w].T).T) if inverse else along(along(m[:h, :w]).T).T
        return (m.ravel(),)

    return series_map(df, column, [out], fn)


def wavelet_inverse(low: Column, high: Column, taps: tuple[float, ...] = DAUBECHIES4) -> Column:
    """The array of which wavelet_step gives (low, high), as an expression."""
    half = F.size(low)
    high_taps = [(-1) ** j * h for j, h in enumerate(reversed(taps))]

    def value(i: Column) -> Column:
        total = F.lit(0.0)
        for j in range(len(taps)):
            place = (F.pmod((i - j) / 2, half) + 1).cast("int")
            part = F.element_at(low, place) * taps[j] + F.element_at(high, place) * high_taps[j]
            total = total + F.when((i - j) % 2 == 0, part).otherwise(0.0)
        return total

    return F.transform(F.sequence(F.lit(0), 2 * half - 1), value)


def bandpass(df: DataFrame, column: str, low: float, high: float, rate: float = 1.0, out: str = "filtered") -> DataFrame:
    """First-order Butterworth band-pass, run forward and backward: no phase shift."""
    w0, w1 = (math.tan(math.pi * f / rate) for f in (low, high))
    band, centre = w1 - w0, w0 * w1
    norm = 1 + band + centre
    b, a1, a2 = band / norm, 2 * (centre - 1) / norm, (1 - band + centre) / norm

    def once(m: np.ndarray) -> np.ndarray:
        """All series of a matrix at once, sample by sample."""
        y = np.empty_like(m)
        x1 = x2 = y1 = y2 = np.zeros(len(m))
        for i in range(m.shape[1]):
            now = b * (m[:, i] - x2) - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = m[:, i], x1, now, y1
            y[:, i] = now
        return y

    return matrix_map(df, column, [out], lambda m: (once(once(m)[:, ::-1])[:, ::-1],))


def taut_string(x: np.ndarray, lam: float) -> np.ndarray:
    """Exact minimiser of ½‖z - x‖² + lam Σ|z_i+1 - z_i|: the taut string through the tube around the running sum."""
    n = len(x)
    total = np.concatenate([[0.0], np.cumsum(x)])
    upper, lower = total + lam, total - lam
    upper[0] = lower[0] = 0.0
    upper[n] = lower[n] = total[n]
    upper, lower = upper.tolist(), lower.tolist()
    z, start, level = np.empty(n), 0, 0.0
    while start < n:
        # the string leaves (start, level): follow the narrowest cone until it closes
        hi, lo, at_hi, at_lo, i = math.inf, -math.inf, start + 1, start + 1, start + 1
        while True:
            up, down = (upper[i] - level) / (i - start), (lower[i] - level) / (i - start)
            if down > hi:
                end, value = at_hi, upper[at_hi]
                break
            if up < lo:
                end, value = at_lo, lower[at_lo]
                break
            if up <= hi:
                hi, at_hi = up, i
            if down >= lo:
                lo, at_lo = down, i
            if i == n:
                end, value = n, upper[n]
                break
            i += 1
        z[start:end] = (value - level) / (end - start)
        start, level = end, value
    return z


def tv_denoise(df: DataFrame, column: str, lam: float, out: str = "denoised") -> DataFrame:
    """The taut string of each series."""
    return series_map(df, column, [out], lambda x: (taut_string(x, lam),))


def tv_denoise_2d(df: DataFrame, column: str, width: int, lam: float, out: str = "denoised") -> DataFrame:
    """Of each series, read as rows of that width, the mean of the taut strings along rows and along columns."""

    def fn(x: np.ndarray) -> tuple[np.ndarray]:
        if len(x) % width:
            raise ValueError(f"{len(x)} values aren't rows of {width}")
        m = x.reshape(-1, width)
        rows = np.stack([taut_string(r, lam) for r in m])
        columns = np.stack([taut_string(c, lam) for c in m.T], axis=1)
        return (((rows + columns) / 2).ravel(),)

    return series_map(df, column, [out], fn)


def band_power(df: DataFrame, column: str, low: float, high: float, rate: float) -> DataFrame:
    """Adds power: the sum of |DFT|² over frequencies in [low, high] Hz."""

    def fn(m: np.ndarray) -> tuple[np.ndarray]:
        f = np.fft.rfftfreq(m.shape[1], 1 / rate)
        inside = (f >= low) & (f <= high)
        return ((np.abs(np.fft.rfft(m)[:, inside]) ** 2).sum(1)[:, None],)

    return matrix_map(df, column, ["power"], fn).withColumn("power", F.element_at("power", 1))


def best_shift(df: DataFrame, key: str, column: str, reference: DataFrame, reach: int) -> DataFrame:
    """(key, shift, cost): the circular shift in [-reach, reach] with the least sum of squared differences to a reference series (one row)."""
    joined = df.select(key, F.col(column).alias("_x")).crossJoin(F.broadcast(reference.select(F.col(column).alias("_r"))))  # one row
    rows = joined.select(key, "_x", "_r", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"))
    n = F.size("_r")
    cost = F.aggregate(F.transform("_r", lambda r, i: F.pow(F.element_at("_x", (F.pmod(i + F.col("shift"), n) + 1).cast("int")).cast("double") - r.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    rows = rows.select(key, "shift", cost.alias("cost"))
    return rows.groupBy(key).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), F.abs("shift").alias("size"), "shift")).alias("b")).select(key, "b.shift", "b.cost")


def align(df: DataFrame, key: str, column: str, shifts: DataFrame) -> DataFrame:
    """df with each series moved circularly by its shift of best_shift (key, shift, ...)."""
    n = F.size(column)
    moved = F.transform(column, lambda _, i: F.element_at(column, (F.pmod(i + F.col("shift"), n) + 1).cast("int")))
    return df.join(shifts.select(key, "shift"), key).withColumn(column, moved)


def dominant_component(df: DataFrame, column: str, modes: int, low: float, high: float, rate: float) -> DataFrame:
    """Adds component: of the leading principal components, the one whose scores along df's series have the largest amplitude in a band.

    df: (series, seq, column array); one row per series with the component and its amplitude.
    """
    from .vectors import pca

    projected, _modes, _values = pca(df, column, modes, "_p")
    rows = projected.select("series", "seq", F.posexplode("_p").alias("component", "score"))
    ordered = rows.groupBy("series", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "score"))), lambda r: r["score"]).alias("_s"))  # one series' scores

    def amplitude(x: np.ndarray) -> tuple[np.ndarray]:
        f = np.fft.rfftfreq(len(x), 1 / rate)
        inside = np.abs(np.fft.rfft(x)[(f >= low) & (f <= high)])
        return (np.array([inside.max() if len(inside) else 0.0]),)

    scored = series_map(ordered, "_s", ["_a"], amplitude).withColumn("amplitude", F.element_at("_a", 1))
    return scored.groupBy("series").agg(F.max_by(F.struct("component", "amplitude"), F.struct(F.round("amplitude", 9), -F.col("component"))).alias("b")).select("series", "b.*")


def component_signal(df: DataFrame, column: str, modes: int, low: float, high: float, rate: float) -> DataFrame:
    """(series, component, seq, signal): of each series' dominant component, the band-limited scores' analytic signal, real part less imaginary part."""
    from .vectors import pca

    best = dominant_component(df, column, modes, low, high, rate).select("series", "component")
    projected, _modes, _values = pca(df, column, modes, "_p")
    rows = projected.join(best, "series").select("series", "component", "seq", F.element_at("_p", F.col("component") + 1).alias("score"))
    ordered = rows.groupBy("series", "component").agg(F.array_sort(F.collect_list(F.struct("seq", "score"))).alias("_r"))  # one series' scores
    ordered = ordered.select("series", "component", F.transform("_r", lambda r: r["seq"]).alias("_q"), F.transform("_r", lambda r: r["score"]).alias("_s"))

    def signal(x: np.ndarray) -> tuple[np.ndarray]:
        f = np.fft.fftfreq(len(x), 1 / rate)
        z = np.fft.ifft(np.where((f >= low) & (f <= high), 2 * np.fft.fft(x), 0))
        return (z.real - z.imag,)

    out = series_map(ordered, "_s", ["_z"], signal)
    return out.select("series", "component", F.explode(F.arrays_zip(F.col("_q").alias("seq"), F.col("_z").alias("signal"))).alias("r")).select("series", "component", "r.seq", "r.signal")
