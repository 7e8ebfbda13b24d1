"""Operators over many independent ordered series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(series: str, *order: str) -> WindowSpec:
    return Window.partitionBy(series).orderBy(*order)


def local_max(value: str, w: WindowSpec, threshold: float | None = None) -> Column:
    """Above both neighbours; borders never are."""
    x = F.col(value)
    peak = (x > F.lag(x).over(w)) & (x > F.lead(x).over(w))
    peak = peak if threshold is None else peak & (x >= threshold)
    return F.coalesce(peak, F.lit(False))


def forward_difference(value: str, w: WindowSpec) -> Column:
    """Next minus this; 0 at the end."""
    return F.coalesce(F.lead(value).over(w) - F.col(value), F.lit(0.0))


def gaussian_taps(length: int) -> dict[int, float]:
    half = length // 2
    raw = {i: math.exp(-0.5 * (6 * i / length) ** 2) for i in range(-half, half + 1)}
    total = sum(raw.values())
    return {i: v / total for i, v in raw.items()}


def smooth(value: str, w: WindowSpec, taps: dict[int, float]) -> Column:
    """Convolution of the same size, zero padded; for kernels of a few dozen taps."""
    out = F.lit(0.0)
    for i, weight in taps.items():
        shifted = F.col(value) if i == 0 else F.lead(value, i, 0.0).over(w) if i > 0 else F.lag(value, -i, 0.0).over(w)
        out = out + shifted * weight
    return out


def remove_bias(value: str, series: str, least: float = 1e-4) -> Column:
    mean = F.avg(value).over(Window.partitionBy(series))
    return F.when(F.abs(mean) > least, F.col(value) - mean).otherwise(F.col(value))


def clip_outliers(df: DataFrame, series: str, value: str, sigmas: float = 4.5, rounds: int = 2) -> DataFrame:
    """Rounds of clipping to ± sigmas standard deviations, bias removed before and after."""
    df = df.withColumn(value, remove_bias(value, series))
    for _ in range(rounds):
        limit = F.stddev(value).over(Window.partitionBy(series)) * sigmas
        df = df.withColumn("_limit", limit).withColumn(value, F.when(F.abs(value) > F.col("_limit"), F.signum(value) * F.col("_limit")).otherwise(F.col(value))).drop("_limit")
    return df.withColumn(value, remove_bias(value, series))


def find_peaks(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Rise-then-fall points; one below mean/1.5 whose gap to the next is below the mean gap goes; the last stays."""
    peaks = df.where(F.col(value).isNotNull()).withColumn("_peak", local_max(value, along(series, order))).where("_peak").drop("_peak")
    w, every = along(series, order), Window.partitionBy(series)
    peaks = peaks.withColumn("_gap", F.lead(order).over(w) - F.col(order))
    low = (F.col(value) < F.avg(value).over(every) / 1.5) & (F.col("_gap") < F.avg("_gap").over(every))
    return peaks.withColumn("_low", F.coalesce(low, F.lit(False))).where("not _low").drop("_gap", "_low")


def refractory(df: DataFrame, series: str, order: str, least: float) -> DataFrame:
    """Drops events that follow another within least; intervals are those before any drop."""
    gap = F.col(order) - F.lag(order).over(along(series, order))
    return df.withColumn("_gap", gap).where((F.col("_gap") > least) | F.col("_gap").isNull()).drop("_gap")


def phase_of(df: DataFrame, events: DataFrame, series: str, order: str, phases: int, split: Column | None = None) -> DataFrame:
    """Phase 0..phases-1 of each sample in its interval between events; 0 outside.

    split: share of the interval (by its length column `interval`) that the first half of the phases takes; linear without.
    """
    marks = df.withColumn("_event", F.lit(None).cast("double")).unionByName(events.select(series, F.col(order), F.col(order).cast("double").alias("_event")), allowMissingColumns=True)
    w = Window.partitionBy(series).orderBy(order, F.col("_event").isNull())
    marks = marks.withColumns({
        "_from": F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_to": F.first("_event", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "_is": F.col("_event").isNotNull(),
    }).where("not _is")
    marks = marks.withColumn("interval", F.col("_to") - F.col("_from"))
    share = (F.col(order) - F.col("_from")) / F.col("interval")
    if split is not None:
        share = F.when(share < split, share / split / 2).otherwise(0.5 + (share - split) / (1 - split) / 2)
    phase = F.least(F.floor(share * phases), F.lit(phases - 1))
    return marks.withColumn("phase", F.coalesce(phase, F.lit(0)).cast("int")).drop("_event", "_from", "_to", "_is", "interval")


def interpolate(knots: DataFrame, raster: DataFrame, series: str, x: str, y: str) -> DataFrame:
    """Piecewise linear values of knots (series, x, y) at raster (series, x); the end segments extend."""
    w = along(series, x)
    k = knots.select(series, x, y).withColumns({"_x1": F.lead(x).over(w), "_y1": F.lead(y).over(w), "_x0": F.lag(x).over(w), "_y0": F.lag(y).over(w)})
    knot = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("_x1").alias("x1"), F.col("_y1").alias("y1"), F.col("_x0").alias("x0"), F.col("_y0").alias("y0"))
    both = k.select(series, x, knot.alias("_k")).unionByName(raster.select(series, x).withColumn("_k", F.lit(None).cast("struct<x:double,y:double,x1:double,y1:double,x0:double,y0:double>")))
    order = Window.partitionBy(series).orderBy(x, F.col("_k").isNull())
    both = both.withColumns({"_at": F.last("_k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.first("_k", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("_k is null")
    s = F.coalesce("_at", "_first")
    right, left = s["x1"].isNotNull(), s["x0"].isNotNull()
    slope = F.when(right, (s["y1"] - s["y"]) / (s["x1"] - s["x"])).when(left, (s["y"] - s["y0"]) / (s["x"] - s["x0"])).otherwise(0.0)
    return both.select(series, x, (s["y"] + slope * (F.col(x) - s["x"])).alias(y))


def robust_normalise(df: DataFrame, series: str, order: list[str], value: str, low: float = 0.1, high: float = 0.8) -> DataFrame:
    every = Window.partitionBy(series)
    df = df.withColumn("_p", F.row_number().over(along(series, *order)) / F.count("*").over(every))
    inner = F.when((F.col("_p") > low) & (F.col("_p") <= high), F.col(value))
    lo, hi = F.min(inner).over(every), F.max(inner).over(every)
    return df.withColumn(value, (F.col(value) - lo) / (hi - lo)).drop("_p")


def runs(df: DataFrame, series: str, seq: str, flag: Column) -> DataFrame:
    """(series, begin, end) of each run of consecutive rows where flag holds; seq counts rows of the series."""
    marked = df.withColumn("_on", flag).where("_on")
    island = F.col(seq) - F.row_number().over(along(series, seq))
    return marked.withColumn("_island", island).groupBy(series, "_island").agg(F.min(seq).alias("begin"), F.max(seq).alias("end")).drop("_island")


def moving_median(value: str, w: WindowSpec, width: int, total: Column, place: Column) -> Column:
    """Median of width samples around each, border values repeated; place counts from 1."""
    half = width // 2
    values = F.collect_list(value).over(w.rowsBetween(-half, half))
    before, after = F.greatest(F.lit(half) - place + 1, F.lit(0)), F.greatest(place + half - total, F.lit(0))
    padded = F.concat(F.array_repeat(F.element_at(values, 1), before.cast("int")), values, F.array_repeat(F.element_at(values, -1), after.cast("int")))
    ordered = F.array_sort(padded)
    return F.element_at(ordered, half + 1)


def sliding(value: str, w: WindowSpec, width: int) -> Column:
    """The width samples from here on, null where the series ends before."""
    values = F.collect_list(value).over(w.rowsBetween(0, width - 1))
    return F.when(F.size(values) == width, values)
