"""Exact quantiles of many groups at once, by counting instead of sorting.

Doubles become whole numbers of the same order; pass by pass the next bits of the wanted value are found from how many values of
the group have each of them, among those that agree with it so far. A pass is one aggregation that combines before it
shuffles, so a group that holds most rows is no larger task than any other, and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

#: Bits of a pass; groups whose targets are broadcast.
BITS, FEW_GROUPS = 13, 200_000


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of x; -0 equals 0."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-1 << 63), bits)


def keyed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(g, v, key): rows with null or NaN left out; g is a struct of the group's columns, so that null is a group."""
    held = df.select(F.struct(*group).alias("g") if group else F.struct(F.lit(0).alias("one")).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["v"].to_numpy(zero_copy_only=False) + 0.0
            yield pa.RecordBatch.from_arrays([b["g"], pa.array(v, pa.float64()), pa.array(ordered_bits(v), pa.int64())], ["g", "v", "key"])

    return materialize(held.mapInArrow(task, f"g {dict(held.dtypes)['g']}, v double, key long"), "keys")


def ranked_values(keys: DataFrame, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """keys (g, v, key) and wanted (g, rank: 1 for the least) -> (g, rank, v): the value of that rank in the group."""
    # one row a group and rank: its rank among the values that agree with the prefix
    targets = wanted.select("g", "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    shift = 64
    while shift > 0:
        known, shift = shift, max(0, shift - bits)
        few = targets.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
        # arithmetic shifts keep the order of negative keys; before the first pass everything agrees
        agrees = F.lit(True) if known == 64 else F.shiftright("key", known) == F.col("prefix")
        met = keys.join(F.broadcast(targets) if few else targets, "g").where(agrees)
        counts = met.groupBy("g", "rank", "left", F.shiftright("key", shift).alias("next")).agg(F.count("*").alias("n"))
        along = Window.partitionBy("g", "rank").orderBy("next")  # at most 2^bits rows
        found = counts.withColumn("through", F.sum("n").over(along)).where("through >= left AND through - n < left")
        targets = materialize(found.select("g", "rank", (F.col("left") - F.col("through") + F.col("n")).alias("left"), F.col("next").alias("prefix")), "targets")
    last = F.broadcast(targets) if targets.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else targets
    return keys.join(last, (keys.g == targets.g) & (F.col("key") == F.col("prefix"))).groupBy(targets.g.alias("g"), "rank").agg(F.min("v").alias("v"))


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], bits: int = BITS) -> DataFrame:
    """(group columns, share, quantile): linear between the two nearest ranks, as SQL's quantile_cont; groups without values have no rows."""
    keys = keyed(df, group, value)
    sizes = materialize(keys.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    at = sizes.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares))))).withColumn("at", F.col("share") * (F.col("n") - 1))
    at = materialize(at.select("g", "share", (F.floor("at") + 1).alias("low"), (F.ceil("at") + 1).alias("high"), (F.col("at") - F.floor("at")).alias("part")), "places")
    wanted = at.select("g", F.col("low").alias("rank")).union(at.select("g", F.col("high").alias("rank"))).distinct()
    values = materialize(ranked_values(keys, wanted, bits), "ranked")
    out = at.join(values.select("g", F.col("rank").alias("low"), F.col("v").alias("a")), ["g", "low"]).join(values.select("g", F.col("rank").alias("high"), F.col("v").alias("b")), ["g", "high"])
    return out.select(*(F.col("g")[c].alias(c) for c in group), "share", F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("quantile"))


def absolute_deviation(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group columns, median, deviation): the median distance from the group's median."""
    middle = quantiles(df, group, value, [0.5]).withColumnRenamed("quantile", "median").drop("share")
    names = [f"_{c}" for c in group]
    match = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names, strict=True)]
    few = middle.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    renamed = middle.withColumnsRenamed(dict(zip(group, names, strict=True)))
    far = df.join(F.broadcast(renamed) if few else renamed, match) if group else df.crossJoin(F.broadcast(renamed))  # one row without group
    spread = quantiles(far.withColumn("_d", F.abs(F.col(value) - F.col("median"))), group, "_d", [0.5]).withColumnRenamed("quantile", "deviation").drop("share")
    if not group:
        return middle.crossJoin(spread)  # single rows
    spread = spread.withColumnsRenamed(dict(zip(group, names, strict=True)))
    return middle.join(spread, match).select(*group, "median", "deviation")
