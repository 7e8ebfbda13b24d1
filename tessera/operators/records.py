"""Selecting, routing and ordering tagged records."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.prefix import global_row_number


def in_counter_ranges(df: DataFrame, ranges: dict[str, object]) -> DataFrame:
    """Records whose every named counter equals its scalar or lies in its (low, high)."""
    tests = [F.col(c).between(*r) if isinstance(r, tuple) else F.col(c) == r for c, r in ranges.items()]
    return df.where(reduce(lambda x, y: x & y, tests)) if tests else df


def counter_profile(df: DataFrame, counters: list[str]) -> DataFrame:
    """(counter, low, high), in one pass."""
    wide = df.agg(*(F.struct(F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high")).alias(c) for c in counters))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high")) for c in counters)))
    return wide.select(rows.alias("r")).select("r.*")


def extents(df: DataFrame, counters: list[str], distinct: bool = False) -> DataFrame:
    """max - min + 1 of each counter (or its distinct values), one row."""
    return df.agg(*(F.count_distinct(c).alias(c) if distinct else (F.max(c) - F.min(c) + 1).cast("long").alias(c) for c in counters))


def modal_only(df: DataFrame, length: str) -> DataFrame:
    """Records whose length is the most frequent one; of equally frequent lengths the smallest."""
    best = df.groupBy(length).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), length).limit(1).select(F.col(length).alias("_l"))
    return df.join(F.broadcast(best), F.col(length) == F.col("_l"), "left_semi")  # one row


def discard_start(df: DataFrame, series: str, order: list[str], n: int) -> DataFrame:
    """Drops the first n records of each series; series of n records or fewer stay whole."""
    within = Window.partitionBy(series)
    numbered = df.withColumns({"_r": F.row_number().over(within.orderBy(*order)), "_n": F.count("*").over(within)})
    return numbered.where((F.col("_r") > n) | (F.col("_n") <= n)).drop("_r", "_n")


def trim_trailing_zeros(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Drops zeros after the last other value; a series of zeros goes whole."""
    last = F.max(F.when(F.col(value) != 0, F.col(order))).over(Window.partitionBy(series))
    return df.withColumn("_last", last).where(F.col(order) <= F.col("_last")).drop("_last")


def _picked(row: Column, n: int, total: int) -> Column:
    """Whether row (from 1) is one of n uniform picks: pick i (from 0) is 1 + i(total - 1)/(n - 1), rounded half up, in whole numbers."""
    if n == 1:
        return row == total
    steps, span = n - 1, total - 1
    near = F.floor((row - 1) * F.lit(steps) / F.lit(max(span, 1))).cast("long")
    hits = [((i >= 0) & (i <= steps) & (F.floor((i * F.lit(2 * span) + F.lit(steps)) / F.lit(2 * steps)) + 1 == row)) for i in (near - 1, near, near + 1, near + 2)]
    return hits[0] | hits[1] | hits[2] | hits[3]


def subset(df: DataFrame, how: str, n: float, order: list[str], place: list[str] | None = None) -> DataFrame:
    """n rows: first, last, uniform, largest or smallest by a total order; in that order, or by place (the rows' own order).

    n below 1 is a share of the rows, rounded half up. Uniform picks are 1 to the number of rows in n - 1 equal steps, rounded
    half up; a single pick is the last row.
    """
    if 0 < n < 1:
        n = math.floor(df.count() * n + 0.5)
    n = int(n)
    if how in ("first", "smallest"):
        out = df.orderBy(*order).limit(n)
    elif how in ("last", "largest"):
        out = df.orderBy(*(F.desc(c) for c in order)).limit(n)
    elif how == "uniform":
        total = df.count()
        if not total or n <= 0:
            return df.limit(0)
        numbered = global_row_number(df, [F.col(c) for c in order], "_row")
        out = numbered.where(_picked(F.col("_row"), min(n, total), total)).drop("_row")
    else:
        raise ValueError(how)
    return out.orderBy(*(place or order))


def random_subset(df: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed; in key order."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n).orderBy(*key)


def natural_key(text: Column, width: int = 20) -> Column:
    """A string whose order puts digit runs in numeric order: runs are padded to width; a longer run follows a colon
    (which is above all digits) and its length, leading zeros apart, so that none is cut."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))

    def numeric(run):
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        longer = F.concat(F.lit(":"), F.lpad(F.char_length(digits).cast("string"), 10, "0"), digits)
        return F.when(F.char_length(digits) <= width, F.lpad(digits, width, "0")).otherwise(longer)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), numeric(p)).otherwise(p)), "")


def first_seen(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("first")).select(value, "first.*")


def time_of_day(text: Column) -> Column:
    """Seconds of HHMMSS.frac."""
    return F.substring(text, 1, 2).cast("double") * 3600 + F.substring(text, 3, 2).cast("double") * 60 + F.substring(text, 5, 20).cast("double")


def path_safe(name: Column, number: Column) -> Column:
    """A folder name: blanks to underscores, signs removed, a four-digit number after it."""
    return F.format_string("%s_%04d", F.regexp_replace(F.regexp_replace(name, " ", "_"), r"[*<>/&%$=+]", ""), number.cast("int"))


def djb2(text: Column) -> Column:
    """33-multiplier string hash, seed 5381, modulo 2³² - 1, over characters."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % F.lit(4294967295))
