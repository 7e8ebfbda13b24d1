"""Records to dense grids, gates and per-gate aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_cells(df: DataFrame, cell: list[str], payload: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One record per cell: the last (or first) in a total order."""
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    return df.groupBy(*cell).agg(pick(F.struct(*payload), F.struct(*order)).alias("_p")).select(*cell, "_p.*")


def dense_grid(df: DataFrame, dims: dict[str, tuple[int, int]]) -> DataFrame:
    """All cells of the ranges, with df's other columns where it has the cell and 0 elsewhere."""
    spark = df.sparkSession
    first, *rest = dims.items()
    cells = spark.range(first[1][0], first[1][1] + 1).select(F.col("id").alias(first[0]))
    for name, (low, high) in rest:
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
    values = [c for c in df.columns if c not in dims]
    return cells.join(df, list(dims), "left").select(*dims, *(F.coalesce(c, F.lit(0)).alias(c) for c in values))


def keep_sampled(df: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(mask, keys, "left_semi")


def drop_sampled(df: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(mask, keys, "left_anti")


def zero_unsampled(df: DataFrame, mask: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    marked = df.join(mask.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return marked.withColumns({v: F.when(F.col("_hit"), F.col(v)).otherwise(0.0) for v in values}).drop("_hit")


def gate_centroids(df: DataFrame, value: str, gates: int, bins: int = 256, tail: float = 0.9, tolerance: float = 1.0) -> DataFrame:
    """(gate, centroid, tolerance): centroids spaced from the upper to the lower limit of a histogram of all bins, empty ones too.

    The lower limit is the first bin such that it and all above hold at most tail of the rows, the upper the last such
    that all below it do. If all values are equal there is one gate at that value, without tolerance (null); without
    values there is none. Everything after the histogram is over `bins` rows.
    """
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.floor(F.try_divide(F.col(value) - F.col("lo"), width))
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends: one row
    dense = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    through, total = F.sum("n").over(Window.orderBy("bin")), F.sum("n").over(Window.partitionBy())  # over `bins` rows
    shares = dense.select("bin", F.try_divide(through - F.col("n"), total).alias("below"), F.try_divide(total - through + F.col("n"), total).alias("from_here"))
    limits = shares.agg(F.max(F.when(F.col("below") <= tail, F.col("bin"))).alias("top"), F.coalesce(F.min(F.when(F.col("from_here") <= tail, F.col("bin"))), F.lit(bins)).alias("bottom"))
    limits = limits.crossJoin(ends).where("lo IS NOT NULL").select((F.col("lo") == F.col("hi")).alias("flat"), "lo", (F.col("lo") + F.col("top") * width).alias("top"), (F.col("lo") + F.col("bottom") * width).alias("bottom"))
    spacing = (F.col("top") - F.col("bottom")) / max(gates - 1, 1)
    rows = limits.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("flat"), 0).otherwise(gates - 1))).alias("gate"))
    centroid = F.when(F.col("flat"), F.col("lo")).otherwise(F.col("top") - F.col("gate") * spacing)
    return rows.select("gate", centroid.alias("centroid"), F.when(~F.col("flat"), F.abs(spacing) * tolerance / 2).alias("tolerance"))


def in_gates(df: DataFrame, gates: DataFrame, value: str, limit: int = 255) -> DataFrame:
    """Pairs of records and gates with |value - centroid| < tolerance. Gates are few: more than limit go by bucket."""
    distance = F.abs(F.col(value) - F.col("centroid"))
    if gates.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(gates), distance < F.col("tolerance")).withColumn("distance", distance)
    width = gates.agg(F.max("tolerance")).first()[0]
    cells = gates.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("centroid") - width) / width), F.floor((F.col("centroid") + width) / width))))
    return df.withColumn("_cell", F.floor(F.col(value) / width)).join(cells, "_cell").where(distance < F.col("tolerance")).withColumn("distance", distance).drop("_cell")


def populate(pairs: DataFrame, cell: list[str], value: str, order: list[str], how: str = "gauss") -> DataFrame:
    """One value per cell from its gate's records: closest, average or gauss (one record: closest is the same)."""
    if how == "closest":
        return pairs.groupBy(*cell).agg(F.min_by(value, F.struct("distance", *order)).alias(value))
    if how == "average":
        return pairs.groupBy(*cell).agg(F.avg(value).alias(value))
    weight = F.exp(-F.pow(F.col("distance"), F.lit(2)) / (2 * F.pow(F.col("tolerance"), F.lit(2))))
    return pairs.withColumn("_w", weight).groupBy(*cell).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def neighbours_2d(df: DataFrame, row: str, col: str, reach: int = 1, centre: bool = False) -> DataFrame:
    """Each cell's values addressed to its neighbours: columns row, col (target), dr, dc, and df's others."""
    shifts = F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if centre or i or j))
    out = df.withColumn("_s", F.explode(shifts)).withColumns({row: F.col(row) + F.col("_s.dr"), col: F.col(col) + F.col("_s.dc")})
    return out.select(*df.columns, F.col("_s.dr").alias("dr"), F.col("_s.dc").alias("dc"))


def dense_cells(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """All cells from (0, 0) to the largest keys; absent ones are 0."""
    ends = df.agg(F.max(row).alias("_r"), F.max(col).alias("_c"))  # one row
    cells = ends.where("_r IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r").cast("long"))).alias(row), "_c")
    cells = cells.repartition(row).select(row, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c").cast("long"))).alias(col))
    return cells.join(df.withColumns({k: F.col(k).cast("long") for k in (row, col)}), [row, col], "left").select(row, col, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def integral(df: DataFrame, row: str, col: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Running sums over rows and columns from the first cell; df must be dense."""
    by = by or []
    along = df.withColumn("_line", F.sum(value).over(Window.partitionBy(*by, row).orderBy(col)))
    return along.withColumn("integral", F.sum("_line").over(Window.partitionBy(*by, col).orderBy(row))).drop("_line")
