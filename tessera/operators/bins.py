"""Bins, histograms and tree counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import integral


def bin_of(x: Column, edges: list[float]) -> Column:
    """How many edges are at or below x: bin i is [edge i, next edge), 0 lies below the first; edges ascend. NaN has no bin."""
    return F.when(F.isnan(x), None).otherwise(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)))


def bin_sum(df: DataFrame, bin_col: str, value: str, n: int) -> DataFrame:
    """Sums for bins 1..n, 0 where empty; bin 0 is skipped."""
    sums = df.where(F.col(bin_col).between(1, n)).groupBy(F.col(bin_col).cast("long").alias("bin")).agg(F.sum(value).alias("total"))
    return df.sparkSession.range(1, n + 1).withColumnRenamed("id", "bin").join(sums, "bin", "left").select("bin", F.coalesce("total", F.lit(0.0)).alias("total"))


def weighted_histogram(df: DataFrame, value: str, weight: str, edges: list[float]) -> DataFrame:
    """Weights by bin; the last bin is the single value of the last edge."""
    x = F.col(value)
    return df.where((x >= edges[0]) & (x <= edges[-1]) & ~F.isnan(x)).groupBy(bin_of(x, edges).alias("bin")).agg(F.sum(weight).alias("weight"))


def joint_histogram(df: DataFrame, x: str, y: str, levels: int, by: list[str] | None = None) -> DataFrame:
    """Counts (a, b, n) of the nearest of so many equally spaced levels on each axis, by group's own range where by is given."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(x).alias("_lx"), F.max(x).alias("_hx"), F.min(y).alias("_ly"), F.max(y).alias("_hy"))  # one row a group

    def level(v, lo, hi):
        return F.when(F.col(hi) == F.col(lo), 0).otherwise(F.round((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * (levels - 1))).cast("int")

    met = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    return met.groupBy(*by, level(x, "_lx", "_hx").alias("a"), level(y, "_ly", "_hy").alias("b")).agg(F.count("*").alias("n"))


def box_counts(counts: DataFrame, label: str, row: str, col: str, value: str, boxes: DataFrame) -> DataFrame:
    """(box, label, n) for boxes (box, l0, l1, p0, p1), by four look-ups of integral counts; boxes without a count give no row."""
    labels, rows, cols = counts.select(label).distinct(), counts.select(row).distinct(), counts.select(col).distinct()
    full = labels.crossJoin(rows).crossJoin(cols).join(counts, [label, row, col], "left").withColumn(value, F.coalesce(value, F.lit(0)))  # cells of one grid
    sums = integral(full, row, col, value, [label])
    corners = boxes.select("box", F.explode(F.array(
        F.struct(F.col("l1").alias("r"), F.col("p1").alias("c"), F.lit(1).alias("sign")), F.struct((F.col("l0") - 1).alias("r"), F.col("p1").alias("c"), F.lit(-1).alias("sign")),
        F.struct(F.col("l1").alias("r"), (F.col("p0") - 1).alias("c"), F.lit(-1).alias("sign")), F.struct((F.col("l0") - 1).alias("r"), (F.col("p0") - 1).alias("c"), F.lit(1).alias("sign")),
    )).alias("k")).select("box", "k.*")
    edge = sums.agg(F.max(row).alias("_mr"), F.max(col).alias("_mc"))  # one row: boxes end at the grid's last cell
    corners = corners.crossJoin(F.broadcast(edge)).withColumns({"r": F.least("r", "_mr"), "c": F.least("c", "_mc")})
    found = corners.join(sums, (F.col("r") == F.col(row)) & (F.col("c") == F.col(col)))
    return found.groupBy("box", label).agg(F.sum(F.col("sign") * F.col("integral")).cast("long").alias("n")).where("n > 0")


def path_histogram(df: DataFrame, path: str) -> DataFrame:
    """Counts per node of root-to-leaf paths; a node is the prefix that leads to it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.array_join(F.slice(path, F.lit(1), k).cast("array<string>"), "/"))
    return df.select(F.explode(prefixes).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def cut_histogram(df: DataFrame, value: str, mapping: DataFrame, label: str, by: list[str], missing: str | None) -> DataFrame:
    """Counts after relabelling by mapping (value, label); values without label drop (missing None) or count under missing."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n")).join(mapping, value, "left")
    counts = counts.where(F.col(label).isNotNull()) if missing is None else counts.withColumn(label, F.coalesce(label, F.lit(missing)))
    return counts.groupBy(*by, label).agg(F.sum("_n").alias("n"))


def tree_histogram(leaves: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Counts of data below each node of a tree (node, parent) of at most depth levels; leaves (leaf, n)."""
    level = leaves.select(F.col("leaf").alias("node"), "n")
    out = level
    for _ in range(depth - 1):
        level = level.join(edges, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n"))
        out = out.unionByName(level)
    return out.groupBy("node").agg(F.sum("n").alias("n"))
