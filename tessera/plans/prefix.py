"""Prefix sums and row numbers over a total order, without a window that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def prefix_scan(df: DataFrame, order: list[Column], sums: dict[str, Column | str], maxima: dict[str, Column | str] | None = None) -> DataFrame:
    """Adds running sums and running maxima (first row to this one) in that order, which must be total.

    Rows are range-partitioned by the order and written once, so that partition numbers are fixed; each partition is
    scanned by its own window; offsets come from one row per partition.
    """
    maxima = maxima or {}
    ranged = df.repartitionByRange(*order).withColumns({f"_s_{k}": v if isinstance(v, Column) else F.col(v) for k, v in sums.items()} | {f"_m_{k}": v if isinstance(v, Column) else F.col(v) for k, v in maxima.items()})
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(f"_s_{k}").alias(f"_o_{k}") for k in sums), *(F.max(f"_m_{k}").alias(f"_o_{k}") for k in maxima))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *(F.coalesce(F.sum(f"_o_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums), *(F.max(f"_o_{k}").over(before).alias(f"_o_{k}") for k in maxima))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    out = out.withColumns({k: F.sum(f"_s_{k}").over(within) + F.col(f"_o_{k}") for k in sums} | {k: F.greatest(F.max(f"_m_{k}").over(within), F.col(f"_o_{k}")) for k in maxima})
    return out.select(*df.columns, *sums, *maxima)


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1, 2, ... in that total order."""
    return prefix_scan(df, order, {name: F.lit(1).cast("long")})
