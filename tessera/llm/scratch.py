"""Tables of a data folder, and written tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.scratch import materialize, scratch_path

__all__ = ["documents_of", "materialize", "scratch_path"]


def documents_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
