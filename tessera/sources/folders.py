"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_manifest(spark: SparkSession, folder: str, pattern: str, series: str) -> DataFrame:
    """(folder, series, files, bytes, first, last) of the files under a folder, at any depth; only names are read, no content.

    pattern: file names that count (a glob); series: the part of a name that tells its series, a regular expression's group 1.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract(name, series, 1).alias("series"), name.alias("name"), "length")
    return parts.groupBy("folder", "series").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.min("name").alias("first"), F.max("name").alias("last"))
