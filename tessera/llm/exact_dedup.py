"""Exact dedup over a log-structured merge index of text digests, with DataFrame functions only.

Rows are inserted flush by flush. A flush's memtables are its tasks' hash tables of digests; they leave as one *run*: a
table of (digest, size, key that stays, rows) sorted by digest over disjoint ranges, and a blocked Bloom filter of it, a
table of (word, 64 bits) in which a digest has four bits of one word. Before a run joins the index, its digests are
looked up in the runs that are there: by filter words first, and only what passes meets the run's entries. What is
found, and what a memtable held twice, is a hit. As soon as a level holds ``fanout`` runs, they are compacted to one
run of the next level, where the smallest (or largest) key of each digest stays.

Hits get byte verification: the least and the greatest text of a digest must be equal, by partial aggregates over
salted digests; should two texts ever share a digest, they are told apart by text. Only hits' texts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents_of, materialize, scratch_path
from .skew import skew_join, with_keys

SALTS, FILTER_BITS = 64, 12
RUN = "digest string, size int, key long, rows long"


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def digest_of(column: str) -> Column:
    return F.sha2(text_of(column).cast("binary"), 256)


def filter_word(words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), F.col("digest")), F.lit(words))


def filter_mask() -> Column:
    """Four bits of 64, by 24 bits of a hash."""
    h = F.xxhash64(F.lit(2), F.col("digest"))
    places = (F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


class Run:
    """A sorted run and its filter, written under path."""

    def __init__(self, spark: SparkSession, path: str, merged: DataFrame) -> None:
        merged.repartitionByRange("digest").sortWithinPartitions("digest").write.parquet(f"{path}/entries")
        self.entries = spark.read.schema(merged.schema).parquet(f"{path}/entries")
        self.words = max(1, self.entries.count() * FILTER_BITS // 64)
        masks = self.entries.select(filter_word(self.words).alias("word"), filter_mask().alias("mask"))
        masks = masks.groupBy("word").agg(F.bit_or("mask").alias("bits"))
        masks.write.parquet(f"{path}/filter")
        self.filter = spark.read.schema(masks.schema).parquet(f"{path}/filter")

    def passing(self, digests: DataFrame) -> DataFrame:
        """Digests that the filter doesn't rule out: all that the run holds and a few per cent of others."""
        asked = digests.select("digest", filter_word(self.words).alias("word"), filter_mask().alias("mask"))
        return asked.join(self.filter, "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("digest")

    def lookup(self, digests: DataFrame) -> DataFrame:
        return self.passing(digests).join(self.entries, "digest")


class DigestIndex:
    """Levels of runs. keep: 'largest' or 'smallest' key of equal texts stays."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", fanout: int = 2) -> None:
        self.spark, self.path, self.fanout, self.written = spark, path or scratch_path(spark, "digest-index"), fanout, 0
        self.levels: list[list[Run]] = [[]]
        self.survivor = {"largest": F.max, "smallest": F.min}[keep]

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _write(self, merged: DataFrame) -> Run:
        self.written += 1
        return Run(self.spark, f"{self.path}/run-{self.written}", merged)

    def _merge(self, runs: list[Run]) -> DataFrame:
        out = runs[0].entries
        for run in runs[1:]:
            out = out.unionByName(run.entries)
        return out.groupBy("digest", "size").agg(self.survivor("key").alias("key"), F.sum("rows").alias("rows"))

    def insert(self, rows: DataFrame) -> DataFrame:
        """Flushes rows (digest, size, key) as a run; hits (digest): what that run holds twice or an earlier run holds."""
        merged = rows.groupBy("digest", "size").agg(self.survivor("key").alias("key"), F.count("*").alias("rows"))
        run = self._write(merged)
        hits = run.entries.where("rows > 1").select("digest")
        for earlier in self.runs:
            hits = hits.unionByName(earlier.lookup(run.entries.select("digest")).select("digest"))
        hits = materialize(hits, "hits")
        self.levels[0].append(run)
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(self._merge(self.levels[i])))
                self.levels[i] = []
        return hits

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            self.levels.append([self._write(self._merge(self.runs))])
            self.levels[:-1] = [[] for _ in self.levels[:-1]]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Entries (digest, size, key, rows) of some distinct digests over all runs."""
        out = None
        for run in self.runs:
            out = run.lookup(digests) if out is None else out.unionByName(run.lookup(digests))
        if out is None:
            return self.spark.createDataFrame([], RUN)
        return out.groupBy("digest", "size").agg(self.survivor("key").alias("key"), F.sum("rows").alias("rows"))


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """digest, size, key of each row."""
    return df.select(digest_of(text_col).alias("digest"), F.octet_length(text_of(text_col)).alias("size"), F.col(id_col).alias("key"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", path: str | None = None, flushes: int = 4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and equal each other; texts of any length are compared whole. Of rows with equal text the
    one with the largest (or smallest) doc_id stays; null ids lose to any other; rows with one id and one text are all
    kept or all dropped. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    index = DigestIndex(spark, path, keep)
    staged = materialize(rows_of(df, id_col, text_col).withColumn("flush", F.pmod(F.xxhash64("key", "digest"), F.lit(flushes)).cast("int")), "digests")
    total, hits = staged.count(), None
    for i in range(flushes):
        found = index.insert(staged.where(F.col("flush") == i).drop("flush"))
        hits = found if hits is None else hits.unionByName(found)
    index.compact()
    hits = materialize(hits.distinct(), "hits")
    groups = materialize(index.lookup(hits).select("digest", F.col("key").alias("keep_id"), F.col("rows").alias("group_size")), "groups")

    texts = df.select(text_of(text_col).alias("text"), F.col(id_col).alias("key")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    texts = with_keys(texts, hits, "digest", "left_semi")
    salted = texts.groupBy("digest", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")).agg(F.min("text").alias("low"), F.max("text").alias("high"))
    compared = salted.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    clash = materialize(compared.where("low <> high").select("digest"), "clash")

    out = skew_join(staged.select("digest", "key"), groups, "digest", "group_size", total, "left")
    out = out.select("digest", "key", F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if not clash.isEmpty():
        split = with_keys(texts, clash, "digest", "left_semi")
        apart = split.groupBy("text").agg(index.survivor("key").alias("keep_id"), F.count("*").alias("group_size"))
        out = with_keys(out, clash, "digest", "left_anti").unionByName(split.join(apart, "text").select("digest", "key", "keep_id", "group_size"))
    return out.select(F.col("key").alias("doc_id"), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents_of(spark, sf_dir))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
