"""ROC, precision-recall and detection curves over scored rows, by prefix scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.prefix import prefix_scan
from tessera.plans.scratch import materialize


def tp_fp(df: DataFrame, label: str, score: str, key: str, infinite: bool = False) -> DataFrame:
    """rank, tp, fp in descending score order, from a leading row of zeros; label 0 is ignored.

    Scores of -infinity are not retrieved unless asked for. Equal scores are ordered by key.
    """
    rows = df.where(F.col(label) != 0)
    rows = rows if infinite else rows.where(F.col(score) > float("-inf"))
    one = F.lit(1).cast("long")
    scanned = prefix_scan(rows.select(key, label, score), [F.desc(score), F.asc(key)], {"rank": one, "tp": (F.col(label) > 0).cast("long"), "fp": (F.col(label) < 0).cast("long")})
    zero = df.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(c) for c in ("rank", "tp", "fp")))
    return zero.unionByName(scanned.select("rank", "tp", "fp"))


def totals(df: DataFrame, label: str, positives: float | None = None, negatives: float | None = None) -> DataFrame:
    """One row: positives p and negatives n; surrogate totals replace the counted ones (say of items that were never scored)."""
    p, n = (F.count_if(c) if given is None else F.lit(given) for c, given in ((F.col(label) > 0, positives), (F.col(label) < 0, negatives)))
    return df.agg(F.count("*").alias("_"), p.alias("p"), n.alias("n")).drop("_")


def roc(df: DataFrame, label: str, score: str, key: str, infinite: bool = False, positives: float | None = None, negatives: float | None = None) -> DataFrame:
    """rank, tpr, tnr; by surrogate totals where they are given."""
    return tp_fp(df, label, score, key, infinite).crossJoin(F.broadcast(totals(df, label, positives, negatives))).select("rank", (F.col("tp") / F.col("p")).alias("tpr"), (1 - F.col("fp") / F.col("n")).alias("tnr"))  # one row


def roc_summary(df: DataFrame, label: str, score: str, key: str, infinite: bool = False) -> DataFrame:
    """AUC (staircase) and equal error rate (NaN where the curves don't meet), one row."""
    rates = tp_fp(df, label, score, key, infinite).crossJoin(F.broadcast(totals(df, label)))  # one row
    rates = materialize(rates.select("rank", "tp", "p", (F.col("tp") / F.col("p")).alias("tpr"), (1 - F.col("fp") / F.col("n")).alias("tnr")), "rates")
    # tp runs 0, 1, 2, ...: the first row of each tp is where it rose
    rises = rates.groupBy("tp", "p").agg(F.min_by("tnr", "rank").alias("tnr"), F.min("rank").alias("rank"))
    area = rises.where("tp > 0").agg(F.sum(F.col("tnr") / F.col("p")).alias("auc"))
    # the curves meet at a row that raises tpr or at one that lowers tnr
    meet = rates.where("tpr >= tnr").agg(F.min_by(F.struct("rank", "tp", "tpr", "tnr"), "rank").alias("m")).select("m.*")
    met = meet.join(rises.select(F.col("tp").alias("_tp"), F.col("rank").alias("_rank")), F.col("tp") == F.col("_tp"), "left")
    met = met.agg(F.max(F.when(F.col("rank") == F.col("_rank"), 1 - F.col("tnr")).otherwise(1 - F.col("tpr"))).alias("x"))
    return area.crossJoin(met).select(F.coalesce("auc", F.lit(0.0)).alias("auc"), F.coalesce("x", F.lit(float("nan"))).alias("eer"))


def pr(df: DataFrame, label: str, score: str, key: str, infinite: bool = False, prior: float | None = None, positives: float | None = None, negatives: float | None = None) -> DataFrame:
    """rank, recall, precision (1 at rank 0).

    prior: precision as it would be if positives were that share of all, tp·prior/p over itself plus fp·(1 - prior)/n.
    """
    counted = tp_fp(df, label, score, key, infinite).crossJoin(F.broadcast(totals(df, label, positives, negatives)))
    good, bad = (F.col("tp"), F.col("fp")) if prior is None else (F.col("tp") * prior / F.greatest("p", F.lit(1e-300)), F.col("fp") * (1 - prior) / F.greatest("n", F.lit(1e-300)))
    return counted.select("rank", "tp", (F.col("tp") / F.col("p")).alias("recall"), F.when(F.col("rank") == 0, 1.0).otherwise(good / (good + bad)).alias("precision"))


def pr_summary(df: DataFrame, label: str, score: str, key: str, infinite: bool = False) -> DataFrame:
    """Area (trapezoid), average precision and 11-point average precision, one row.

    Recall rises only at positive rows, by 1/p each, so the trapezoids need each positive row and the row before it.
    """
    rows = materialize(pr(df, label, score, key, infinite), "precision")
    rises = rows.where("tp > 0").groupBy("tp").agg(F.min("rank").alias("rank"))
    here = rises.join(rows.drop("tp"), "rank").select("rank", "precision", "recall")
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col("precision").alias("before"), F.col("recall").alias("from"))
    steps = here.join(before, "rank").withColumn("rise", F.col("recall") - F.col("from"))
    areas = steps.agg(F.sum(F.col("rise") * (F.col("precision") + F.col("before")) / 2).alias("auc"), F.sum(F.col("rise") * F.col("precision")).alias("ap"))
    levels = rows.agg(*(F.coalesce(F.max(F.when(F.col("recall") >= i / 10 - 1e-12, F.col("precision"))), F.lit(0.0)).alias(f"l{i}") for i in range(11)))
    eleven = sum((F.col(f"l{i}") for i in range(1, 11)), F.col("l0")) / 11
    return areas.crossJoin(levels).select(F.coalesce("auc", F.lit(0.0)).alias("auc"), F.coalesce("ap", F.lit(0.0)).alias("ap"), eleven.alias("ap11"))


def det(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """rank, miss rate, false alarm rate."""
    return roc(df, label, score, key).select("rank", (1 - F.col("tpr")).alias("miss"), (1 - F.col("tnr")).alias("false_alarm"))


def interpolated(rows: DataFrame) -> DataFrame:
    """Precision as the largest at this recall or above, by a running maximum from the end."""
    return prefix_scan(rows, [F.desc("rank")], {}, {"interpolated": F.col("precision")})


