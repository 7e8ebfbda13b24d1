"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target of words, the ones nearest to rate 1 in relative entropy
(weighted by words) are exponentially tilted: a document's rate is exp(sum of its groups' multipliers). The
multipliers solve the convex dual sum(words * exp(l)) - sum(target * l), by Newton steps whose gradient and Hessian
diagonal are sums over the corpus. As rates depend on the groups only, the corpus is first aggregated to one row per
combination of groups, and steps run as aggregates over that table. Several margins (say source and language) are
balanced in turn, a Newton step each.

Rates become copies: every document is taken floor(rate) times; the words still missing are taken as one more copy of
documents in hash order until they are spent, the last one in part. Prefix sums over the hash order are by hash
bucket, so only documents of a source's one boundary bucket meet in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.prefix import global_row_number

from .scratch import documents_of, materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def row_hash(id_col: str, text_col: str, seed: int = 17) -> Column:
    """The order in which documents get an extra copy."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def targets_by_weight(totals: DataFrame, limit: float = 3.0, cycle: int = 3) -> DataFrame:
    """totals (source, source_size) -> with target: weights 1..cycle by source order share the whole, none above limit times its size.

    What a capped source can't take is shared among the others by weight, until none is above.
    """
    numbered = global_row_number(totals, [F.col("source").asc_nulls_last()], "rank")
    numbered = materialize(numbered.select("source", "source_size", ((F.col("rank") - 1) % cycle + 1).cast("double").alias("weight")), "targets")
    cap = F.col("source_size") * F.lit(limit)
    total = float(numbered.agg(F.sum("source_size")).first()[0] or 0)
    # level: words for a unit of weight; a source is capped if its cap per weight lies below it
    level, capped = None, -1
    while True:
        free = F.lit(True) if level is None else cap > F.col("weight") * F.lit(level)
        spent, weight, n = numbered.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight"))), F.count_if(~free)).first()
        if n == capped:
            break
        capped, level = n, (total - (spent or 0.0)) / weight if weight else float("inf")
    return numbered.withColumn("target", F.when(F.lit(level == float("inf")), cap).otherwise(F.least(cap, F.col("weight") * F.lit(0.0 if level == float("inf") else level))))


def balanced_rates(cells: DataFrame, margins: dict[str, DataFrame], size: str = "size", tolerance: float = 1e-10, max_steps: int = 200) -> DataFrame:
    """cells (one row per combination of the margins' columns, with size) -> with rate.

    margins: column -> table of (that column, target). Null is a level like any other. Levels of size 0 keep rate 1.
    Raises if the margins can't be met together.
    """
    state = cells.select(*margins, F.col(size).alias("size"), *(F.lit(0.0).alias(f"l_{m}") for m in margins))
    for step in range(max_steps):
        worst = []
        for m, wanted in margins.items():
            rate = F.exp(reduce(lambda x, y: x + y, (F.col(f"l_{k}") for k in margins)))
            level = state.groupBy(m).agg(F.sum(F.col("size") * rate).alias("mass"))
            level = level.join(wanted.select(F.col(m).alias("_m"), "target"), F.col(m).eqNullSafe(F.col("_m"))).select("_m", "mass", "target")
            # gradient mass - target over Hessian mass; a step of more than 1 is cut so that exp stays in range
            newton = F.when((F.col("mass") > 0) & (F.col("target") > 0), F.greatest(F.least((F.col("target") - F.col("mass")) / F.col("mass"), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
            level = level.select("_m", newton.alias("step"), F.when(F.col("target") > 0, F.abs(F.col("mass") / F.col("target") - 1)).otherwise(0.0).alias("off"))
            state = state.join(level, F.col(m).eqNullSafe(F.col("_m")), "left").withColumn(f"l_{m}", F.col(f"l_{m}") + F.coalesce("step", F.lit(0.0))).withColumn(f"off_{m}", F.coalesce("off", F.lit(0.0))).drop("_m", "step", "off")
            worst.append(f"off_{m}")
        state = materialize(state, "multipliers")
        off = state.agg(F.max(F.greatest(*worst, F.lit(0.0)))).first()[0]
        state = state.drop(*worst)
        if off is None or off <= tolerance:
            return state.withColumn("rate", F.exp(reduce(lambda x, y: x + y, (F.col(f"l_{k}") for k in margins))))
    raise RuntimeError(f"the margins aren't met after {max_steps} steps: {off:.3g} off")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: float = 3.0, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies (whole ones), part (words of a partial one).

    Null texts have size 0 and are not taken; null is a source, the last; rows that repeat are documents of their own;
    an empty table gives no rows; other columns are ignored. taken never exceeds limit times size, and a source's
    taken words differ from its target by rounding to whole words only.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_hash(id_col, text_col, seed).alias("h"))
    docs = materialize(docs.withColumn("bucket", F.shiftrightunsigned("h", 52)), "sizes")
    by_bucket = materialize(docs.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    totals = by_bucket.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(targets_by_weight(totals, limit), "targets")
    rates = balanced_rates(totals.withColumnRenamed("source_size", "size"), {"source": targets})
    plan = targets.join(rates.select(F.col("source").alias("_s"), "rate"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("rate") + F.lit(1e-9))).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("missing", F.greatest(F.round("target").cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
    # the bucket in which a source's missing words run out
    order = Window.partitionBy("source").orderBy("bucket")
    running = by_bucket.withColumn("before", F.sum("size").over(order) - F.col("size"))
    edge = running.join(plan.select(F.col("source").alias("_s"), "missing"), F.col("source").eqNullSafe(F.col("_s"))).where("before <= missing and before + size > missing")
    edge = edge.select(F.col("source").alias("_e"), F.col("bucket").alias("edge"), F.col("before"))
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left").drop("_e")
    plan = materialize(plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "missing", "edge", "before"), "plan")
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    outside = rows.where("edge is null or bucket <> edge").withColumn("extra", F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), F.col("size")).otherwise(0))
    within = Window.partitionBy("source").orderBy("h", "doc_id", "size")
    inside = rows.where("bucket = edge").withColumn("through", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col("missing") - F.col("before") - (F.col("through") - F.col("size"))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left))).drop("through")
    taken = outside.unionByName(inside)
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
        (F.col("whole") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
        F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(0).cast("long").alias("part"), "h",
    )


def op5_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents_of(spark, sf_dir)).drop("h")
