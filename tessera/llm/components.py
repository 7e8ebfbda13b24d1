"""Connected components of a link table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .skew import skew_join


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component): the smallest id reachable, for every node with a link but the component itself.

    Large-star and small-star rounds: each hooks neighbours to the smallest one, so a path of n links needs about log n
    rounds and no node's links are collected; nodes with very many links are joined by broadcast. A round aggregates before it shuffles and ends in a written table. Loops and
    repeated links are harmless; an empty table gives no rows. Raises if max_rounds don't settle it.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "links")
    n = edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    sign = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour or itself
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n")), "least")
        large = skew_join(both, low, "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, go to its smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now[0] == now[2] and now == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        n, sign = now[0], now
    raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
