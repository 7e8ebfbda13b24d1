"""Approximate neighbours by a forest of split planes, best bin first, with a budget of comparisons for each query.

Planes are fitted on a bounded sample; every row is then dealt to one leaf of each tree, and leaves are cut to parts of bounded
size. A query walks all trees at once in the order of its distance to the bins and stops taking parts when the next would
exceed its budget, so what it will be compared with is known before any vector is read. Only the pairs (query, part) are
shuffled; a task multiplies a part with the queries that take it and keeps the k best of each.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

from .vectors import distances, nearest

#: Rows that planes are fitted on; leaves of a tree at most; rows of a part; queries of a part that meet in one task.
SAMPLE, MOST_LEAVES, PART, ASKING = 50_000, 8_192, 256, 4_096
#: Splits take one of so many components of largest variance.
CHOICES = 5


@dataclass
class Tree:
    """Inner nodes: component, threshold, children (a leaf is -1 - its number)."""

    component: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> "Tree":
        stack = [(np.arange(len(x)), None, 0)]
        while stack:
            rows, parent, side = stack.pop()
            spread = x[rows].var(0) if len(rows) > leaf else np.zeros(1)
            if spread.max(initial=0) > 0:
                best = np.argsort(-spread, kind="stable")[:CHOICES]
                c = int(rng.choice(best[spread[best] > 0]))
                values = x[rows, c]
                cut = float(np.median(values))
                cut = cut if cut > values.min() else float(values[values > cut].min())  # values below the cut go low
                node = len(self.component)
                for v, first in ((self.component, c), (self.threshold, cut), (self.low, 0), (self.high, 0)):
                    v.append(first)
                stack += [(rows[values < cut], node, 0), (rows[values >= cut], node, 1)]
            else:
                node, self.leaves = -1 - self.leaves, self.leaves + 1
            if parent is not None:
                (self.low, self.high)[side][parent] = node
        return self

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if self.component else np.full(len(x), -1, np.int64)
        component, threshold, low, high = map(np.array, (self.component, self.threshold, self.low, self.high))
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, component[node]] < threshold[node], low[node], high[node])
        return -1 - at


def forest_of(sample: np.ndarray, trees: int, leaves: int, seed: int) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree().grow(sample, max(1, math.ceil(len(sample) / max(leaves, 1))), rng) for _ in range(trees)]


def visits(q: np.ndarray, forest: list[Tree], parts: dict[tuple[int, int], list[int]], budget: int) -> list[tuple[int, int, int]]:
    """(tree, leaf, part) in the order of distance to the bins, as long as their rows fit the budget; parts: sizes by leaf."""
    heap: list[tuple[float, int, int, int, dict[int, float]]] = []
    for t, tree in enumerate(forest):
        heapq.heappush(heap, (0.0, len(heap), t, 0 if tree.component else -1, {}))
    pushed, left, out = len(heap), budget, []
    while heap and left > 0:
        bound, _, t, node, offsets = heapq.heappop(heap)
        tree = forest[t]
        while node >= 0:
            c = tree.component[node]
            delta = float(q[c]) - tree.threshold[node]
            near, far = (tree.low[node], tree.high[node]) if delta < 0 else (tree.high[node], tree.low[node])
            # the far child's distance: this component's earlier offset gives way to the larger one
            beyond = bound - offsets.get(c, 0.0) + max(delta * delta, offsets.get(c, 0.0))
            heapq.heappush(heap, (beyond, pushed, t, far, {**offsets, c: max(delta * delta, offsets.get(c, 0.0))}))
            pushed += 1
            node = near
        for p, n in enumerate(parts.get((t, -1 - node), ())):
            if n > left:
                left = 0
                break
            out.append((t, -1 - node, p))
            left -= n
    return out


def k_best(ka: np.ndarray, xa: np.ndarray, kb: np.ndarray, xb: np.ndarray, k: int) -> pa.Table:
    order = np.argsort(kb, kind="stable")
    kb, d = kb[order], distances(xa, xb[order], "l2")
    best = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
    return pa.table({"a": np.repeat(ka, best.shape[1]), "b": kb[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1).astype(float)


def nearest_in_forest(queries: DataFrame, data: DataFrame, k: int, max_comparisons: int, trees: int = 4, leaf: int | None = None, seed: int = 0, vector: str = "vector") -> DataFrame:
    """(a, b, distance, rank, comparisons): the k nearest (squared L2) that each query finds within max_comparisons rows.

    queries and data: (id, vector), vectors of one length; null ones are left out. A row that several trees offer counts each time. A query
    that finds fewer than k rows within its budget is compared with all, and its comparisons say so. leaf: rows of a leaf,
    the square root of all where it isn't given.
    """
    queries, data = (df.where(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(vector).alias("v")) for df in (queries, data))
    n = data.count()
    leaf = leaf or max(1, math.isqrt(n))
    sample = data.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
    x = np.array([r[0] for r in sample], float).reshape(len(sample), len(sample[0][0]) if sample else 0)
    forest = forest_of(x, trees, min(MOST_LEAVES, max(1, math.ceil(n / leaf))), seed)
    spark = data.sparkSession
    sent = spark.sparkContext.broadcast(forest)  # at most trees * MOST_LEAVES planes

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                m = _matrix(pa.chunked_array([batch["v"]]))
                for t, tree in enumerate(sent.value):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(m), pa.int32()), pa.array(tree.leaf_of(m), pa.int32()), batch["id"]], ["tree", "leaf", "id"])

    leaves = materialize(data.mapInArrow(deal, "tree int, leaf int, id long"), "leaves")
    sizes = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    placed = leaves.join(F.broadcast(sizes), ["tree", "leaf"])  # at most trees * MOST_LEAVES rows
    placed = materialize(placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"), "parts")
    counted = placed.groupBy("tree", "leaf", "part").agg(F.count("*").alias("n"))
    # one number a part of 256 rows; a leaf's parts beyond the budget are never taken, so only those that fit are sent
    fitting = counted.where(F.col("part") <= max_comparisons).orderBy("tree", "leaf", "part").collect()
    parts: dict[tuple[int, int], list[int]] = {}
    for t, b, p, m in fitting:
        own = parts.setdefault((t, b), [])
        own += [0] * (p - len(own)) + [m]
    known = spark.sparkContext.broadcast(parts)

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m, ids = _matrix(pa.chunked_array([batch["v"]])), batch["id"].to_pylist()
            rows = [(a, *place) for a, q in zip(ids, m, strict=True) for place in visits(q, sent.value, known.value, max_comparisons)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["a", "tree", "leaf", "part"])

    place = ["tree", "leaf", "part"]
    asked = materialize(queries.mapInArrow(ask, "a long, tree int, leaf int, part int"), "asked")
    chunks = asked.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(ASKING)).cast("int").alias("chunks"))
    left = asked.join(chunks, place).withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")).join(queries.withColumnRenamed("id", "a"), "a")
    rows = placed.join(data, "id").join(chunks, place).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def task(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        out = k_best(asking["a"].to_numpy(), _matrix(asking["v"]), held["id"].to_numpy(), _matrix(held["v"]), k)
        first = np.arange(len(out)) % min(k, held.num_rows) == 0  # a query's comparisons with the part stand in its first row
        return out.append_column("n", pa.array(np.where(first, held.num_rows, 0), pa.int64()))

    by = [*place, "chunk"]
    found = left.select(*by, "a", "v").groupBy(*by).cogroup(rows.select(*by, "id", "v").groupBy(*by)).applyInArrow(task, "a long, b long, distance double, n long")
    once = found.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.sum("n").alias("n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct(F.round("distance", 9).alias("d"), "b", "distance"))), 1, k)  # k rows a part within the budget
    best = materialize(once.groupBy("a").agg(ranked.alias("best"), F.sum("n").alias("comparisons")), "best")
    whole = best.where(F.size("best") == min(k, n))
    out = whole.select("a", "comparisons", F.posexplode("best").alias("rank", "r")).select("a", "r.b", "r.distance", (F.col("rank") + 1).alias("rank"), "comparisons")
    short = queries.withColumnRenamed("v", "vector").join(whole.select(F.col("a").alias("id")), "id", "left_anti")
    if short.isEmpty():
        return out
    return out.unionByName(nearest(short, data.withColumnRenamed("v", "vector"), k).withColumn("comparisons", F.lit(n).cast("long")))
