"""Vectors as array columns: distances, neighbours, clusters and encoders.

Pairs are formed block by block: both sides are packed to blocks of bounded size, and a task multiplies two blocks with
numpy and keeps partial results (the k best) before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

BLOCK = 2048


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances (l2: squared, l1, linf, l0, chi2, hell) or kernels (kl2, kl1, kchi2, khell) of all rows of x to all rows of y."""
    if metric == "l2":
        return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)
    if metric == "kl2":
        return x @ y.T
    if metric in ("hell", "khell"):
        root = np.sqrt(x) @ np.sqrt(y).T
        return root if metric == "khell" else x.sum(1)[:, None] + y.sum(1) - 2 * root
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        if metric == "l1":
            out[i] = np.abs(row - y).sum(1)
        elif metric == "linf":
            out[i] = np.abs(row - y).max(1)
        elif metric == "l0":
            out[i] = (row != y).sum(1)
        elif metric == "kl1":
            out[i] = np.minimum(row, y).sum(1)
        elif metric in ("chi2", "kchi2"):
            total = row + y
            top = (row - y) ** 2 if metric == "chi2" else 2 * row * y
            out[i] = np.divide(top, total, out=np.zeros_like(total), where=total != 0).sum(1)
        else:
            raise ValueError(metric)
    return out


def blocks(df: DataFrame, key: str, vector: str, size: int = BLOCK, spread: bool = False) -> DataFrame:
    """One row per block: keys and vectors, of about size rows. spread: over as many partitions as there are blocks, as far as shuffle partitions go."""
    n = max(1, math.ceil(df.count() / size))
    rows = df.where(F.col(vector).isNotNull()).select(F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).alias("r"), F.pmod(F.xxhash64(key), F.lit(n)).alias("block"))
    packed = rows.groupBy("block").agg(F.collect_list("r").alias("rows"))
    packed = packed.repartitionById(parts := min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), (F.col("block") % parts).cast("int")) if spread else packed
    return packed.select(F.col("rows.k").alias("keys"), F.col("rows.v").alias("vectors"))


def block_pairs(left: DataFrame, right: DataFrame, size: int = BLOCK, keys: tuple[str, str] = ("id", "id"), vector: str = "vector", spread: bool = False) -> DataFrame:
    """Blocks of left against blocks of right: keys_a, vectors_a, keys_b, vectors_b."""
    a = blocks(left, keys[0], vector, size, spread).select(F.col("keys").alias("keys_a"), F.col("vectors").alias("vectors_a"))
    b = blocks(right, keys[1], vector, size, spread).select(F.col("keys").alias("keys_b"), F.col("vectors").alias("vectors_b"))
    return a.crossJoin(b)


def whole_matrix(x: pa.Array) -> np.ndarray:
    """Vectors as rows; raises where lengths differ or a component is null."""
    values, sizes = x.flatten(), x.value_lengths().to_numpy(zero_copy_only=False)
    if values.null_count or len(np.unique(sizes)) > 1:
        raise ValueError("vectors differ in length or miss a component")
    return values.to_numpy(zero_copy_only=False).reshape(len(x), -1)


#: Rows that pairwise gives at once.
PAIRS = 1 << 19


def pairwise(left: DataFrame, right: DataFrame, metric: str, vector: str = "vector") -> DataFrame:
    """(a, b, distance) of all pairs; meant for a stated set against a table.

    There are as many rows as the product of both, which is what grows; blocks are spread so that tasks share it, and a task holds
    PAIRS of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ka, kb = (batch[c][row].values.to_numpy(zero_copy_only=False) for c in ("keys_a", "keys_b"))
                va, vb = (whole_matrix(batch[c][row].values) for c in ("vectors_a", "vectors_b"))
                size = max(1, PAIRS // len(kb))
                for s in (slice(i, i + size) for i in range(0, len(ka), size)):
                    d = distances(va[s], vb, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ka[s], len(kb)), pa.int64()), pa.array(np.tile(kb, len(d)), pa.int64()), pa.array(d.ravel(), pa.float64())], names=["a", "b", "distance"])

    return block_pairs(left, right, vector=vector, spread=True).mapInArrow(task, "a long, b long, distance double")


def k_best(ka: list, va: list, kb: list, vb: list, k: int, metric: str = "l2", others_only: bool = False) -> pa.RecordBatch:
    """(a, b, distance): of one block, the k nearest in another block, ties by key."""
    ka, kb = np.array(ka), np.array(kb)
    order = np.argsort(kb)
    kb, d = kb[order], distances(np.array(va, float), np.array(vb, float)[order], metric)
    if others_only:
        d[ka[:, None] == kb] = np.inf
    best = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
    value = np.take_along_axis(d, best, 1)
    good = np.isfinite(value).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ka, best.shape[1])[good], pa.int64()), pa.array(kb[best].ravel()[good], pa.int64()), pa.array(value.ravel()[good], pa.float64())], names=["a", "b", "distance"])


#: Neighbours that a task holds before it keeps each query's best.
HELD = 500_000


def keep_best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of many blocks -> each query's k best, ties by key, so that a task gives k rows a query, not k rows a block.

    Where a task meets so many queries that even their best are more than HELD, it gives those and goes on."""
    held, rows = [], 0

    def best() -> pa.RecordBatch:
        a, b, d = (np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b", "distance"))
        order = np.lexsort((b, np.round(d, 9), a))
        a, b, d = a[order], b[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        good = place < k
        return pa.RecordBatch.from_arrays([pa.array(a[good], pa.int64()), pa.array(b[good], pa.int64()), pa.array(d[good], pa.float64())], names=["a", "b", "distance"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > HELD:
            held = [best()]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield held[0]
                held, rows = [], 0
    if held:
        yield best()


def nearest(queries: DataFrame, data: DataFrame, k: int, metric: str = "l2", vector: str = "vector", others_only: bool = False) -> DataFrame:
    """(a, b, distance, rank): the k nearest of each query, ties by key; each pair of blocks keeps its k best first, then each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ka, va, kb, vb in zip(*(batch[c].to_pylist() for c in ("keys_a", "vectors_a", "keys_b", "vectors_b")), strict=True):
                yield k_best(ka, va, kb, vb, k, metric, others_only)

    partial = block_pairs(queries, data, vector=vector).mapInArrow(lambda batches: keep_best(task(batches), k), "a long, b long, distance double")
    best = partial.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("distance", 9).alias("d"), "b", "distance"))), 1, k).alias("best"))  # k rows for each task
    return best.select("a", F.posexplode("best").alias("rank", "r")).select("a", "r.b", "r.distance", (F.col("rank") + 1).alias("rank"))


def ratio_match(queries: DataFrame, data: DataFrame, ratio: float = 1.5, vector: str = "vector") -> DataFrame:
    """(a, b, distance) where the nearest is closer than every other by ratio."""
    two = nearest(queries, data, 2, vector=vector).groupBy("a").agg(F.min_by("b", "rank").alias("b"), F.min("distance").alias("distance"), F.max("distance").alias("second"), F.count("*").alias("n"))
    return two.where((F.col("n") < 2) | (F.col("distance") * ratio <= F.col("second"))).select("a", "b", "distance")


def squared_distance(x: Column, centre: list[float]) -> Column:
    c = F.array(*map(F.lit, centre))
    return F.aggregate(F.zip_with(x, c, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v)


def assign(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """Adds cluster (nearest centre, smallest number on ties) and its squared distance."""
    best = F.array_min(F.array(*(F.struct(squared_distance(F.col(vector), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
    return df.withColumn("_b", best).withColumns({"cluster": F.col("_b.i"), "distance": F.col("_b.d")}).drop("_b")


def kmeans_l2(df: DataFrame, vector: str, centres: list[list[float]], steps: int, tolerance: float = 1e-9) -> tuple[list[list[float]], list[float]]:
    """Lloyd steps from given centres: (centres, energy at each step). A step is one aggregate; empty clusters keep their centre."""
    energies: list[float] = []
    for _ in range(steps):
        def task(batches: Iterator[pa.RecordBatch], centres=np.array(centres)) -> Iterator[pa.RecordBatch]:
            n, total, energy = np.zeros(len(centres)), np.zeros_like(centres), np.zeros(len(centres))
            for batch in batches:
                x = np.array(batch["x"].to_pylist(), float)
                d = distances(x, centres, "l2")
                own = d.argmin(1)
                np.add.at(n, own, 1)
                np.add.at(total, own, x)
                np.add.at(energy, own, d[np.arange(len(x)), own])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(n), pa.array(list(total), pa.list_(pa.float64())), pa.array(energy)], names=["c", "n", "total", "energy"])

        part = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(task, "c int, n double, total array<double>, energy double")
        dims = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(len(centres[0]))]
        rows = {r["c"]: r for r in part.groupBy("c").agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"), *dims).collect()}  # one row per centre
        energies.append(sum(r["energy"] for r in rows.values()))
        new = [[rows[c][f"t{i}"] / rows[c]["n"] for i in range(len(centres[0]))] if c in rows and rows[c]["n"] else centres[c] for c in range(len(centres))]
        if max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)) < tolerance:
            break
        centres = new
    return centres, energies


def absolute_distance(x: Column, centre: list[float]) -> Column:
    c = F.array(*map(F.lit, centre))
    return F.aggregate(F.zip_with(x, c, lambda p, q: F.abs(p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v)


def assign_l1(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """Adds cluster (nearest centre by L1, smallest number on ties) and its L1 distance."""
    best = F.array_min(F.array(*(F.struct(absolute_distance(F.col(vector), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
    return df.withColumn("_b", best).withColumns({"cluster": F.col("_b.i"), "distance": F.col("_b.d")}).drop("_b")


def kmeans_l1(df: DataFrame, vector: str, centres: list[list[float]], steps: int, tolerance: float = 1e-9) -> tuple[list[list[float]], list[float]]:
    """k-medians steps from given centres: (centres, energy at each step). A new centre is the median of each dimension; empty clusters keep theirs."""
    energies: list[float] = []
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))
    for _ in range(steps):
        own = assign_l1(rows, "x", centres)
        energies.append(own.agg(F.sum("distance")).first()[0] or 0.0)
        medians = own.select("cluster", F.posexplode("x").alias("dim", "v")).groupBy("cluster", "dim").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()  # clusters x dims
        new = [list(c) for c in centres]
        for r in medians:
            new[r["cluster"]][r["dim"]] = r["m"]
        if max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)) < tolerance:
            break
        centres = new
    return centres, energies


def plus_plus(df: DataFrame, vector: str, key: str, k: int, seed: int = 1) -> list[list[float]]:
    """k starting centres: each next one drawn with weight of its squared distance to those before (largest of weighted seeded hashes)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    centres = [list(rows.orderBy(u, key).select(vector).first()[0])]
    while len(centres) < k:
        gain = F.log(u) / F.greatest(F.array_min(F.array(*(squared_distance(F.col(vector), c) for c in centres))), F.lit(1e-300))
        centres.append(list(rows.orderBy(F.desc(gain), key).select(vector).first()[0]))
    return centres


def hierarchical(df: DataFrame, vector: str, key: str, branch: int, depth: int, steps: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """Adds path: the branch taken at each level; all nodes of a level are split in one pass per step.

    A node starts at its branch rows of least hash; one with fewer rows keeps those as its centres. The centres of a level,
    branch^level times dims numbers, travel with the tasks.
    """
    rows = materialize(df.withColumn("path", F.array().cast("array<int>")), "paths")
    for _ in range(depth):
        first = Window.partitionBy("path").orderBy(F.xxhash64(key), key)
        starts = rows.where(F.col(vector).isNotNull()).select("path", key, F.col(vector).cast("array<double>").alias("_x")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= branch)
        centres: dict[tuple[int, ...], list[list[float]]] = {}
        for r in starts.select("path", "_r", "_x").orderBy("path", "_r").collect():  # branch rows a node
            centres.setdefault(tuple(r["path"]), []).append(list(r["_x"]))
        going = {p for p, c in centres.items() if len(c) == branch}
        for _ in range(steps):
            if not going:
                break
            sums = node_sums(rows, vector, {p: np.array(centres[p]) for p in going})
            for p in list(going):
                new = [(sums[p, c][1] / sums[p, c][0]).tolist() if (p, c) in sums else centres[p][c] for c in range(branch)]
                if max(abs(a - b) for x, y in zip(new, centres[p], strict=True) for a, b in zip(x, y, strict=True)) < tolerance:
                    going.discard(p)
                else:
                    centres[p] = new
        rows = materialize(rows.withColumn("path", F.concat("path", F.array(nearest_of_node(vector, {p: np.array(c) for p, c in centres.items()})))), "paths")
    return rows


def _matrix(x: pa.Array) -> np.ndarray:
    """Vectors of one length, none of them null, as rows."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _by_node(paths: pa.Array, known: dict[tuple[int, ...], int]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(node, rows of it): paths are of one length, so their distinct rows are the nodes."""
    steps = paths.flatten().to_numpy(zero_copy_only=False).reshape(len(paths), -1) if len(paths) else np.empty((0, 0), np.int32)
    if not steps.shape[1]:
        nodes, own = np.empty((min(len(paths), 1), 0), np.int32), np.zeros(len(paths), np.int64)
    else:
        nodes, own = np.unique(steps, axis=0, return_inverse=True)
    order = np.argsort(own.ravel(), kind="stable")
    edges = np.searchsorted(own.ravel()[order], np.arange(len(nodes) + 1))
    for i, node in enumerate(map(tuple, nodes.tolist())):
        if node in known:
            yield node, order[edges[i] : edges[i + 1]]


def node_sums(rows: DataFrame, vector: str, centres: dict[tuple[int, ...], np.ndarray]) -> dict[tuple[tuple[int, ...], int], tuple[float, np.ndarray]]:
    """(node, centre) -> (rows, sum of vectors), for the rows whose path is one of the nodes, in one pass; a task gives one sum each."""
    nodes = sorted(centres)
    number = {p: i for i, p in enumerate(nodes)}
    branch, dims = centres[nodes[0]].shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), branch, dims + 1))
        for batch in batches:
            x = _matrix(batch["x"])
            for p, own in _by_node(batch["path"], number):
                near = np.eye(branch)[distances(x[own], centres[p], "l2").argmin(1)]
                total[number[p]] += near.T @ np.column_stack([x[own], np.ones(len(own))])
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some])], names=["at", "v"])

    part = rows.where(F.col(vector).isNotNull()).select("path", F.col(vector).cast("array<double>").alias("x")).mapInArrow(task, "at long, v double")
    sums = np.zeros((len(nodes), branch, dims + 1))
    for at, v in part.groupBy("at").agg(F.sum("v")).collect():  # branch x (dims + 1) rows a node
        sums.ravel()[at] = v
    return {(p, c): (sums[i, c, dims], sums[i, c, :dims]) for p, i in number.items() for c in range(branch) if sums[i, c, dims]}


def nearest_of_node(vector: str, centres: dict[tuple[int, ...], np.ndarray]) -> Column:
    """The number of the nearest of a row's node's centres (the smallest on ties); null without vector."""

    @F.arrow_udf("int")
    def own(path: pa.Array, x: pa.Array) -> pa.Array:
        known = x.is_valid()
        at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
        out, values = np.zeros(len(x), np.int32), _matrix(x.filter(known))
        for p, rows in _by_node(path.filter(known), centres):
            out[at[rows]] = distances(values[rows], centres[p], "l2").argmin(1)
        return pa.array(out, mask=~known.to_numpy(zero_copy_only=False))

    return own(F.col("path"), F.col(vector).cast("array<double>"))


def vlad(df: DataFrame, group: str, vector: str, centres: list[list[float]], normalise: bool = True, mass: bool = False, root: bool = False, per_component: bool = False) -> DataFrame:
    """(group, cluster, dim, value): sums of differences to the nearest centre.

    In this order, where asked for: mass divides a cluster by its number of vectors, root takes signed square roots,
    per_component scales each cluster to norm 1, normalise each group.
    """
    own = assign(df, vector, centres).select(group, "cluster", F.posexplode(vector).alias("dim", "x"))
    flat = F.array(*(F.array(*map(F.lit, c)) for c in centres))
    diff = F.col("x").cast("double") - F.element_at(F.element_at(flat, F.col("cluster") + 1), F.col("dim") + 1)
    sums = own.groupBy(group, "cluster", "dim").agg(F.sum(diff).alias("value"), F.count("*").alias("_m"))
    sums = sums.withColumn("value", F.col("value") / F.col("_m")) if mass else sums
    sums = signed_root(sums, "value") if root else sums
    sums = unit_norm(sums, [group, "cluster"], ["value"]) if per_component else sums
    return (unit_norm(sums, [group], ["value"]) if normalise else sums).select(group, "cluster", "dim", "value")


def signed_root(df: DataFrame, *values: str) -> DataFrame:
    return df.withColumns({v: F.signum(v) * F.sqrt(F.abs(v)) for v in values})


def unit_norm(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Values over the root of their sum of squares in each group; a group of zeros stays."""
    norm = df.groupBy(*by).agg(F.sqrt(sum((F.sum(F.col(v) * F.col(v)) for v in values), F.lit(0.0))).alias("_n"))
    return df.join(norm, by).withColumns({v: F.when(F.col("_n") > 0, F.col(v) / F.col("_n")).otherwise(0.0) for v in values}).drop("_n")


def posteriors(vector: str, means: list[list[float]], variances: list[list[float]], weights: list[float]) -> Column:
    """Each component's share of a vector in a diagonal Gaussian mixture, an array."""
    x = F.transform(vector, lambda v: v.cast("double"))
    logs = []
    for m, s, w in zip(means, variances, weights, strict=True):
        constant = math.log(w) - 0.5 * sum(math.log(2 * math.pi * v) for v in s)
        ms = F.array(*(F.struct(F.lit(a).alias("m"), F.lit(b).alias("s")) for a, b in zip(m, s, strict=True)))
        logs.append(F.lit(constant) - 0.5 * F.aggregate(F.zip_with(x, ms, lambda v, p: (v - p["m"]) * (v - p["m"]) / p["s"]), F.lit(0.0), lambda t, v: t + v))
    return F.transform(F.array(F.array(*logs)), lambda l: F.transform(l, lambda v: 1 / F.aggregate(F.transform(l, lambda u: F.exp(u - v)), F.lit(0.0), lambda t, u: t + u)))[0]


def fisher(df: DataFrame, group: str, vector: str, means: list[list[float]], variances: list[list[float]], weights: list[float], normalise: bool = False, root: bool = False) -> DataFrame:
    """(group, cluster, dim, u, v): gradient statistics against a diagonal Gaussian mixture; root and normalise together are the improved form."""
    x = F.transform(vector, lambda v: v.cast("double"))
    rows = df.withColumn("_q", posteriors(vector, means, variances, weights))
    parts = rows.select(group, x.alias("_x"), F.posexplode("_q").alias("cluster", "q")).select(group, "cluster", "q", F.posexplode("_x").alias("dim", "x"))
    table = [(k, d, means[k][d], math.sqrt(variances[k][d]), weights[k]) for k in range(len(means)) for d in range(len(means[0]))]
    model = df.sparkSession.createDataFrame(table, "cluster int, dim int, mean double, sd double, weight double")  # clusters x dims rows
    parts = parts.join(F.broadcast(model), ["cluster", "dim"]).withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    sums = parts.groupBy(group, "cluster", "dim", "weight").agg(F.sum(F.col("q") * F.col("z")).alias("su"), F.sum(F.col("q") * (F.col("z") * F.col("z") - 1)).alias("sv")).join(n, group)
    out = sums.select(group, "cluster", "dim", (F.col("su") / (F.col("_n") * F.sqrt("weight"))).alias("u"), (F.col("sv") / (F.col("_n") * F.sqrt(2 * F.col("weight")))).alias("v"))
    out = signed_root(out, "u", "v") if root else out
    return unit_norm(out, [group], ["u", "v"]) if normalise else out


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov): sample covariance of the dimensions; a task sends one partial matrix."""
    n, mean, second = gram(df, vector)
    cov = (second - n * np.outer(mean, mean)) / max(n - 1, 1)
    d = len(mean)
    return df.sparkSession.createDataFrame([(i, j, float(cov[i, j])) for i in range(d) for j in range(d)], "i int, j int, cov double")  # dims² rows


def gram(df: DataFrame, vector: str) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, sum of outer products), in one pass with partial sums per task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float)
            if len(x):
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            d = len(s)
            names = np.concatenate([[-1], np.arange(d), d + np.arange(d * d)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([[n], s, g.ravel()]), pa.float64())], names=["at", "v"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # dims² sums
    values = {r["at"]: r["v"] for r in rows}
    n = values.pop(-1)
    d = round((math.sqrt(1 + 4 * len(values)) - 1) / 2)
    return n, np.array([values[i] for i in range(d)]) / n, np.array([values[d + i] for i in range(d * d)]).reshape(d, d)


def principal(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, all modes as rows, variances), leading ones first; the eigenproblem is dims x dims."""
    n, mean, second = gram(df, vector)
    values, modes = np.linalg.eigh((second - n * np.outer(mean, mean)) / max(n - 1, 1))
    modes = modes[:, ::-1].T
    return mean, modes * np.sign(modes[np.arange(len(modes)), np.abs(modes).argmax(1)])[:, None], values[::-1]


def mapped(values: Column, fn: Callable[[np.ndarray], np.ndarray], dims: int) -> Column:
    """fn of the matrix of a batch's arrays (dims numbers each) as arrays; null stays null.

    Column functions would be copied into each lambda that uses them, so that a few products in a row take dims³ steps."""

    @F.arrow_udf("array<double>")
    def of(x: pa.Array) -> pa.Array:
        known = x.is_valid()
        out = fn(x.filter(known).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
        ends = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False)) * out.shape[1]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel(), pa.float64()), mask=x.is_null())

    return of(values.cast("array<double>"))


def project(df: DataFrame, vector: str, modes: np.ndarray, mean: np.ndarray, out: str = "projected") -> DataFrame:
    """Adds the scores of vectors on modes (rows), less those of the mean."""
    return df.withColumn(out, mapped(F.col(vector), lambda x: (x - mean) @ modes.T, len(mean)))


def pca(df: DataFrame, vector: str, k: int, out: str = "projected") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with the k leading projections, modes as rows, variances)."""
    mean, modes, values = principal(df, vector)
    return project(df, vector, modes[:k], mean, out), modes[:k], values[:k]


SPECTRA = {
    "chi2": lambda f: 1 / math.cosh(math.pi * f),
    "intersection": lambda f: 2 / (math.pi * (1 + 4 * f * f)),
    "js": lambda f: 2 / math.log(4) / math.cosh(math.pi * f) / (1 + 4 * f * f),
}


def kernel_map(values: Column, order: int = 1, period: float = 0.6, kernel: str = "chi2") -> Column:
    """Features whose inner products approximate a kernel of SPECTRA: 2·order + 1 for each value; negative values map oddly."""
    spectrum = [period * SPECTRA[kernel](j * period) for j in range(order + 1)]
    def of(v: Column) -> Column:
        size, sign = F.abs(v.cast("double")), F.signum(v.cast("double"))
        parts = [sign * F.sqrt(size * spectrum[0])]
        for j in range(1, order + 1):
            angle = j * period * F.log(F.greatest(size, F.lit(1e-300)))
            parts += [sign * F.sqrt(2 * size * spectrum[j]) * F.cos(angle), sign * F.sqrt(2 * size * spectrum[j]) * F.sin(angle)]
        return F.array(*parts)

    return F.flatten(F.transform(values, of))


#: About how many points of a cell are compared together, and how many distances are held at once.
CROWD, SLICE = 4096, 1 << 15


def near_points(points: DataFrame, side: float, reach: float, start: Callable[[dict], tuple], step: Callable[[dict, dict, tuple], None], fields: str) -> DataFrame:
    """Folds step over all that lies in reach of the points (a, x, y and more columns; written once), in square cells.

    A cell's points are arrays in one row, or in several by hash of a where there are more than CROWD. Each row meets those of all
    cells in reach: start(own) gives arrays, one for each of fields, that step(own, other, arrays) changes in place. own and
    other are the columns of both rows, by a. (a, fields) has a row for each point, or a few where a row's partners aren't in sequence.
    """
    side *= 1 + 1e-9  # else rounding could put points in reach one cell too far
    columns, place = points.columns, ["i", "j", "part"]
    cells = points.select(F.floor(F.col("x") / side).alias("i"), F.floor(F.col("y") / side).alias("j"), F.struct(*columns).alias("r"))
    crowded = materialize(cells.groupBy("i", "j").agg(F.ceil(F.count("*") / CROWD).alias("parts")).where("parts > 1"), "crowded")
    many = not crowded.isEmpty()
    parts = F.coalesce("parts", F.lit(1)) if many else F.lit(1)
    cells = cells.join(crowded, ["i", "j"], "left") if many else cells
    rows = cells.groupBy("i", "j", F.pmod(F.xxhash64("r.a"), parts).alias("part")).agg(F.sort_array(F.collect_list("r")).alias("r"))
    rows = materialize(rows.select(*place, *(F.col(f"r.{c}").alias(c) for c in columns)), "cells")
    far, last = (lambda p: max(abs(p) - 1, 0)), math.ceil(reach / side)
    around = [(p, q) for p in range(-last, last + 1) for q in range(-last, last + 1) if (far(p) ** 2 + far(q) ** 2) * side * side <= reach * reach * (1 + 1e-6)]
    to = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in around)))
    sent = rows.withColumn("to", to).select((F.col("i") + F.col("to.p")).alias("i"), (F.col("j") + F.col("to.q")).alias("j"), *(F.col(c).alias(f"_{c}") for c in columns))
    sent = sent.join(crowded, ["i", "j"], "left") if many else sent
    sent = sent.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).drop("parts")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as the work grows faster than the bytes
    both = rows.repartition(n, *place).join(sent.repartition(n, *place), place)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held = None, {}, ()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own["a"]), *(pa.array(v) for v in held)], names=["a", *(f.split()[0] for f in fields.split(", "))])

        for batch in batches:
            for k, now in enumerate(zip(*(batch[c].to_pylist() for c in place), strict=True)):
                if now != at:
                    if at is not None:
                        yield out()
                    at, own = now, {c: batch[c][k].values.to_numpy(zero_copy_only=False) for c in columns}
                    held = start(own)
                step(own, {c: batch[f"_{c}"][k].values.to_numpy(zero_copy_only=False) for c in columns}, held)
        if at is not None:
            yield out()

    return both.mapInArrow(task, f"a {points.schema['a'].dataType.simpleString()}, {fields}")


def squares(own: dict, other: dict) -> Iterator[tuple[slice, np.ndarray]]:
    """(some of own, their squared distances to all of other)."""
    size = max(1, SLICE // len(other["x"]))
    for s in (slice(i, i + size) for i in range(0, len(own["x"]), size)):
        dx, dy = own["x"][s, None] - other["x"], own["y"][s, None] - other["y"]
        dx *= dx
        dy *= dy
        dx += dy
        yield s, dx


def quick_shift(df: DataFrame, key: str, x: str, y: str, sigma: float, reach: float, weight: str | None = None) -> DataFrame:
    """(key, density, parent): Parzen density (weighted by a column, if one is named) of a kernel cut at three sigmas or reach, and the nearest denser point within reach (null: a mode)."""
    width = max(3 * sigma, reach)
    points = df.select(F.col(key).alias("a"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("w"))
    points = materialize(points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))), "points")
    most = points.groupBy(*(F.floor(F.col(c) / width) for c in "xy")).count().agg(F.max("count")).first()[0] or 0
    side = width / 4 if most > CROWD // 4 else width  # small cells spare distances where there are many points, and rows where there are few

    def add(own: dict, other: dict, held: tuple) -> None:
        for s, d2 in squares(own, other):
            kernel = np.exp(d2 * (-1 / (2 * sigma * sigma)))
            kernel *= d2 <= width * width
            held[0][s] += kernel @ other["w"]

    density = near_points(points, side, width, lambda own: (np.zeros(len(own["x"])),), add, "density double")
    density = materialize(density.groupBy("a").agg(F.round(F.sum("density"), 9).alias("density")), "density")

    def nearer(own: dict, other: dict, held: tuple) -> None:
        best, parent = held
        for s, d2 in squares(own, other):
            mine, a = own["density"][s, None], own["a"][s, None]
            d2[(d2 > reach * reach) | (other["density"] < mine) | ((other["density"] == mine) & (other["a"] >= a))] = np.inf
            at = d2.argmin(1)  # the first of equal ones, which has the least key
            least, b = d2[np.arange(len(d2)), at], other["a"][at]
            good = np.flatnonzero((least < best[s]) | (np.isfinite(least) & (least == best[s]) & (b < parent[s])))
            best[s][good], parent[s][good] = least[good], b[good]

    ranked = points.drop("w").join(density, "a")
    parent = near_points(ranked, side, reach, lambda own: (np.full(len(own["x"]), np.inf), own["a"].copy()), nearer, f"d2 double, b {points.schema['a'].dataType.simpleString()}")
    parent = parent.where(F.col("d2") < float("inf")).groupBy("a").agg(F.min_by("b", F.struct("d2", "b")).alias("parent"))
    return density.join(parent, "a", "left").select(F.col("a").alias(key), "density", "parent")


def roots(links: DataFrame, key: str, parent: str = "parent", rounds: int = 40) -> DataFrame:
    """(key, root) by pointer doubling; raises if rounds don't settle it."""
    now = materialize(links.select(F.col(key).alias("k"), F.coalesce(parent, key).alias("r")), "roots")
    for _ in range(rounds):
        up = now.select(F.col("k").alias("r"), F.col("r").alias("up"))
        after = materialize(now.join(up, "r").select("k", F.col("up").alias("r"), (F.col("up") != F.col("r")).alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select(F.col("k").alias(key), F.col("r").alias("root"))
        now = after.drop("moved")
    raise RuntimeError("pointer doubling isn't settled")


def gmm_diag(df: DataFrame, vector: str, means: list[list[float]], variances: list[list[float]], weights: list[float], steps: int, floor: float = 1e-6) -> tuple[list[list[float]], list[list[float]], list[float], list[float]]:
    """EM for a mixture of diagonal Gaussians from a given start: (means, variances, weights, log-likelihood before each step)."""
    likelihood: list[float] = []
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))
    for _ in range(steps):
        def task(batches: Iterator[pa.RecordBatch], m=np.array(means), s=np.array(variances), w=np.array(weights)) -> Iterator[pa.RecordBatch]:
            k, d = m.shape
            n, one, two, total = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0
            for batch in batches:
                x = np.array(batch["x"].to_pylist(), float)
                if not len(x):
                    continue
                log = np.log(w) - 0.5 * (np.log(2 * np.pi * s).sum(1) + (((x[:, None] - m) ** 2) / s).sum(2))
                top = log.max(1)
                q = np.exp(log - top[:, None])
                total += float((top + np.log(q.sum(1))).sum())
                q /= q.sum(1)[:, None]
                n, one, two = n + q.sum(0), one + q.T @ x, two + q.T @ (x * x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + k + 2 * k * d), pa.int32()), pa.array(np.concatenate([[total], n, one.ravel(), two.ravel()]))], names=["at", "v"])

        sums = {r["at"]: r["v"] for r in rows.mapInArrow(task, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # components x dims sums
        v = np.array([sums[i] for i in range(len(sums))])
        k, d = len(means), len(means[0])
        n, one, two = np.maximum(v[1 : 1 + k], 1e-12), v[1 + k : 1 + k + k * d].reshape(k, d), v[1 + k + k * d :].reshape(k, d)
        likelihood.append(float(v[0]))
        m = one / n[:, None]
        means, variances, weights = m.tolist(), np.maximum(two / n[:, None] - m * m, floor).tolist(), (n / n.sum()).tolist()
    return means, variances, weights, likelihood


def kmeans_repeated(df: DataFrame, vector: str, key: str, k: int, steps: int, repetitions: int, metric: str = "l2") -> tuple[list[list[float]], list[float]]:
    """The run of least final energy among k-means++ starts with seeds 1, 2, ...; metric l2 (means) or l1 (medians)."""
    run = {"l2": kmeans_l2, "l1": kmeans_l1}[metric]
    runs = [run(df, vector, plus_plus(df, vector, key, k, seed), steps) for seed in range(1, repetitions + 1)]
    return min(runs, key=lambda r: r[1][-1])


def gmm_start(df: DataFrame, vector: str, centres: list[list[float]], floor: float = 1e-6) -> tuple[list[list[float]], list[list[float]], list[float]]:
    """(means, variances, weights) of the clusters of some centres: a start for gmm_diag."""
    own = assign(df.where(F.col(vector).isNotNull()), vector, centres).select("cluster", F.posexplode(vector).alias("dim", "x"))
    rows = own.groupBy("cluster", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"), F.count("*").alias("n")).collect()  # clusters x dims
    means, variances, sizes = [list(c) for c in centres], [[1.0] * len(c) for c in centres], [0.0] * len(centres)
    for r in rows:
        means[r["cluster"]][r["dim"]], variances[r["cluster"]][r["dim"]], sizes[r["cluster"]] = r["m"], max(r["s"], floor), float(r["n"])
    total = sum(sizes) or 1.0
    return means, variances, [max(n / total, 1e-12) for n in sizes]


def modes_for(variances: np.ndarray, share: float) -> int:
    """How many leading modes hold that share of the variance; at least one."""
    held = np.cumsum(variances) / max(variances.sum(), 1e-300)
    return min(int(np.searchsorted(held, share - 1e-12)) + 1, len(variances))


def pca_back(df: DataFrame, projected: str, modes: np.ndarray, mean: np.ndarray, out: str = "restored", keep: list[int] | None = None) -> DataFrame:
    """Adds the vectors that projections stand for: mean + sum of score times mode; keep: only those modes (a mode filter)."""
    used = modes if keep is None else np.where(np.isin(np.arange(len(modes)), keep)[:, None], modes, 0)
    return df.withColumn(out, mapped(F.col(projected), lambda x: x @ used + mean, len(modes)))


def svd(df: DataFrame, vector: str, k: int, out: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with the k left singular values' coordinates of each row, singular values, right vectors as rows) of the table, not centred."""
    _, _, second = gram(df, vector)
    values, modes = np.linalg.eigh(second)
    values, modes = np.sqrt(np.maximum(values[::-1][:k], 0)), modes[:, ::-1].T[:k]
    modes = modes * np.sign(modes[np.arange(len(modes)), np.abs(modes).argmax(1)])[:, None]
    x = F.col(vector).cast("array<double>")
    left = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, m.tolist())), lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v) / float(v0) if v0 > 0 else F.lit(0.0) for m, v0 in zip(modes, values, strict=True)]
    return df.withColumn(out, F.array(*left)), values, modes


def tree_cut(links: DataFrame, points: DataFrame, key: str, x: str, y: str, reach: float) -> DataFrame:
    """links (key, parent) of quick_shift without those longer than reach: what hangs on them becomes trees of their own."""
    at = points.select(F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    both = links.join(at, F.col(key) == F.col("_k"), "left").drop("_k").withColumnsRenamed({"_x": "_ax", "_y": "_ay"}).join(at, F.col("parent") == F.col("_k"), "left")
    d2 = F.pow(F.col("_ax") - F.col("_x"), F.lit(2)) + F.pow(F.col("_ay") - F.col("_y"), F.lit(2))
    return both.select(*[c for c in links.columns if c != "parent"], F.when(d2 <= reach * reach, F.col("parent")).alias("parent"))
