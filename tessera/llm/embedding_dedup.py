"""Embedding near-dedup by int8 tile products.

Unit vectors u are quantised to û = scale * q with 8-bit q; e = ‖u - û‖ is computed for each vector. For two vectors
|u·v - û·v̂| <= ‖û‖ e_v + e_u, so a pair whose integer product lies further below the threshold can't be linked. Tiles
(blocks of vectors against blocks) are multiplied in integers (exact, as sums of products stay below the mantissa), and
only pairs possibly above the threshold are recomputed in double precision.

Vectors are dealt to the cells of a few pivots and cells are cut to blocks of bounded size, so that a tile is skipped
where centre angle and radii prove that it holds no link; data without structure are compared throughout, which is
what comparing all vectors means. Blocks travel in the table's own precision; tasks quantise them. Equal vectors are one class with a multiplicity. A tile gives sums of links by vector
and a spanning forest of its links, never the pairs of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import documents_of, materialize
from .skew import skew_join

BLOCK, PIVOTS, MOST_PIVOTS, STRIP = 4096, 32, 4096, 512
#: Blocks of a panel; a task multiplies the blocks of two panels, so a block is sent once for a panel, not once for a block.
PANEL = 4
ENCODED = "vec_id long, dim int, cell int, digest binary, vector binary"
QUANT = np.dtype([("id", "<i8"), ("many", "<i8"), ("scale", "<f8"), ("err", "<f8"), ("norm", "<f8")])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error norm, norm of the quantised vector); the error norm is rounded up."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(unit - back, axis=1) + 1e-12, np.linalg.norm(back, axis=1) + 1e-12


def stored(df: DataFrame, vector_col: str) -> str:
    """How vectors travel: as 32-bit numbers where the table has no more, else as doubles. Sums are in doubles always."""
    return "<f4" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"


def encode(df: DataFrame, id_col: str, vector_col: str, pivots: np.ndarray) -> DataFrame:
    """Vectors that can have links, with their cell."""
    kind = stored(df, vector_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch["vec_id"], batch["vector"]
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == dim)
                x = np.array(lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float).reshape(-1, dim)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
                at, x, norm = at[good], x[good], norm[good]
                cell = (x / norm[:, None] @ pivots.T).argmax(1) if pivots.shape[1] == dim and len(pivots) and len(x) else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)), pa.array(np.full(len(at), dim), pa.int32()), pa.array(cell, pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary()), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                ], names=["vec_id", "dim", "cell", "digest", "vector"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null").mapInArrow(task, ENCODED)


BLOCKS = "block long, dim int, centre array<double>, radius double, data binary"


def unit_of(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1)[:, None]


def blocks(reps: DataFrame, kind: str) -> DataFrame:
    """One row per block: ids, multiplicities and vectors, with the block's centre and radius."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("data", pa.binary())])

    def task(key, table):
        table = table.take(pc.sort_indices(table, [("vec_id", "ascending")]))
        dim = table["dim"][0].as_py()
        x = np.frombuffer(b"".join(table["vector"].to_pylist()), kind).reshape(-1, dim)
        unit = unit_of(x)
        head = np.column_stack([table["vec_id"].to_numpy(), table["many"].to_numpy()]).astype("<i8")
        centre = unit.sum(0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-7
        return pa.table([[key[0].as_py()], [dim], [centre.tolist()], [radius], [len(x).to_bytes(8, "little") + head.tobytes() + x.tobytes()]], schema=schema)

    return reps.groupBy("block").applyInArrow(task, BLOCKS)


def unpack(data: bytes, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, multiplicities and bounds; quantised vectors; unit vectors in doubles) of a block."""
    n = int.from_bytes(data[:8], "little")
    own = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2)
    unit = unit_of(np.frombuffer(data, kind, n * dim, 8 + own.nbytes).reshape(n, dim))
    head = np.empty(n, QUANT)
    head["id"], head["many"] = own.T
    q, head["scale"], head["err"], head["norm"] = quantised(unit)
    return head, q, unit


def strip_links(a, b, rows: slice, cols, threshold: float) -> np.ndarray:
    """Boolean links of some vectors of block a to all of block b."""
    (head, _, unit), (other, _, unit_b), (qa, qb) = a, b, cols
    g = qa[rows] @ qb.T
    h = head[rows]
    upper = g * h["scale"][:, None].astype(g.dtype) * other["scale"].astype(g.dtype) + h["norm"][:, None].astype(g.dtype) * other["err"].astype(g.dtype)
    maybe = upper >= (threshold - 1e-5 - h["err"])[:, None].astype(g.dtype)
    i, j = np.nonzero(maybe)
    if not len(i):
        return maybe
    r, c = np.unique(i), np.unique(j)
    if len(i) * 8 > len(r) * len(c):
        maybe[np.ix_(r, c)] &= unit[rows][r] @ unit_b[c].T >= threshold
    else:
        maybe[i, j] = np.einsum("ij,ij->i", unit[rows][i], unit_b[j]) >= threshold
    return maybe


def strip_components(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns of a bipartite strip; every row and column has a link."""
    row, n = np.arange(links.shape[0]), links.shape[0]
    while True:
        col = np.where(links, row[:, None], n).min(0)
        new = np.where(links, col[None, :], n).min(1)
        if (new == row).all():
            return row, col
        row = new


class Forest(dict):
    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)


def tile(left: bytes, right: bytes | None, dim: int, threshold: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, links each, forest edges a, b); right None: the block against itself."""
    a = unpack(left, dim, kind)
    b = a if right is None else unpack(right, dim, kind)
    product = np.float32 if dim * 127 * 127 < 1 << 24 else float
    q = a[1].astype(product), b[1].astype(product)
    n_a, n_b = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
    forest = Forest()
    for s in range(0, len(a[0]), STRIP):
        rows = slice(s, min(s + STRIP, len(a[0])))
        links = strip_links(a, b, rows, q, threshold)
        if right is None:
            links[np.arange(links.shape[0]), np.arange(rows.start, rows.stop)] = False
        r, c = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
        if not len(r):
            continue
        links = links[np.ix_(r, c)]
        n_a[rows.start + r] += links @ b[0]["many"][c]
        if right is not None:
            n_b[c] += a[0]["many"][rows.start + r] @ links
        of_row, of_col = strip_components(links)
        ids = a[0]["id"][rows.start + r]
        for x, y in zip(ids.tolist(), ids[of_row].tolist(), strict=True):
            forest.join(x, y)
        for x, y in zip(b[0]["id"][c].tolist(), ids[of_col].tolist(), strict=True):
            forest.join(x, y)
    edges = [(x, forest.find(x)) for x in list(forest)]
    edges = np.array([e for e in edges if e[0] != e[1]], np.int64).reshape(-1, 2)
    ids, n = np.concatenate([a[0]["id"], b[0]["id"]]), np.concatenate([n_a, n_b])
    return ids[n > 0], n[n > 0], edges[:, 0], edges[:, 1]


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components have no links and stand alone, as have rows
    without id; vectors of different lengths are never linked; rows that repeat are vectors linked with each other; an
    empty table gives no rows; other columns are ignored.
    """
    total, kind = df.count(), stored(df, vector_col)
    pivots = pivots or max(PIVOTS, min(MOST_PIVOTS, math.isqrt(total) // 8))
    sample = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(vector_col).orderBy(F.xxhash64(id_col)).limit(pivots).collect()  # bounded by pivots
    found = [r[0] for r in sample if r[0] and all(v is not None and np.isfinite(v) for v in r[0]) and any(r[0])]
    dim = len(found[0]) if found else 0
    centres = np.array([v for v in found if len(v) == dim], float).reshape(-1, max(dim, 1))
    centres = centres / np.linalg.norm(centres, axis=1)[:, None] if len(centres) else centres

    encoded = materialize(encode(df, id_col, vector_col, centres), "encoded")
    classes = materialize(encoded.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
    reps = encoded.join(classes, (encoded.digest == classes.digest) & (encoded.vec_id == classes.rep)).drop(classes.digest).dropDuplicates(["vec_id", "digest"])
    sizes = materialize(reps.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts")), "cells")
    sizes = sizes.withColumn("first", F.sum("parts").over(Window.orderBy("dim", "cell")) - F.col("parts"))  # one row per vector length and pivot
    reps = reps.join(F.broadcast(sizes), ["dim", "cell"])
    number = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("long")
    packed = materialize(blocks(reps.select("vec_id", "dim", "many", "vector", number.alias("block")), kind), "blocks")

    meta = packed.select("block", "dim", "centre", "radius")
    # strips of blocks against all blocks, so that the pairs of one vector length are found in many tasks
    strips = max(1, math.ceil(packed.count() / STRIP))
    x = meta.withColumn("strip", F.pmod(F.xxhash64("block"), F.lit(strips))).alias("x")
    y = meta.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long")))).alias("y") if strips > 1 else meta.withColumn("strip", F.lit(0).cast("long")).alias("y")
    dot = F.aggregate(F.zip_with("x.centre", "y.centre", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    near = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))) <= F.col("x.radius") + F.col("y.radius") + F.lit(float(np.arccos(threshold)) + 1e-6)
    pairs = x.join(y, (F.col("x.dim") == F.col("y.dim")) & (F.col("x.strip") == F.col("y.strip")) & (F.col("x.block") <= F.col("y.block")) & near)
    panel = lambda c: F.floor(F.col(c) / F.lit(PANEL)).cast("long")
    pairs = materialize(pairs.select(panel("x.block").alias("p"), panel("y.block").alias("q"), F.col("x.block").alias("i"), F.col("y.block").alias("j")), "pairs")

    def task(sides: pa.Table, tiles: pa.Table) -> pa.Table:
        """All tiles between two panels: each block has been sent once, and is unpacked once more at most for each of its tiles."""
        held = dict(zip(sides["block"].to_pylist(), zip(sides["dim"].to_pylist(), sides["data"], strict=True), strict=True))
        out = []
        for i, j in zip(tiles["i"].to_pylist(), tiles["j"].to_pylist(), strict=True):
            (d, left), (_, right) = held[i], held[j]
            ids, n, a, b = tile(left.as_py(), None if i == j else right.as_py(), d, threshold, kind)
            out.append(pa.table({"a": np.concatenate([ids, a]), "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(a), pa.int64())]), "b": pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(b, pa.int64())])}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("a", "n", "b")})

    sent = pairs.select("p", "q", F.col("i").alias("block")).union(pairs.select("p", "q", F.col("j").alias("block"))).distinct()
    sent = sent.join(packed.select("block", "dim", "data"), "block")
    met = pairs.select(F.col("p").alias("u"), F.col("q").alias("v"), "i", "j")
    tiles = sent.groupBy("p", "q").cogroup(met.groupBy("u", "v")).applyInArrow(task, "a long, n long, b long")
    done = materialize(tiles, "tiles")
    counts = done.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = components(done.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    # by class first, so that a large class meets its result once
    found = classes.join(counts, "rep", "left").join(groups, "rep", "left").select("digest", "rep", "many", "n", "component")
    linked = skew_join(encoded.select("vec_id", "digest"), materialize(found, "found"), "digest", "many", total)
    linked = linked.select(F.col("vec_id").alias("v"), (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")).groupBy("v").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = df.select(F.col(id_col).cast("long").alias("vec_id")).join(linked, F.col("vec_id") == F.col("v"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(documents_of(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""
