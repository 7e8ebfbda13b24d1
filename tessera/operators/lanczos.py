"""Leading singular vectors of a table of vectors by block Lanczos steps and QR by a tree of small factors.

A random block of directions is carried through the table and back a few times; the bases of all steps, side by side, span
nearly the leading singular vectors. The product of the table with itself is never formed, so small singular values keep
their digits. Rows lie in blocks; every block's basis is factored on its own, the small triangular factors are combined
FAN at a time up a tree, and the rotations go down the same way, so orthonormal columns don't depend on how badly
conditioned the basis is. What reaches the driver is as large as a few vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

ROWS, FAN = 1024, 64
FACTOR = "block long, r binary"
SLICE = "block long, parent long, q binary, r binary"


def matrix_blocks(df: DataFrame, key: str, vector: str, rows: int = ROWS) -> DataFrame:
    """(block, ids, a): written once; rows with a null vector are left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                flat = part["v"].flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part["id"].to_pylist()], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary())], ["block", "ids", "a"])
                at += 1

    held = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return materialize(held.mapInArrow(task, "block long, ids array<long>, a binary"), "matrix")


def factored(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """QR with as many columns as x, short blocks filled up with zeros."""
    q, r = np.linalg.qr(x)
    n = x.shape[1]
    if r.shape[0] < n:
        q, r = np.column_stack([q, np.zeros((len(q), n - q.shape[1]))]), np.vstack([r, np.zeros((n - r.shape[0], n))])
    return q, r


def _dense(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, columns)


def rotations(factors: DataFrame, columns: int) -> tuple[DataFrame, np.ndarray]:
    """(block, r) of all blocks -> (block, q): by what each block's own basis has to be multiplied for the columns of all blocks to
    be orthonormal; and the triangular factor of the whole."""
    levels: list[DataFrame] = []
    numbered = materialize(factors, "factors")
    while True:
        count = numbered.count()

        def combine(table: pa.Table) -> pa.Table:
            order = np.argsort(table["block"].to_numpy(), kind="stable")
            blocks, parts = table["block"].to_numpy()[order], [table["r"][int(i)].as_py() for i in order]
            q, r = factored(np.vstack([_dense(p, columns) for p in parts]))
            top = [r.tobytes()] + [None] * (len(parts) - 1)  # the group's factor stands in its first row
            return pa.table({"block": pa.array(blocks, pa.int64()), "parent": pa.array([int(blocks[0])] * len(blocks), pa.int64()),
                             "q": pa.array([q[i * columns : (i + 1) * columns].tobytes() for i in range(len(blocks))], pa.binary()), "r": pa.array(top, pa.binary())})

        groups = max(1, -(-count // FAN))
        group = F.pmod(F.xxhash64("block"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
        level = materialize(numbered.groupBy(group.alias("g")).applyInArrow(combine, SLICE), "level")
        levels.append(level)
        if groups == 1:
            break
        numbered = level.where("r IS NOT NULL").select(F.col("parent").alias("block"), "r")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [(_dense(a, columns) @ _dense(b, columns)).tobytes() for a, b in zip(batch["q"].to_pylist(), batch["above"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(q, pa.binary())], ["block", "q"])

    down = levels[-1].select("block", "q")
    for level in reversed(levels[:-1]):
        above = down.select(F.col("block").alias("parent"), F.col("q").alias("above"))
        down = materialize(level.join(above, "parent").select("block", "q", "above").mapInArrow(product, "block long, q binary"), "rotations")
    whole = _dense(levels[-1].where("r IS NOT NULL").first()["r"], columns)
    return down, whole


def _sum_of(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of (at, v) rows as an array."""
    out = np.zeros(size)
    for at, v in rows.groupBy("at").agg(F.sum("v")).collect():  # one row an element
        out[at] = v
    return out


def back_and_forth(blocks: DataFrame, basis: np.ndarray, rotation: DataFrame | None) -> np.ndarray:
    """Aᵀ Q for Q = (A basis) made orthonormal: each block's own factor times its rotation."""
    n, width = basis.shape
    sent = blocks.sparkSession.sparkContext.broadcast(basis)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for batch in batches:
            for a, turn in zip(batch["a"].to_pylist(), batch["q"].to_pylist(), strict=True):
                x = _dense(a, n)
                total += x.T @ (factored(x @ sent.value)[0] @ _dense(turn, width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * width), pa.int64()), pa.array(total.ravel())], ["at", "v"])

    return _sum_of(blocks.join(rotation, "block").select("a", "q").mapInArrow(task, "at long, v double"), n * width).reshape(n, width)


def own_factors(blocks: DataFrame, basis: np.ndarray) -> DataFrame:
    n, width = basis.shape
    sent = blocks.sparkSession.sparkContext.broadcast(basis)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = [factored(_dense(a, n) @ sent.value)[1].tobytes() for a in batch["a"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(r, pa.binary())], ["block", "r"])

    return blocks.select("block", "a").mapInArrow(task, FACTOR)


def block_lanczos(df: DataFrame, key: str, vector: str, k: int = 6, its: int = 2, block: int | None = None, seed: int = 0, rows: int = ROWS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((id, u) with k coordinates a row, k singular values, k right singular vectors as rows), not centred.

    block: directions carried along, k + 2 by default. Signs are such that a right vector's largest component is positive.
    Vectors must be of one length, of at least block components; rows with a null vector are left out; a table without vectors
    raises. k, its and block follow the reference: its = 0 uses the random block alone.
    """
    blocks = matrix_blocks(df, key, vector, rows)
    first = blocks.first()
    if first is None:
        raise ValueError("no vectors")
    n = len(first["a"]) // 8 // len(first["ids"])
    width = block or k + 2
    if not k <= width <= n:
        raise ValueError(f"k {k}, block {width}, components {n}")
    direction = np.random.default_rng(seed).uniform(-1, 1, (n, width))
    bases = [direction]
    for _ in range(its):
        turn, _ = rotations(own_factors(blocks, direction), width)
        # only the span counts: orthonormal directions keep every step's digits
        direction = np.linalg.qr(back_and_forth(blocks, direction, turn))[0]
        bases.append(direction)
    basis = np.column_stack(bases)[:, : n if n < width * len(bases) else None]
    if basis.shape[1] == n:  # as many directions as components: they span everything
        basis = np.eye(n)
    turn, _ = rotations(own_factors(blocks, basis), basis.shape[1])
    right, values, mix = np.linalg.svd(back_and_forth(blocks, basis, turn), full_matrices=False)
    right, values, mix = right[:, :k].T, values[:k], mix[:k].T
    signs = np.sign(right[np.arange(k), np.abs(right).argmax(1)])
    right, mix = right * signs[:, None], mix * signs
    sent = df.sparkSession.sparkContext.broadcast((basis, mix))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last = sent.value
        for batch in batches:
            for ids, a, q in zip(batch["ids"].to_pylist(), batch["a"].to_pylist(), batch["q"].to_pylist(), strict=True):
                u = factored(_dense(a, n) @ base)[0] @ (_dense(q, base.shape[1]) @ last)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(u), pa.list_(pa.float64()))], ["id", "u"])

    left = blocks.join(turn, "block").select("ids", "a", "q").mapInArrow(task, "id long, u array<double>")
    return left, values, right
