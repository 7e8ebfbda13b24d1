"""Linear classifiers by stochastic dual coordinate ascent, with a duality gap as the measure of how far a fit is.

The objective is lam/2 |w|² + sum of c·loss / n over rows, with a constant feature (the bias multiplier) appended, so that the
bias takes part in the norm as the reference's formulation has it. Each row has a dual variable, which never leaves its block
of rows: rows are packed in blocks that stay where they are, a round sends the weights out, every task improves the duals
of its own blocks in random order against its own copy of the weights, and only the tasks' changes to the weights come
back and are added. Steps are shortened by the number of tasks, so that adding all changes never overshoots.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

BLOCK, TASK_ROWS = 2048, 50_000


def _clip(v: float, low: float, high: float) -> float:
    return low if v < low else high if v > high else v


def _logistic_step(f: float, y: float, a: float, q: float) -> float:
    """The root of log((1 - b)/b) = y f + q (b - b0) in (0, 1), by Newton within a bracket."""
    before, low, high = a * y, 1e-12, 1 - 1e-12
    b = _clip(before, 0.05, 0.95)
    for _ in range(50):
        slope = math.log((1 - b) / b) - y * f - q * (b - before)
        if slope > 0:
            low = b
        else:
            high = b
        new = b + slope / (1 / (b * (1 - b)) + q)
        new = new if low < new < high else (low + high) / 2
        if abs(new - b) < 1e-12:
            break
        b = new
    return b * y


#: A dual variable's best value: (margin, label, value now, curvature) -> value.
STEPS: dict[str, Callable[[float, float, float, float], float]] = {
    "hinge": lambda f, y, a, q: y * _clip((1 - y * f) / q + a * y, 0.0, 1.0),
    "hinge2": lambda f, y, a, q: y * max((1 - y * f + q * a * y) / (q + 0.5), 0.0),
    "l1": lambda f, y, a, q: _clip(a + (y - f) / q, -1.0, 1.0),
    "l2": lambda f, y, a, q: (y - f + q * a) / (q + 0.5),
    "logistic": _logistic_step,
}


def losses(loss: str, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    m = y * f
    return {"hinge": lambda: np.maximum(1 - m, 0), "hinge2": lambda: np.maximum(1 - m, 0) ** 2, "l1": lambda: np.abs(f - y), "l2": lambda: (f - y) ** 2, "logistic": lambda: np.logaddexp(0, -m)}[loss]()


def dual_losses(loss: str, a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a row adds to the dual objective."""
    b = a * y
    if loss in ("hinge", "l1"):
        return b
    if loss in ("hinge2", "l2"):
        return b - a * a / 4
    p = np.clip(b, 1e-300, 1)
    r = np.clip(1 - b, 1e-300, 1)
    return -(b * np.log(p) + (1 - b) * np.log(r))


@dataclass
class Fit:
    """Weights, bias, and diagnostics by round: (objective, dual objective, gap)."""

    weights: np.ndarray
    bias: float
    history: list[tuple[float, float, float]] = field(default_factory=list)

    @property
    def gap(self) -> float:
        return self.history[-1][2]


def packed(df: DataFrame, features: list[str] | str, target: str, weight: str | None, bias: float, block: int = BLOCK) -> DataFrame:
    """(block, x, y, c): rows with a null, non-finite or missing feature, label or weight are left out."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    rows = df.select(x.alias("x"), F.col(target).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("c"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(fine & F.col("y").isNotNull() & (F.col("c") > 0))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                flat = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                flat = np.column_stack([flat, np.full(len(flat), bias)])
                columns = [flat, *(part[c].to_numpy(zero_copy_only=False) for c in ("y", "c"))]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.num_rows], pa.int64()), *(pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in columns)], ["block", "n", "x", "y", "c"])
                at += 1

    return materialize(rows.mapInArrow(task, "block long, n long, x binary, y binary, c binary"), "blocks")


def improve(x: np.ndarray, y: np.ndarray, c: np.ndarray, a: np.ndarray, w: np.ndarray, loss: str, scale: float, tasks: int, rng: np.random.Generator) -> None:
    """One pass in random order over a block: a and the local weights w change in place. scale: 1/(lam n)."""
    step = STEPS[loss]
    norm = (x * x).sum(1) * c * scale * tasks
    labels, weights, values, curve = y.tolist(), c.tolist(), a.tolist(), norm.tolist()
    for i in rng.permutation(len(x)).tolist():
        q = curve[i]
        if q <= 0:
            continue
        row = x[i]
        new = step(float(row @ w), labels[i], values[i], q)
        change = new - values[i]
        if change:
            values[i] = new
            w += (change * weights[i] * scale * tasks) * row
    a[:] = values


def dual_fit(df: DataFrame, features: list[str] | str, target: str, loss: str = "hinge", lam: float = 0.01, bias_multiplier: float = 1.0, weight: str | None = None,
             epsilon: float = 1e-3, rounds: int = 100, passes: int = 60, tasks: int | None = None, seed: int = 0) -> Fit:
    """Fits until the duality gap is at most epsilon; raises if it isn't after that many rounds, or without rows.

    loss: hinge, hinge2, l1, l2 or logistic; labels 1 and -1 (any number for l1 and l2). weight: a row's factor in the loss.
    features: columns, or one array column. A round reads the blocks once, from the executors' storage, and each task passes
    over its own `passes` times.
    """
    if loss not in STEPS:
        raise ValueError(f"loss {loss}: one of {', '.join(STEPS)}")
    blocks = packed(df, features, target, weight, bias_multiplier)
    n, size = blocks.agg(F.sum("n"), F.max(F.octet_length("x") / (8 * F.col("n")))).first()
    if not n:
        raise ValueError("no rows with all features, a label and a weight")
    size = int(size)
    tasks = tasks or max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    held = blocks.repartition(tasks, "block").persist()
    scale = 1 / (lam * n)
    w = np.zeros(size)
    duals, history = None, []
    try:
        for k in range(rounds + 1):
            sent = df.sparkSession.sparkContext.broadcast(w)
            last = k == rounds

            def task(batches: Iterator[pa.RecordBatch], sent=sent, k=k, last=last) -> Iterator[pa.RecordBatch]:
                start = sent.value
                local, primal, dual, rows = start.copy(), 0.0, 0.0, []
                for batch in batches:
                    for r in batch.to_pylist():
                        y, c = np.frombuffer(r["y"], "<f8"), np.frombuffer(r["c"], "<f8")
                        a = np.frombuffer(r["a"], "<f8").copy() if r["a"] else np.zeros(len(y))
                        rows.append((r["block"], np.frombuffer(r["x"], "<f8").reshape(len(y), -1), y, c, a))
                for _, x, y, c, a in rows:
                    primal += float(c @ losses(loss, x @ start, y))
                    dual += float(c @ dual_losses(loss, a, y))
                for turn in range(0 if last else passes):
                    for block, x, y, c, a in rows:
                        improve(x, y, c, a, local, loss, scale, tasks, np.random.default_rng([seed, k, turn, block]))
                for block, _, _, _, a in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([None], pa.list_(pa.float64()))], ["block", "a", "sums"])
                change = (local - start) / tasks
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([[primal, dual, *change.tolist()]], pa.list_(pa.float64()))], ["block", "a", "sums"])

            known = held.join(duals, "block", "left") if duals is not None else held.withColumn("a", F.lit(None).cast("binary"))
            out = materialize(known.select("block", "x", "y", "c", "a").mapInArrow(task, "block long, a binary, sums array<double>"), "duals")
            total = np.zeros(size + 2)
            for at, v in out.where("block IS NULL").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v")).collect():  # a row a weight
                total[at] = v
            norm = lam / 2 * float(w @ w)
            primal, dual = norm + total[0] / n, total[1] / n - norm
            history.append((primal, dual, primal - dual))
            if primal - dual <= epsilon:
                return Fit(w[:-1], float(w[-1] * bias_multiplier), history)
            w = w + total[2:]
            duals = out.where("block IS NOT NULL").select("block", "a")
    finally:
        held.unpersist()
    raise RuntimeError(f"{loss}: gap {history[-1][2]:.3g} after {rounds} rounds, wanted {epsilon:g}")


def scores(df: DataFrame, features: str, fit: Fit, name: str = "score") -> DataFrame:
    """Adds w·x + b of an array column."""
    products = F.zip_with(F.col(features), F.array(*map(F.lit, fit.weights.tolist())), lambda a, b: a * b)
    return df.withColumn(name, F.aggregate(products, F.lit(float(fit.bias)), lambda s, v: s + v))
