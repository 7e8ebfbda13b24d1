"""Sparse linear models: sufficient statistics by one pass over the table, small solves on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transforms import taut_string

Prox = Callable[[np.ndarray, float], np.ndarray]


def statistics(df: DataFrame, features: list[str], target: str, by: str | None = None) -> dict:
    """For each group (None without by): rows, AᵀA, Aᵀy, yᵀy. Features are few, so one aggregate holds all products."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(F.col(f) * F.col(target)).alias(f"c{i}") for i, f in enumerate(features)]
    rows = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.sum(F.col(target) * F.col(target)).alias("yy"), *sums).collect()  # one row per group
    out = {}
    for r in rows:
        gram = np.zeros((len(features),) * 2)
        for i, j in pairs:
            gram[i, j] = gram[j, i] = r[f"g{i}_{j}"]
        out[r[by] if by else None] = r["n"], gram, np.array([r[f"c{i}"] for i in range(len(features))]), r["yy"]
    return out


def standardised(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Columns centred and scaled to unit variance."""
    stats = df.agg(*(f(c).alias(f"_{n}{c}") for c in [*features, target] for n, f in (("m", F.avg), ("s", F.stddev))))  # one row
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_m{c}")) / F.col(f"_s{c}") for c in [*features, target]}).select(*df.columns)


def shrink(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def shrink_groups(groups: list[list[int]], within: float = 0.0) -> Callable[[float], Prox]:
    """Prox of lam·Σ√|g|·‖x_g‖ (+ within·lam·‖x‖₁)."""

    def of(lam: float) -> Prox:
        def prox(x: np.ndarray, step: float) -> np.ndarray:
            x = shrink(x, within * lam * step)
            for g in groups:
                norm = np.linalg.norm(x[g])
                x[g] = x[g] * max(1 - lam * step * np.sqrt(len(g)) / norm, 0) if norm else 0
            return x

        return prox

    return of


def l1_ball(radius: float) -> Prox:
    def prox(x: np.ndarray, _step: float) -> np.ndarray:
        if np.abs(x).sum() <= radius:
            return x
        u = np.sort(np.abs(x))[::-1]
        k = np.flatnonzero(u - (np.cumsum(u) - radius) / np.arange(1, len(u) + 1) > 0)[-1]
        return shrink(x, (u[: k + 1].sum() - radius) / (k + 1))

    return prox


def fused(lam: float, lam2: float) -> Prox:
    """Prox of lam·‖x‖₁ + lam2·Σ|x_i+1 - x_i|: the taut string, then shrinking."""
    return lambda x, step: shrink(taut_string(x, lam2 * step), lam * step)


def nonconvex(kind: str, lam: float, theta: float) -> Prox:
    """Prox of capped, log, scad or mcp: the least objective over each piece's stationary point and ends."""
    pieces = {"capped": [0.0, theta, np.inf], "log": [0.0, np.inf], "scad": [0.0, lam, theta * lam, np.inf], "mcp": [0.0, theta * lam, np.inf]}[kind]

    def value(a: np.ndarray) -> np.ndarray:
        if kind == "capped":
            return lam * np.minimum(a, theta)
        if kind == "log":
            return lam * np.log1p(a / theta)
        if kind == "mcp":
            return np.where(a <= theta * lam, lam * a - a * a / (2 * theta), theta * lam * lam / 2)
        return np.where(a <= lam, lam * a, np.where(a <= theta * lam, (-a * a + 2 * theta * lam * a - lam * lam) / (2 * (theta - 1)), (theta + 1) * lam * lam / 2))

    def stationary(piece: int, a: np.ndarray, step: float) -> list[np.ndarray]:
        """Zeros of z - a + step·slope(z), the slope being that of one piece; concave ones may be maxima, which lose to the ends."""
        t = step * lam
        if kind == "log":  # (z - a)(z + theta) + t = 0
            root = np.sqrt(np.maximum((a + theta) ** 2 - 4 * t, 0))
            return [(a - theta + root) / 2, (a - theta - root) / 2]
        if piece == len(pieces) - 2:  # the penalty is level there
            return [a]
        if piece == 0 and kind != "mcp":
            return [a - t]
        bend, push = (theta, 1.0) if kind == "mcp" else (theta - 1, theta / (theta - 1))  # slope: push·lam - z/bend
        return [(a - push * t) / (1 - step / bend)] if step != bend else []

    def prox(x: np.ndarray, step: float) -> np.ndarray:
        a = np.abs(x)
        options = [np.full_like(a, end) for end in pieces[:-1]]
        for i, (low, high) in enumerate(zip(pieces[:-1], pieces[1:], strict=True)):
            options += [np.clip(z, low, high) for z in stationary(i, a, step)]
        grid = np.stack(options)
        cost = (grid - a) ** 2 / 2 + step * value(grid)
        return np.sign(x) * grid[cost.argmin(0), np.arange(len(a))]

    return prox


def solve(gram: np.ndarray, cross: np.ndarray, prox: Prox, ridge: float = 0.0, start: np.ndarray | None = None, steps: int = 20_000, tolerance: float = 1e-11) -> np.ndarray:
    """½xᵀGx - cᵀx + ½ridge‖x‖² + penalty, by accelerated proximal gradient with restarts."""
    h = gram + ridge * np.eye(len(cross))
    step = 1 / max(np.linalg.eigvalsh(h)[-1], 1e-300)
    x = np.zeros(len(cross)) if start is None else start
    y, t = x, 1.0
    for _ in range(steps):
        new = prox(y - step * (h @ y - cross), step)
        if np.abs(new - x).max() <= tolerance * max(1.0, np.abs(new).max()):
            return new
        if (y - new) @ (new - x) > 0:
            y, t = new, 1.0
        else:
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / after * (new - x), after
        x = new
    return x


def lasso(df: DataFrame, features: list[str], target: str, share: float, ridge: float = 0.0, nonnegative: bool = False) -> np.ndarray:
    """½‖Ax - y‖² + λ‖x‖₁ (+ ½ridge‖x‖²), λ as a share of the least λ with no support."""
    _, gram, cross, _ = statistics(df, features, target)[None]
    lam = share * np.abs(cross).max()
    return solve(gram, cross, (lambda x, s: np.maximum(x - lam * s, 0)) if nonnegative else (lambda x, s: shrink(x, lam * s)), ridge)


def path(df: DataFrame, features: list[str], target: str, shares: list[float]) -> list[tuple[float, np.ndarray]]:
    """Solutions for falling λ, each started at the one before; the table is read once."""
    _, gram, cross, _ = statistics(df, features, target)[None]
    out, x = [], None
    for share in sorted(shares, reverse=True):
        lam = share * np.abs(cross).max()
        x = solve(gram, cross, lambda v, s, lam=lam: shrink(v, lam * s), start=x)
        out.append((share, x))
    return out


def multitask(df: DataFrame, features: list[str], target: str, task: str, lam: float) -> dict:
    """Least squares per task with a penalty on each feature's weights across tasks: {task: weights}."""
    stats = statistics(df, features, target, by=task)
    names = sorted(stats, key=str)
    step = 1 / max(np.linalg.eigvalsh(stats[k][1])[-1] for k in names)
    x = np.zeros((len(features), len(names)))
    for _ in range(20_000):
        new = x - step * np.column_stack([stats[k][1] @ x[:, i] - stats[k][2] for i, k in enumerate(names)])
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = new * np.maximum(1 - lam * step / np.maximum(norm, 1e-300), 0)
        if np.abs(new - x).max() < 1e-12 * max(1.0, np.abs(new).max()):
            break
        x = new
    return {k: x[:, i] for i, k in enumerate(names)}


def sparse_precision(cov: np.ndarray, lam: float, rounds: int = 200) -> np.ndarray:
    """Graphical lasso: block coordinate descent on the covariance."""
    p = len(cov)
    w = cov + lam * np.eye(p)
    betas = np.zeros((p, p - 1))
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = np.delete(np.arange(p), j)
            betas[j] = solve(w[np.ix_(rest, rest)], cov[rest, j], lambda x, s: shrink(x, lam * s), start=betas[j], steps=500)
            w[rest, j] = w[j, rest] = w[np.ix_(rest, rest)] @ betas[j]
        if np.abs(w - before).max() < 1e-9:
            break
    else:
        raise RuntimeError(f"precision matrix: not settled after {rounds} rounds")
    out = np.zeros((p, p))
    for j in range(p):
        rest = np.delete(np.arange(p), j)
        out[j, j] = 1 / (w[j, j] - w[rest, j] @ betas[j])
        out[rest, j] = -betas[j] * out[j, j]
    return (out + out.T) / 2


def sparse_precision_by_parts(cov: np.ndarray, lam: float) -> np.ndarray:
    """The graphical lasso of each connected part of the covariances above lam, apart: outside these parts its solution is 0."""
    p = len(cov)
    linked = np.abs(cov) > lam
    np.fill_diagonal(linked, True)
    low = np.arange(p)
    while True:
        new = np.where(linked, low[None, :], p).min(1)
        if (new == low).all():
            break
        low = new
    out = np.zeros((p, p))
    for part in np.unique(low):
        own = np.flatnonzero(low == part)
        at = np.ix_(own, own)
        out[at] = sparse_precision(cov[at], lam) if len(own) > 1 else 1 / (cov[at] + lam)
    return out


#: Loss of a row by its margin f and label y: (value, slope, curvature). hinge and l1 are rounded off over a width; to their
#: curvature, which is 0 for most rows, a twentieth of that of a parabola over the loss which touches it at f is added.
LOSSES: dict[str, Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}


def _loss(name: str):
    def register(fn):
        LOSSES[name] = fn
        return fn

    return register


@_loss("logistic")
def _(f, y, _):
    p = 1 / (1 + np.exp(np.clip(y * f, -500, 500)))
    return np.logaddexp(0, -y * f), -y * p, p * (1 - p)


@_loss("hinge2")
def _(f, y, _):
    gap = np.maximum(1 - y * f, 0)
    return gap * gap, -2 * y * gap, 2.0 * (gap > 0)


@_loss("l2")
def _(f, y, _):
    return (f - y) ** 2, 2 * (f - y), np.full(len(f), 2.0)


@_loss("hinge")
def _(f, y, width):
    gap = 1 - y * f
    value = np.where(gap <= 0, 0, np.where(gap < width, gap * gap / (2 * width), gap - width / 2))
    return value, -y * np.clip(gap / width, 0, 1), ((gap > 0) & (gap < width)) / width + 0.05 / np.maximum(2 * np.abs(gap), width)


@_loss("l1")
def _(f, y, width):
    r = f - y
    return np.where(np.abs(r) < width, r * r / (2 * width), np.abs(r) - width / 2), np.clip(r / width, -1, 1), (np.abs(r) < width) / width + 0.05 / np.maximum(np.abs(r), width)


def partial_sums(x: np.ndarray, y: np.ndarray, c: np.ndarray, own: np.ndarray, w: np.ndarray, loss: str, mode: str, width: float) -> np.ndarray:
    """Total weight, loss, gradients and Hessians of some rows, in a row."""
    k, p = w.shape
    x, value, g, h = np.column_stack([x, np.ones(len(x))]), 0.0, np.zeros((k, p)), np.zeros((k, p, p))
    for b in range(k):
        rows = own == b if mode == "task" else slice(None)
        xb, cb = x[rows], c[rows]
        yb = np.where(y == b, 1.0, -1.0) if mode == "class" else y[rows]
        v, d, s = LOSSES[loss](xb @ w[b], yb, width)
        value += float(cb @ v)
        g[b] = xb.T @ (cb * d)
        h[b] = (xb * (cb * s)[:, None]).T @ xb
    return np.concatenate([[c.sum(), value], g.ravel(), h.ravel()])


def unpacked(sums: np.ndarray, k: int, p: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    return sums[1], sums[2 : 2 + k * p].reshape(k, p), sums[2 + k * p :].reshape(k, p, p), sums[0]


def second_order(df: DataFrame, features: list[str], target: str, loss: str, w: np.ndarray, mode: str = "one", weight: str | None = None, width: float = 1.0) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(loss, gradient, Hessian blocks, total weight) over all rows in one pass, one partial sum a task.

    w: a row of weights and intercept for each block. mode: 'one' (labels as they are), 'class' (block k tells label k from
    the others), 'task' (target is a struct of task number and label, a block each).
    """
    k, p = w.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(2 + k * p + k * p * p)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            flat += partial_sums(np.column_stack(columns[: p - 1]), *columns[p - 1 :], w, loss, mode, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

    own = F.col(target)["task"] if mode == "task" else F.lit(0)
    label = F.col(target)["label"] if mode == "task" else F.col(target)
    rows = df.select(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)), label.cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("c"), own.cast("double").alias("own"))
    sums = np.zeros(2 + k * p + k * p * p)
    for r in rows.mapInArrow(task, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row a weight and pair of weights
        sums[r["at"]] = r["v"]
    return unpacked(sums, k, p)


def newton_fit(df: DataFrame, features: list[str], target: str, loss: str = "logistic", prox: Prox | None = None, penalty: Callable[[np.ndarray], float] = lambda w: 0.0, ridge: float = 0.0, mode: str = "one", blocks: int = 1, weight: str | None = None, start: np.ndarray | None = None, steps: int = 60, widths: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03, 0.01)) -> tuple[np.ndarray, list[float]]:
    """Mean loss + ½ridge‖w‖² + penalty by proximal Newton steps: (weights and intercepts, a row a block; objectives).

    A step reads the table once; its penalised quadratic is solved on the driver, over as many numbers as there are weights.
    prox and penalty take the weights of all blocks in a row, without intercepts, which are free. hinge and l1 are rounded
    off less and less; their objective is that of the last width, at most half of it below the true one. Raises if steps
    don't settle a width.
    """
    p = len(features) + 1
    w = np.zeros((blocks, p)) if start is None else start.copy()
    inner = np.ones((blocks, p), bool)
    inner[:, -1] = False
    flat = inner.ravel()
    pull = ridge * inner.astype(float).ravel()

    def objective(value: float, total: float, w: np.ndarray) -> float:
        own = w[:, :-1]
        return value / total + ridge / 2 * float((own * own).sum()) + penalty(own.ravel())

    def free_intercepts(x: np.ndarray, step: float) -> np.ndarray:
        out = x.copy()
        out[flat] = prox(x[flat], step)
        return out

    history: list[float] = []
    for width in widths if loss in ("hinge", "l1") else widths[:1]:
        value, g, h, total = second_order(df, features, target, loss, w, mode, weight, width)
        total = total or 1.0
        now = objective(value, total, w)
        for _ in range(steps):
            full = np.zeros((blocks * p,) * 2)
            for b in range(blocks):
                full[b * p : (b + 1) * p, b * p : (b + 1) * p] = h[b] / total
            full += np.diag(pull) + 1e-9 * np.eye(blocks * p)
            slope = g.ravel() / total + pull * w.ravel()
            if prox is None:
                new = w.ravel() - np.linalg.solve(full, slope)
            else:
                new = solve(full, full @ w.ravel() - slope, free_intercepts, start=w.ravel(), steps=4000)
            d, share = new.reshape(blocks, p) - w, 1.0
            while True:
                at = w + share * d
                value, g, h, _ = second_order(df, features, target, loss, at, mode, weight, width)
                after = objective(value, total, at)
                if after <= now + 1e-12 or share < 1e-6:
                    break
                share /= 2
            if after > now + 1e-12:
                break  # no step along this line is better: rounding is all that is left
            moved, w, gain, now = np.abs(share * d).max(), at, now - after, after
            history.append(now)
            if moved < 1e-7 or abs(gain) < 1e-11 * max(1.0, abs(now)):
                break
        else:
            raise RuntimeError(f"{loss}: not settled after {steps} steps at width {width}; objective {now}")
    return w, history


def lasso_penalty(lam: float, nonnegative: bool = False) -> tuple[Prox, Callable[[np.ndarray], float]]:
    return (lambda x, s: np.maximum(x - lam * s, 0) if nonnegative else shrink(x, lam * s)), lambda w: lam * float(np.abs(w).sum())


def nonnegative_ball(radius: float) -> Prox:
    """Projection on weights of 0 or more whose sum is radius at most."""
    onto = l1_ball(radius)
    return lambda x, s: onto(np.maximum(x, 0), s)


def rows_together(lam: float, blocks: int) -> tuple[Prox, Callable[[np.ndarray], float]]:
    """lam·Σ over features of the norm of its weights in all blocks."""

    def prox(x: np.ndarray, step: float) -> np.ndarray:
        m = x.reshape(blocks, -1)
        norm = np.linalg.norm(m, axis=0)
        return (m * np.maximum(1 - lam * step / np.maximum(norm, 1e-300), 0)).ravel()

    return prox, lambda w: lam * float(np.linalg.norm(w.reshape(blocks, -1), axis=0).sum())


def rows_ball(radius: float, blocks: int) -> Prox:
    """Projection on weights whose features' norms over all blocks sum to radius at most."""
    onto = l1_ball(radius)

    def prox(x: np.ndarray, step: float) -> np.ndarray:
        m = x.reshape(blocks, -1)
        norm = np.linalg.norm(m, axis=0)
        return (m * (onto(norm, step) / np.maximum(norm, 1e-300))).ravel()

    return prox


def newton_path(df: DataFrame, features: list[str], target: str, loss: str, lams: list[float]) -> list[tuple[float, np.ndarray]]:
    """Solutions for falling λ, each started at the one before."""
    out, w = [], None
    for lam in sorted(lams, reverse=True):
        prox, penalty = lasso_penalty(lam)
        w, _ = newton_fit(df, features, target, loss, prox, penalty, start=w)
        out.append((lam, w[0]))
    return out


def nonconvex_penalty(kind: str, lam: float, theta: float) -> Callable[[np.ndarray], float]:
    def value(w: np.ndarray) -> float:
        a = np.abs(w)
        if kind == "capped":
            return float((lam * np.minimum(a, theta)).sum())
        if kind == "log":
            return float((lam * np.log1p(a / theta)).sum())
        if kind == "mcp":
            return float(np.where(a <= theta * lam, lam * a - a * a / (2 * theta), theta * lam * lam / 2).sum())
        return float(np.where(a <= lam, lam * a, np.where(a <= theta * lam, (-a * a + 2 * theta * lam * a - lam * lam) / (2 * (theta - 1)), (theta + 1) * lam * lam / 2)).sum())

    return value
