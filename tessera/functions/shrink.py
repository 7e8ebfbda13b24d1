"""Thresholds, penalties and their proximal maps, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft(x: Column, t: float) -> Column:
    """sign(x) (|x| - t) where positive; 0 for an infinite threshold."""
    return F.lit(0.0) if math.isinf(t) else F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def soft_complex(re: Column, im: Column, t: float) -> tuple[Column, Column]:
    """Shrinks the magnitude, keeps the phase."""
    size = F.hypot(re, im)
    factor = F.when(size > 0, F.greatest(F.lit(1.0) - t / size, F.lit(0.0))).otherwise(0.0)
    return re * factor, im * factor


def hard(x: Column, t: float) -> Column:
    return F.when(F.abs(x) > t, x).otherwise(0.0)


def group_soft(x: Column, norm: Column, t: float) -> Column:
    """Shrinks a member by its group's L2 norm."""
    return F.when(norm > 0, x * F.greatest(F.lit(1.0) - t / norm, F.lit(0.0))).otherwise(0.0)


def group_hard(x: Column, norm: Column, t: float) -> Column:
    return F.when(norm > t, x).otherwise(0.0)


def lp_soft(x: Column, t: float, p: float, steps: int = 3) -> Column:
    """Generalised soft threshold for |x|^p, p < 1: fixed-point steps from |x| above the jump, 0 below."""
    jump = (2 * t * (1 - p)) ** (1 / (2 - p)) + t * p * (2 * t * (1 - p)) ** ((p - 1) / (2 - p))
    size = F.abs(x)
    value = size
    for _ in range(steps):
        value = size - t * p * F.pow(value, F.lit(p - 1.0))
    return F.when(size > jump, F.signum(x) * value).otherwise(0.0)


def penalty(kind: str, x: Column, lam: float, theta: float) -> Column:
    a = F.abs(x)
    if kind == "capped":
        return lam * F.least(a, F.lit(theta))
    if kind == "log":
        return lam * F.log(1 + a / theta)
    if kind == "scad":
        middle = (-a * a + 2 * theta * lam * a - lam * lam) / (2 * (theta - 1))
        return F.when(a <= lam, lam * a).when(a <= theta * lam, middle).otherwise((theta + 1) * lam * lam / 2)
    if kind == "mcp":
        return F.when(a <= theta * lam, lam * a - a * a / (2 * theta)).otherwise(theta * lam * lam / 2)
    raise ValueError(kind)


def penalty_prox(kind: str, x: Column, lam: float, theta: float) -> Column:
    """argmin of (z - x)²/2 + penalty(z): the least objective among the stationary points of each piece."""
    a = F.abs(x)
    if kind == "capped":
        candidates = [F.greatest(a, F.lit(theta)), F.least(F.lit(theta), F.greatest(a - lam, F.lit(0.0)))]
    elif kind == "log":
        root = F.sqrt(F.greatest((a + theta) * (a + theta) - 4 * lam, F.lit(0.0)))
        candidates = [F.lit(0.0), F.greatest((a - theta + root) / 2, F.lit(0.0))]
    elif kind == "scad":
        candidates = [
            F.least(F.lit(lam), F.greatest(a - lam, F.lit(0.0))),
            F.least(F.lit(theta * lam), F.greatest(F.lit(lam), (a * (theta - 1) - theta * lam) / (theta - 2))),
            F.greatest(F.lit(theta * lam), a),
        ]
    elif kind == "mcp":
        candidates = [F.least(F.lit(theta * lam), F.greatest(F.lit(0.0), theta * (a - lam) / (theta - 1))), F.greatest(F.lit(theta * lam), a)]
    else:
        raise ValueError(kind)
    scored = F.array(*(F.struct(((z - a) * (z - a) / 2 + penalty(kind, z, lam, theta)).alias("cost"), z.alias("z")) for z in candidates))
    return F.signum(x) * F.array_min(scored)["z"]


def huber(norm: Column, t: float) -> Column:
    """Moreau envelope of a norm: quadratic below t, linear above."""
    return F.when(norm <= t, norm * norm / (2 * t)).otherwise(norm - t / 2)
