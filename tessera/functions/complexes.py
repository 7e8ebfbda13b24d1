"""Complex numbers as (re, im) column pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def add(x: Pair, y: Pair) -> Pair:
    return x[0] + y[0], x[1] + y[1]


def subtract(x: Pair, y: Pair) -> Pair:
    return x[0] - y[0], x[1] - y[1]


def multiply(x: Pair, y: Pair) -> Pair:
    return x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]


def conjugate(x: Pair) -> Pair:
    return x[0], -x[1]


def divide(x: Pair, y: Pair, epsilon: float = 0.0) -> Pair:
    """x / y, with a guard added to |y|²."""
    size = y[0] * y[0] + y[1] * y[1] + epsilon
    re, im = multiply(x, conjugate(y))
    return re / size, im / size


def magnitude(x: Pair, power: float = 1.0) -> Column:
    return F.hypot(*x) if power == 1.0 else F.pow(F.hypot(*x), F.lit(power))
