"""Sigmoids, bells and window weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_slope(x: Column) -> Column:
    return sigmoid(x) * (1 - sigmoid(x))


def gaussian(x: Column, sigma: float = 1.0, order: int = 0) -> Column:
    """The normal density, or its first or second derivative."""
    z = x / sigma
    g = F.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * sigma)
    return {0: g, 1: -z / sigma * g, 2: (z * z - 1) / sigma**2 * g}[order]


def raised_cosine(x: Column) -> Column:
    return F.when(F.abs(x) < 1, (1 + F.cos(math.pi * x)) / 2).otherwise(0.0)


def bessel0(x: Column, terms: int = 30) -> Column:
    """The modified Bessel function of order 0 by its power series; for arguments up to about 20."""
    quarter = x * x / 4
    out = F.lit(1.0)
    for k in range(terms, 0, -1):
        out = 1 + out * quarter / (k * k)
    return out


def taper_nd(kind: str, places: list[tuple[Column, int]], beta: float = 8.6) -> Column:
    """Product of the windows along some axes, each (position, length)."""
    out = taper(kind, *places[0], beta=beta)
    for i, n in places[1:]:
        out = out * taper(kind, i, n, beta=beta)
    return out


def taper(kind: str, i: Column, n: int, beta: float = 8.6) -> Column:
    """Weight of position i (0-based) in a symmetric window of n positions; beta is kaiser's."""
    last = max(n - 1, 1)
    turn, centred = 2 * math.pi * i / last, 2 * i / last - 1
    if kind == "rect":
        return F.lit(1.0)
    if kind == "bartlett":
        return 1 - F.abs(centred)
    if kind == "hann":
        return 0.5 - 0.5 * F.cos(turn)
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(turn)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn)
    if kind == "welch":
        return 1 - centred * centred
    if kind == "cosine":
        return F.sin(math.pi * i / last)
    if kind == "gauss":
        return F.exp(-0.5 * F.pow(centred / 0.4, F.lit(2)))
    if kind == "lanczos":
        return F.when(centred == 0, 1.0).otherwise(F.sin(math.pi * centred) / (math.pi * centred))
    if kind == "tukey":
        edge = F.abs(centred)
        return F.when(edge <= 0.5, 1.0).otherwise(0.5 + 0.5 * F.cos(2 * math.pi * (edge - 0.5)))
    if kind == "kaiser":
        return bessel0(beta * F.sqrt(F.greatest(1 - centred * centred, F.lit(0.0)))) / bessel0(F.lit(beta))
    raise ValueError(kind)
