"""Bit flags and packed fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(mask: Column, position: int) -> Column:
    """Whether bit position (0-based) is set."""
    return F.shiftright(mask.cast("long"), position).bitwiseAND(F.lit(1)) == 1


def field(packed: Column, slot: int, width: int = 8) -> Column:
    return F.shiftright(packed.cast("long"), slot * width).bitwiseAND(F.lit((1 << width) - 1))


def with_field(packed: Column, slot: int, value: Column, width: int = 8) -> Column:
    """packed with one field replaced by the low bits of value."""
    full = (1 << width) - 1
    kept = packed.cast("long").bitwiseAND(F.lit(~(full << slot * width)))
    return kept.bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND(F.lit(full)), slot * width))
