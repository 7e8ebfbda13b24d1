"""Joins with keys that a third of all rows may share, and row filters by key lists of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above a 10,000th of all rows, so there are at most 10,000 hot keys, whatever the table holds.
HOT_KEYS, LEAST_HOT = 10_000, 1_000
#: Keys that may be broadcast, beside a check of their number.
BROADCAST_KEYS = 200_000


def skew_join(left: DataFrame, right: DataFrame, key: str | list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which holds one row a key and in n how many of left's total rows have it.

    Few keys are broadcast whole. Of more, the hot ones are broadcast (at most HOT_KEYS rows) and their rows of left stay
    where they are; all others are shuffled, and none of them has more rows than the limit. right should be a written
    table: it is counted first.
    """
    key = [key] if isinstance(key, str) else key
    if right.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return left.join(F.broadcast(right), key, how)
    limit = max(LEAST_HOT, total // HOT_KEYS)
    hot = right.where(F.col(n) > limit)
    near = left.join(F.broadcast(hot), key)
    far = left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(right.where(F.col(n) <= limit), key, how)
    return near.unionByName(far)


def with_keys(df: DataFrame, keys: DataFrame, on: str | list[str] | Column, how: str) -> DataFrame:
    """df's rows with (left_semi) or without (left_anti) a row of keys: by broadcast where keys are few, else by a shuffle.

    keys should be a written table: it is counted first.
    """
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)
