"""Groups of documents and packed messages between them.

Text operators that must find equal strings anywhere in the corpus work in rounds. Documents are dealt once into
groups of bounded size by a hash of doc_id and text. A round's sender reduces a group to packed arrays of 64- or 128-bit
fingerprints, each distinct one once, dealt to buckets by fingerprint. A bucket sees a fingerprint at most once
from each group, however often it occurs, and answers each group that sent it. So no task ever holds all rows of
a hot string, what is shuffled is 8 to 32 bytes a fingerprint, and texts are shuffled once: every round reads the
same exchange.
"""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 2 << 20
MESSAGES = "g long, kind int, part long, data binary"
BUCKETED = "part long, g long, kind int, data binary"


def document_groups(df: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, g) and the number of groups, which follows the size of all texts. Null text is empty.

    Rows without id or of one id are dealt by their texts. Groups are dealt to partitions once, for all rounds.
    """
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, math.ceil(total / group_bytes))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), "g", n), n


#: Groups of a partition, fewest and most, and the number of partitions from which on it is the most.
FEW, MANY, ENOUGH = 4, 64, 20_000


def spread(df: DataFrame, key: str, groups: int) -> DataFrame:
    """Partitions by key, so that tasks don't grow with the input: of FEW groups, of more once there are ENOUGH partitions,
    of MANY at most; the session's number of partitions is the least."""
    partitions = min(math.ceil(groups / FEW), max(ENOUGH, math.ceil(groups / MANY)))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions), key)


def in_order(table: pa.Table) -> pa.Table:
    """The same order in every round, whatever order the rows arrived in: by doc_id (null first), equal ids by text."""
    keys = [("doc_id", "ascending")]
    ids = table.column("doc_id")
    if pc.count_distinct(ids, mode="all").as_py() < len(ids):
        keys.append(("text", "ascending"))
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """By the high bits, so that ascending keys give ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def packed(g: int, kind: int, records: np.ndarray, keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of BUCKETED: records, ascending by keys, cut by bucket."""
    buckets = bucket_of(keys, n)
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(keys) else []
    for s, e in zip(edges[:-1], edges[1:], strict=True) if len(keys) else ():
        yield int(buckets[s]), g, kind, records[s:e].tobytes()


@functools.cache
def _libc():
    return ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back to the machine; a worker lives through many groups beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim:
        trim(0)


def rows(schema: list[tuple[str, pa.DataType]], out: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(schema)})


BUCKETED_ARROW = [("part", pa.int64()), ("g", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())]
MESSAGES_ARROW = [("g", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("data", pa.binary())]


def send(groups: DataFrame, fn: Callable[[int, pa.Table], list[tuple]]) -> DataFrame:
    """fn(g, ordered documents) -> rows of BUCKETED."""

    def task(key, table):
        out = rows(BUCKETED_ARROW, list(fn(key[0].as_py(), in_order(table))))
        release()
        return out

    return groups.groupBy("g").applyInArrow(task, BUCKETED)


def send_again(groups: DataFrame, n: int, messages: DataFrame, fn: Callable[[int, pa.Table, "Inbox"], list[tuple]], schema: str, arrow: list) -> DataFrame:
    """fn(g, ordered documents, answers so far) -> rows; groups (n of them) without documents have nothing to say."""

    def task(key, docs, mail):
        g = key[0].as_py()
        out = fn(g, in_order(docs), Inbox(mail)) if docs.num_rows else []
        out = out if isinstance(out, pa.Table) else rows(arrow, list(out))
        release()
        return out

    return groups.groupBy("g").cogroup(spread(messages, "g", n).groupBy("g")).applyInArrow(task, schema)


def answer(sent: DataFrame, buckets: int, fn: Callable[[list[int], list[int], list[bytes]], list[tuple]]) -> DataFrame:
    """fn(groups, kinds, packed records of one of the buckets, ascending by group) -> rows of MESSAGES without part."""

    def task(key, table):
        part = key[0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[("g", "ascending"), ("kind", "ascending")]))
        out = fn(table["g"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist())
        release()
        return rows(MESSAGES_ARROW, [(g, kind, part, data) for g, kind, data in out])

    return spread(sent, "part", buckets).groupBy("part").applyInArrow(task, MESSAGES)


class Inbox:
    """Answers to one group, by kind, concatenated in bucket order."""

    def __init__(self, mail: pa.Table) -> None:
        found: dict[int, list[tuple[int, bytes]]] = {}
        for kind, part, data in zip(mail["kind"].to_pylist(), mail["part"].to_pylist(), mail["data"].to_pylist(), strict=True):
            found.setdefault(kind, []).append((part, data))
        self.found = {k: [d for _, d in sorted(v)] for k, v in found.items()}

    def get(self, kind: int, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(self.found.get(kind, [])), dtype)


def repeated_keys(gs: list[int], _: list[int], blobs: list[bytes], hot_from: int = 64) -> list[tuple]:
    """Bucket rule for records (key, many in the group): each group hears which of its keys occur twice or more in all (kind 0),
    and which of those hot_from groups or more hold (kind 9)."""
    record = np.dtype([("key", "<u8"), ("many", "?")])
    sent = [np.frombuffer(b, record) for b in blobs]
    if not sent:
        return []
    every = np.concatenate(sent)
    order = np.argsort(every["key"], kind="stable")
    key, many = every["key"][order], every["many"][order]
    same = key[1:] == key[:-1]
    again = many.copy()
    again[1:] |= same
    again[:-1] |= same
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(key) else np.empty(0, np.int64)
    holders = np.diff(np.append(first, len(key)))
    flags, hot = np.empty(len(key), bool), np.empty(len(key), bool)
    flags[order], hot[order] = again, np.repeat(holders >= hot_from, holders)
    out, at = [], 0
    for g, s in zip(gs, sent, strict=True):
        for kind, kept in ((0, flags), (9, hot)):
            keep = s["key"][kept[at : at + len(s)]]
            if len(keep):
                out.append((g, kind, keep.tobytes()))
        at += len(s)
    return out


def key_records(keys: np.ndarray) -> np.ndarray:
    from .rolling import unique_sorted

    distinct, times = unique_sorted(keys)
    out = np.empty(len(distinct), np.dtype([("key", "<u8"), ("many", "?")]))
    out["key"], out["many"] = distinct, times > 1
    return out
