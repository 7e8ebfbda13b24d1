"""Substring dedup with difference-cover anchors.

A word goes if some window of ``window`` consecutive words over it also starts earlier (smaller doc_id, or the same
document, earlier start). Windows are judged on the input.

A difference cover D modulo v holds, for every two positions i and j, a shift s < v with i + s and j + s both in D.
So of two equal windows, one pair of aligned anchors at cover positions lies within the first v words of both, and
hashing only cover positions (4 of 13 for 20 words) misses no match. An anchor spans the window - v + 1 words that
stay inside the window whatever the shift.

Rounds (see exchange.py): 1. anchors at cover positions; buckets answer which repeat anywhere. 2. windows over a
repeated anchor extend it to the whole window: their 128-bit digests (two independent mixes of two word hashes) travel with the group's earliest place, and
buckets answer which group holds the earliest of all. 3. each group drops what is covered by windows that aren't it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .rolling import U64, chunks, member, run_hashes, utf8, word_hashes, words

#: Perfect difference sets by modulus: every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
PLACE = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i4")])
NULL_ID = -(1 << 63)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves anchors of a third of the window or more; (1, (0,)) for short windows."""
    fits = [v for v in COVERS if window - v + 1 >= window / 3]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class Earliest:
    def __init__(self, window: int, buckets: int) -> None:
        self.window, self.buckets = window, buckets
        self.modulus, cover = cover_for(window)
        self.anchor = window - self.modulus + 1
        self.in_cover = np.isin(np.arange(self.modulus), cover)

    def scan(self, docs: pa.Table):
        """Words of the whole group: (bytes, starts, ends, first word of each document, two 64-bit hashes of each word)."""
        data, offsets = utf8(docs["text"])
        parts, total = [], 0
        for first, last in chunks(offsets):
            begin = int(offsets[first])
            piece = data[begin : int(offsets[last])]
            s, e, at = words(piece, offsets[first : last + 1] - begin)
            parts.append((s + begin, e + begin, at[:-1] + total, *word_hashes(piece, s, e)))
            total += len(s)
        if not parts:
            empty = np.empty(0, np.int64)
            return data, empty, empty, np.zeros(1, np.int64), np.empty(0, U64), np.empty(0, U64)
        s, e, at, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        return data, s, e, np.append(at, total), h1, h2

    def windows(self, h: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
        """The hash of each run of size words, by start; runs across documents are there too."""
        step = 1 << 16
        return np.concatenate([run_hashes(h[i : i + step + size - 1], size, lane) for i in range(0, max(len(h) - size + 1, 1), step)])

    def anchors(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, hash) of anchors at cover positions, in documents of a window's length or more."""
        if len(h) < self.window:
            return np.empty(0, np.int64), np.empty(0, U64)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(h)) - at[doc]
        size = np.diff(at)[doc]
        pos = np.flatnonzero(self.in_cover[place % self.modulus] & (place + self.anchor <= size) & (size >= self.window))
        return pos, self.windows(h, self.anchor)[pos]

    def round1(self, g: int, docs: pa.Table):
        *_, at, h, _ = self.scan(docs)
        records = X.key_records(self.anchors(at, h)[1])
        return X.packed(g, 0, records, records["key"], self.buckets)

    def candidates(self, docs: pa.Table, mail: X.Inbox):
        """Starts and digests of windows over a repeated anchor; and of those the earliest of each digest, ordered by digest."""
        data, s, e, at, h1, h2 = self.scan(docs)
        pos, key = self.anchors(at, h1)
        pos = pos[member(key, np.sort(mail.get(0, "<u8")))]
        n = len(h1)
        if n < self.window or not len(pos):
            empty = np.empty(0, np.int64)
            return data, s, e, at, empty, np.empty((0, 2), U64), empty, empty
        delta = np.zeros(n + 1, np.int32)
        np.add.at(delta, np.maximum(pos - self.modulus + 1, 0), 1)
        np.add.at(delta, pos + 1, -1)
        live = np.cumsum(delta)[:n] > 0
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        start = np.flatnonzero(live & (np.arange(n) + self.window <= at[1:][doc]))
        d = np.column_stack([self.windows(h, self.window, lane)[start] for lane, h in enumerate((h1, h2))])
        order = np.lexsort((start, d[:, 1], d[:, 0]))
        new = np.concatenate([[True], (d[order][1:] != d[order][:-1]).any(1)]) if len(order) else np.empty(0, bool)
        return data, s, e, at, start, d, order[new], doc

    def round2(self, g: int, docs: pa.Table, mail: X.Inbox):
        _, _, _, at, start, d, first, doc = self.candidates(docs, mail)
        ids = docs["doc_id"].fill_null(NULL_ID).to_numpy()
        out = np.empty(len(first), PLACE)
        own = doc[start[first]] if len(first) else np.empty(0, np.int64)
        out["d1"], out["d2"], out["doc"], out["row"], out["start"] = d[first, 0], d[first, 1], ids[own], own, start[first] - at[own]
        return X.packed(g, 1, out, out["d1"], self.buckets)

    def decide(self, gs: list[int], _: list[int], blobs: list[bytes]) -> list[tuple]:
        """A bit for each window that a group sent: its earliest place is the earliest of all."""
        sent = [np.frombuffer(b, PLACE) for b in blobs]
        every = np.concatenate(sent)
        owner = np.repeat(np.arange(len(gs)), [len(s) for s in sent])
        order = np.lexsort((every["start"], every["row"], owner, every["doc"], every["d2"], every["d1"]))
        x = every[order]
        best = np.empty(len(x), bool)
        best[order] = np.concatenate([[True], (x["d1"][1:] != x["d1"][:-1]) | (x["d2"][1:] != x["d2"][:-1])])
        edges = np.cumsum([0, *map(len, sent)])
        return [(g, 1, best[edges[i] : edges[i + 1]].tobytes()) for i, g in enumerate(gs)]

    def round3(self, g: int, docs: pa.Table, mail: X.Inbox) -> pa.Table:
        data, s, e, at, start, d, first, _ = self.candidates(docs, mail)
        best = mail.get(1, "?")
        n = len(s)
        later = np.ones(len(start), bool)
        later[first[best]] = False
        delta = np.zeros(n + 1, np.int32)
        np.add.at(delta, start[later], 1)
        np.add.at(delta, start[later] + self.window, -1)
        gone = np.cumsum(delta)[:n] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        view, kept = memoryview(data), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            live = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([view[x:y] for x, y in zip(s[live].tolist(), e[live].tolist(), strict=True)]))
        return pa.table({
            "doc_id": docs["doc_id"].cast(pa.int64()), "n_words": pa.array(np.diff(at)), "n_removed": pa.array(removed[at[1:]] - removed[at[:-1]]),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })


def remove_later_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, group_bytes: int = X.GROUP_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (remaining words joined by one space).

    Null texts have no words; documents of fewer words than window keep all; null ids come first; rows with one
    doc_id are ordered by a hash of their text, so repeated rows are later copies of the first; an empty table gives no rows; other columns are ignored.
    """
    groups, n = X.document_groups(df, id_col, text_col, group_bytes)
    task = Earliest(window, max(1, n // 4))
    known = X.answer(X.send(groups, task.round1), task.buckets, X.repeated_keys)
    known = known.unionByName(X.answer(X.send_again(groups, n, known, task.round2, X.BUCKETED, X.BUCKETED_ARROW), task.buckets, task.decide))
    arrow = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    return X.send_again(groups, n, known, task.round3, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", arrow)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .scratch import documents_of

    return remove_later_copies(documents_of(spark, sf_dir)).drop("kept")


OP4_SQL = """
WITH word AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
start AS (SELECT doc_id, list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1 : i + 20], ' ')) AS keys FROM word WHERE len(w) >= 20),
win AS (SELECT doc_id, unnest(keys) AS k, unnest(range(len(keys))) AS s FROM start),
first AS (SELECT k, min((doc_id, s)) AS f FROM win GROUP BY k HAVING count(*) > 1),
late AS (SELECT doc_id, s FROM win JOIN first USING (k) WHERE (doc_id, s) > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + 1, s + 21)) AS i FROM late),
place AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM word),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM place ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT word.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM word LEFT JOIN kept USING (doc_id)
"""
