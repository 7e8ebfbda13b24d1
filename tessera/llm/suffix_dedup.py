"""Suffix-array dedup by prefix-free parsing.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes; all copies go, overlaps count.

The corpus is parsed at content-defined triggers: positions whose rolling hash is the least of a whole window of
``length`` bytes. Unlike a modulo trigger this leaves no window without one, and the trigger depends on the window's
bytes only, so equal windows are aligned at equal triggers. A trigger occurrence has a *dictionary phrase*, the bytes
before it, and a *parse suffix*, the bytes from it on; a window is a suffix of the first followed by a prefix of the
second. As in prefix-free parsing, the suffixes of the phrases are ordered once (sorted reversed, with common lengths
of neighbours), the parse suffixes are ordered once (sorted, with common lengths of neighbours), and the two orders
combine into the order of all windows: two windows are equal if they fall in one class of either order at its depth.
Nothing deeper than ``length`` is sorted, and only triggers that occur twice are.

Rounds (see exchange.py): 1. trigger fingerprints; buckets answer which repeat. 2. 128-bit digests of the whole context
of repeated triggers; equal contexts are settled as a class, and only triggers with two or more different contexts stay
open. 3. one context of each class of open triggers travels to the trigger's bucket, where the two orders are built and
combined. Triggers that many groups hold, or with over ``open_limit`` contexts, are not brought together: their contexts
are dealt by digest, and their windows travel as 128-bit digests, each once from a group, dealt by digest too. 4. each
group applies the answers.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import exchange as X
from .rolling import CHUNK, U64, Roller, chunks, member, mix, utf8

GRAM = 32
TIES = U64((1 << 22) - 1)
CONTEXT = np.dtype([("a", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("many", "?")])
#: What an open context brings to its trigger's bucket, before its bytes.
OPEN = np.dtype([("a", "<u8"), ("ord", "<i4"), ("pos", "<i8"), ("left", "<i4"), ("right", "<i4"), ("single", "?")])
STATE = np.dtype([("a", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("state", "u1")])
#: Contexts ordered at a time.
SLICE = 4096
WINDOW = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("many", "?")])
#: Bits of state.
COPIED, SHIP, HOT = 1, 2, 4


def least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every run of span values, by doubling."""
    width = 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (span - width)], values[span - width :])


class Parser:
    def __init__(self, length: int) -> None:
        self.length, self.gram, self.roller = length, min(GRAM, length), Roller(7)

    def triggers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(fingerprint, document, trigger, first and last window start) of each trigger that some window chose; positions within the document.

        A document longer than a chunk is parsed in pieces that overlap by length - 1 bytes.
        """
        found: list[tuple[np.ndarray, ...]] = []
        for first, last in chunks(offsets):
            begin, end = int(offsets[first]), int(offsets[last])
            step = end - begin if last - first > 1 else CHUNK
            for at in range(begin, max(end, begin + 1), max(step, 1)):
                stop = min(end, at + step + self.length - 1) if last - first == 1 else end
                found.append(self.piece(data[at:stop], offsets[first : last + 1], first, at))
        out = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, t) for t in (U64, np.int64, np.int64, np.int64, np.int64)]
        doc, rest = out[1], [x - offsets[out[1]] for x in out[2:]]
        return out[0], doc, *rest

    def piece(self, data: np.ndarray, offsets: np.ndarray, first: int, at: int) -> tuple[np.ndarray, ...]:
        n, w = len(data), self.length
        if n < w:
            return (np.empty(0, U64), *[np.empty(0, np.int64)] * 4)
        grams = self.roller.windows(data, self.gram)
        key = grams & ~TIES
        key |= TIES - np.arange(len(grams), dtype=U64)
        key = least(key, w - self.gram + 1)
        inside = np.ones(len(key) + 1, np.int8)
        if len(offsets) > 2:
            delta = np.zeros(len(key) + 1, np.int32)
            edges = offsets[1:-1] - at
            np.add.at(delta, np.minimum(np.maximum(np.maximum(edges - w + 1, offsets[:-2] - at), 0), len(key)), 1)
            np.add.at(delta, np.minimum(edges, len(key)), -1)
            inside = np.cumsum(delta) == 0
        start = np.flatnonzero(inside[: len(key)])
        key = key[start]
        if not len(key):
            return (np.empty(0, U64), *[np.empty(0, np.int64)] * 4)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pos = (TIES - (key[new] & TIES)).astype(np.int64)
        sf, sl = start[new], start[np.append(new[1:], len(key)) - 1]
        doc = first + np.searchsorted(offsets, sf + at, "right") - 1
        # the least hash of a window is small: mixed again, so that fingerprints spread over all buckets
        return mix(~grams[pos]), doc, pos + at, sf + at, sl + at


def digests(data: np.ndarray, begin: np.ndarray, trigger: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each context data[begin:end], with the place of its trigger."""
    view, out = memoryview(data), np.empty((len(begin), 2), U64)
    for i, (b, t, e) in enumerate(zip(begin.tolist(), trigger.tolist(), end.tolist(), strict=True)):
        x = xxhash.xxh3_128_intdigest(view[b:e], seed=t - b)
        out[i] = x >> 64, x & 0xFFFFFFFFFFFFFFFF
    return out


class Repeats:
    """The rounds' tasks. length: bytes of a string that may not occur twice."""

    def __init__(self, length: int, buckets: int, open_limit: int) -> None:
        self.length, self.buckets, self.open_limit = length, buckets, open_limit

    def parse(self, docs: pa.Table):
        data, offsets = utf8(docs["text"])
        return data, offsets, *Parser(self.length).triggers(data, offsets)

    def round1(self, g: int, docs: pa.Table):
        records = X.key_records(self.parse(docs)[2])
        return X.packed(g, 0, records, records["key"], self.buckets)

    def repeated(self, docs: pa.Table, mail: X.Inbox):
        """Contexts of triggers that repeat: fingerprint, document, trigger, first start, last start, digest."""
        data, offsets, a, doc, pos, sf, sl = self.parse(docs)
        keep = member(a, np.sort(mail.get(0, "<u8")))
        a, doc, pos, sf, sl = (x[keep] for x in (a, doc, pos, sf, sl))
        base = offsets[doc]
        return data, base, a, doc, pos, sf, sl, digests(data, base + sf, base + pos, base + sl + self.length)

    def round2(self, g: int, docs: pa.Table, mail: X.Inbox):
        *_, a, _, _, _, _, d = self.repeated(docs, mail)
        order = np.lexsort((d[:, 1], d[:, 0], a))
        a, d = a[order], d[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]).any(1)])) if len(a) else np.empty(0, np.int64)
        out = np.empty(len(new), CONTEXT)
        out["a"], out["d1"], out["d2"], out["many"] = a[new], d[new, 0], d[new, 1], np.diff(np.append(new, len(a))) > 1
        hot = member(out["a"], np.sort(mail.get(9, "<u8")))
        yield from X.packed(g, 1, out[~hot], out["a"][~hot], self.buckets)
        out = out[hot]
        out = out[np.argsort(out["d1"], kind="stable")]
        yield from X.packed(g, 5, out, out["d1"], self.buckets)

    def settle(self, gs: list[int], kinds: list[int], blobs: list[bytes]) -> list[tuple]:
        """Which contexts are copied; of triggers with several contexts (and of hot ones), one group ships each."""
        sent = [np.frombuffer(b, CONTEXT) for b in blobs]
        c = np.concatenate(sent)
        owner = np.repeat(np.arange(len(gs)), [len(s) for s in sent])
        hot = np.repeat([k == 5 for k in kinds], [len(s) for s in sent])
        order = np.lexsort((owner, c["d2"], c["d1"], c["a"]))
        c, owner, hot = c[order], owner[order], hot[order]
        new_a = np.concatenate([[True], c["a"][1:] != c["a"][:-1]])
        new = new_a | np.concatenate([[True], (c["d1"][1:] != c["d1"][:-1]) | (c["d2"][1:] != c["d2"][:-1])])
        cls, trigger = np.cumsum(new) - 1, np.cumsum(new_a) - 1
        copied = (np.bincount(cls) > 1) | (np.bincount(cls, c["many"]) > 0)
        contexts = np.bincount(trigger[new])[trigger]
        state = copied[cls] * COPIED + (new & (hot | (contexts > 1))) * (SHIP + (hot | (contexts > self.open_limit)) * HOT)
        out = np.empty(len(c), STATE)
        out["a"], out["d1"], out["d2"], out["state"] = c["a"], c["d1"], c["d2"], state
        keep = out["state"] > 0
        out, owner = out[keep], owner[keep]
        back = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[back], np.arange(len(gs) + 1))
        return [(g, 1, out[back[edges[i] : edges[i + 1]]].tobytes()) for i, g in enumerate(gs) if edges[i] < edges[i + 1]]

    def stated(self, docs: pa.Table, mail: X.Inbox):
        """As repeated(), with each context's state."""
        data, base, a, doc, pos, sf, sl, d = self.repeated(docs, mail)
        known = mail.get(1, STATE)
        state = np.zeros(len(a), np.uint8)
        if len(known) and len(a):
            # both sides ranked together: equal (a, digest) gets one rank
            alls = np.concatenate([np.stack([known["a"], known["d1"], known["d2"]], 1), np.column_stack([a, d])])
            order = np.lexsort((alls[:, 2], alls[:, 1], alls[:, 0]))
            ranks = np.empty(len(alls), np.int64)
            ranks[order] = np.cumsum(np.concatenate([[0], (alls[order][1:] != alls[order][:-1]).any(1)]))
            by_rank = np.zeros(ranks.max() + 1, np.uint8)
            by_rank[ranks[: len(known)]] = known["state"]
            state = by_rank[ranks[len(known) :]]
        # one occurrence in the group ships the class
        key = np.column_stack([a, d]) if len(a) else np.empty((0, 3), U64)
        order = np.lexsort((pos, doc, key[:, 2], key[:, 1], key[:, 0]))
        again = order[1:][(key[order][1:] == key[order][:-1]).all(1)] if len(a) else np.empty(0, np.int64)
        state[again] &= COPIED
        return data, base, a, doc, pos, sf, sl, state

    def round3(self, g: int, docs: pa.Table, mail: X.Inbox):
        data, base, a, doc, pos, sf, sl, state = self.stated(docs, mail)
        view = memoryview(data)
        cold = np.flatnonzero((state & SHIP > 0) & (state & HOT == 0))
        cold = cold[np.argsort(a[cold], kind="stable")]
        bucket = X.bucket_of(a[cold], self.buckets)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(cold) else []
        for s, e in zip(edges[:-1], edges[1:], strict=True) if len(cold) else ():
            i = cold[s:e]
            head = np.empty(len(i), OPEN)
            head["a"], head["ord"], head["pos"], head["left"] = a[i], doc[i], pos[i], pos[i] - sf[i]
            head["right"], head["single"] = sl[i] + self.length - pos[i], state[i] & COPIED == 0
            body = b"".join(view[b + f : b + t + self.length] for b, f, t in zip(base[i].tolist(), sf[i].tolist(), sl[i].tolist(), strict=True))
            yield int(bucket[s]), g, 2, len(i).to_bytes(8, "little") + head.tobytes() + body
        _, d = self.hot_windows(data, base, pos, sf, sl, state)
        if len(d):
            order = np.lexsort((d[:, 1], d[:, 0]))
            d = d[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]).any(1)]))
            out = np.empty(len(new), WINDOW)
            out["d1"], out["d2"], out["many"] = d[new, 0], d[new, 1], np.diff(np.append(new, len(d))) > 1
            yield from X.packed(g, 3, out, out["d1"], self.buckets)

    def hot_windows(self, data, base, pos, sf, sl, state) -> tuple[np.ndarray, np.ndarray]:
        """(context and start of each window, its digest) of the hot contexts that this group ships."""
        hot = np.flatnonzero(state & HOT)
        n = (sl - sf + 1)[hot]
        who = np.repeat(hot, n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + sf[who]
        begin = base[who] + start
        return np.column_stack([who, start]), digests(data, begin, begin, begin + self.length)

    def order(self, gs: list[int], kinds: list[int], blobs: list[bytes]) -> list[tuple]:
        """Combines the orders of phrases and parse suffixes; answers (document, first start, last start) of repeated windows of contexts met once."""
        out = self.repeated_windows([(g, b) for g, k, b in zip(gs, kinds, blobs, strict=True) if k == 3])
        heads, bodies, cuts, owners, at = [], [], [], [], 0
        for i, (kind, blob) in enumerate(zip(kinds, blobs, strict=True)):
            if kind == 2:
                n = int.from_bytes(blob[:8], "little")
                head = np.frombuffer(blob, OPEN, n, 8)
                body = np.frombuffer(blob, np.uint8, offset=8 + n * OPEN.itemsize)
                heads.append(head)
                bodies.append(body)
                cuts.append(at + np.cumsum(head["left"] + head["right"], dtype=np.int64) - head["right"])
                owners.append(np.full(n, i))
                at += len(body)
        if not heads:
            return out
        head, body, cut, owner = (np.concatenate(x) for x in (heads, bodies, cuts, owners))
        by_trigger = np.argsort(head["a"], kind="stable")
        edges = np.append(np.flatnonzero(np.concatenate([[True], head["a"][by_trigger][1:] != head["a"][by_trigger][:-1]])), len(head))
        found, i = [], 0
        while i < len(edges) - 1:  # some triggers at a time, at least one
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + SLICE, "right")) - 1)
            who = by_trigger[edges[i] : edges[j]]
            found += [(who[x], e) for x, e in self.combined(head[who], cut[who], body)]
            i = j
        who = np.concatenate([x for x, _ in found])
        start = head["pos"][who] - np.repeat([e for _, e in found], [len(x) for x, _ in found])
        order = np.lexsort((start, head["ord"][who], owner[who]))
        own, doc, start = owner[who][order], head["ord"][who][order], start[order]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])) if len(own) else np.empty(0, np.int64)
        runs = np.empty(len(first), RUN)
        runs["ord"], runs["first"], runs["last"] = doc[first], start[first], start[np.append(first[1:], len(own)) - 1] if len(first) else 0
        own = own[first]
        for i in np.unique(own).tolist():
            out.append((gs[i], 2, runs[own == i].tobytes()))
        return out

    def combined(self, head: np.ndarray, cut: np.ndarray, body: np.ndarray):
        """(contexts met once whose window starting e bytes before the trigger repeats, e) for each e."""
        width, n = self.length, len(head)
        ahead = np.arange(width)
        # padded to the window's length: phrases reversed, ending at the trigger, and parse suffixes
        left = np.where(ahead < head["left"][:, None], body[np.maximum(cut[:, None] - 1 - ahead, 0)], 0).astype(np.uint8)
        right = np.where(ahead < head["right"][:, None], body[np.minimum(cut[:, None] + ahead, len(body) - 1)], 0).astype(np.uint8)
        order_l, common_l = sorted_common(head["a"], left, head["left"])
        order_r, common_r = sorted_common(head["a"], right, head["right"])
        cls_l, cls_r = np.empty(n, np.int64), np.empty(n, np.int64)
        for e in range(int(head["left"].max()) + 1):
            cls_l[order_l] = np.cumsum(common_l < e)
            cls_r[order_r] = np.cumsum(common_r < width - e)
            live = np.flatnonzero((head["left"] >= e) & (head["right"] >= width - e))
            key = cls_l[live] * (n + 1) + cls_r[live]
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(live), bool)
            again[order[1:]] |= same
            again[order[:-1]] |= same
            again = live[again]
            yield again[head["single"][again]].astype(np.int32), e

    def repeated_windows(self, sent: list[tuple[int, bytes]]) -> list[tuple]:
        """Each group hears which of its hot windows occur twice or more in all."""
        arrays = [np.frombuffer(b, WINDOW) for _, b in sent]
        if not arrays:
            return []
        every = np.concatenate(arrays)
        order = np.lexsort((every["d2"], every["d1"]))
        x = every[order]
        same = (x["d1"][1:] == x["d1"][:-1]) & (x["d2"][1:] == x["d2"][:-1])
        found = x["many"].copy()
        found[1:] |= same
        found[:-1] |= same
        again = np.empty(len(x), bool)
        again[order] = found
        edges = np.cumsum([0, *map(len, arrays)])
        kept = [every[edges[i] : edges[i + 1]][again[edges[i] : edges[i + 1]]] for i in range(len(sent))]
        return [(g, 3, k.tobytes()) for (g, _), k in zip(sent, kept, strict=True) if len(k)]

    def round4(self, g: int, docs: pa.Table, mail: X.Inbox) -> pa.Table:
        data, base, a, doc, pos, sf, sl, state = self.stated(docs, mail)
        offsets = utf8(docs["text"])[1]
        copied = state & COPIED > 0
        runs = mail.get(2, RUN)
        where, d = self.hot_windows(data, base, pos, sf, sl, np.where(copied, 0, state))
        known = np.sort(mail.get(3, WINDOW), order=("d1", "d2"))
        if len(known) and len(d):  # both ranked together
            alls = np.concatenate([np.column_stack([known["d1"], known["d2"]]), d])
            rank = np.unique(alls[:, 0], return_inverse=True)[1].astype(np.int64) * len(alls) + np.unique(alls[:, 1], return_inverse=True)[1]
            where = where[np.isin(rank[len(known) :], rank[: len(known)])]
        else:
            where = where[:0]
        doc = np.concatenate([doc[copied], runs["ord"], doc[where[:, 0]]]).astype(np.int64)
        first = np.concatenate([sf[copied], runs["first"], where[:, 1]])
        last = np.concatenate([sl[copied], runs["last"], where[:, 1]])
        delta = np.zeros(len(data) + 1, np.int32)
        np.add.at(delta, offsets[doc] + first, 1)
        np.add.at(delta, offsets[doc] + last + self.length, -1)
        gone = np.cumsum(delta)[: len(data)] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        begins[edge] = gone[edge]
        spans = np.concatenate([[0], np.cumsum(begins)])
        view, sha, kept = memoryview(data), [], []
        for i, (b, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            rest = bytes(view[b:e]) if removed[e] == removed[b] else data[b:e][~gone[b:e]].tobytes()
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        return pa.table({
            "doc_id": docs["doc_id"].cast(pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed[offsets[1:]] - removed[offsets[:-1]]),
            "n_spans": pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()),
        })


RUN = np.dtype([("ord", "<i4"), ("first", "<i8"), ("last", "<i8")])


def sorted_common(a: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (trigger, bytes) and, for each place in it, the bytes it shares with the one before (-1: another trigger)."""
    width = -rows.shape[1] % 8
    words = np.pad(rows, ((0, 0), (0, width))).view(">u8").astype(U64)
    order = np.lexsort((lengths, *[words[:, i] for i in range(words.shape[1] - 1, -1, -1)], a))
    x = rows[order]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common = np.minimum(common, np.minimum(lengths[order][1:], lengths[order][:-1]))
    common = np.where(a[order][1:] == a[order][:-1], common, -1)
    return order, np.concatenate([[-1], common]).astype(np.int64)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group_bytes: int = X.GROUP_BYTES, open_limit: int = 4_000, hot_from: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, maybe cut within a character).

    Null texts are empty; texts shorter than length keep all; rows that repeat (even with one doc_id) are copies of each
    other; an empty table gives no rows; other columns are ignored. Equality of whole contexts and of windows of
    triggers beyond open_limit, or that hot_from groups hold, is by 128-bit digests, all else by bytes.
    """
    groups, n = X.document_groups(df, id_col, text_col, group_bytes)
    task = Repeats(length, max(1, n // 2), open_limit)
    known = X.answer(X.send(groups, task.round1), task.buckets, functools.partial(X.repeated_keys, hot_from=hot_from))
    known = known.unionByName(X.answer(X.send_again(groups, n, known, task.round2, X.BUCKETED, X.BUCKETED_ARROW), task.buckets, task.settle))
    known = known.unionByName(X.answer(X.send_again(groups, n, known, task.round3, X.BUCKETED, X.BUCKETED_ARROW), task.buckets, task.order))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    arrow = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    return X.send_again(groups, n, known, task.round4, schema, arrow)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .scratch import documents_of

    return remove_repeats(documents_of(spark, sf_dir)).drop("kept")
