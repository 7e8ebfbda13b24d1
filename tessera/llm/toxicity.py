"""Toxicity by Levenshtein automata over a learned lexicon.

1. A lexicon is learned from labels: whole words, and stems (prefixes that several words share), whose smoothed log-odds
   of occurring in toxic against other documents are high.
2. The lexicon is a trie; its product with the Levenshtein automaton (one error for words of five letters or more,
   stems exact) is determinised to one transition table, so that all words of a batch are matched at once.
3. Each match has a context window: within quotation marks, or near a reporting word, it counts as quoted, not as abuse.
4. A logistic model over counts of direct and quoted, exact and misspelled matches and their density gives the score; it is
   fitted around prior means, so that what the labels don't show (say misspellings) still counts as expected.

Words are runs of letters, digits, @ and $, in lower case. Whole texts are scanned; labels, lang, source and doc_id are
never inputs of a score.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import release
from .scratch import documents_of

STEMS, CONTEXT = (4, 5, 6), 8
CHUNK_CHARS = 1 << 20
QUOTES = "\"“”„«»"
#: Words that report another's speech.
REPORTING = frozenset("said says wrote writes quoted quote called reported dit écrit cité sagte schrieb zitiert dijo escribió citó".split())
PRIOR = np.array([-2.5, 2.0, 1.5, 0.3, 0.2, 0.5])
STRENGTH = np.array([0.01, 0.5, 1.0, 1.0, 1.0, 1.0])


@functools.cache
def letters() -> np.ndarray:
    """1 for code points that words are made of."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if (x := chr(c)).isalnum() or x in "@$"]] = 1
    return out


class Automaton:
    """The trie of entries (text, is_stem), intersected with words up to one error from an entry."""

    def __init__(self, entries: list[tuple[str, bool]], fuzzy_from: int = 5) -> None:
        self.alphabet = sorted({c for text, _ in entries for c in text})
        kinds = {c: i + 1 for i, c in enumerate(self.alphabet)}  # 0: any other letter
        children: list[dict[int, int]] = [{}]
        word_end, stem_end, fuzzy = [False], [False], [False]
        for text, is_stem in entries:
            node, path = 0, [0]
            for c in text:
                if kinds[c] not in children[node]:
                    children[node][kinds[c]] = len(children)
                    children.append({})
                    word_end.append(False)
                    stem_end.append(False)
                    fuzzy.append(False)
                node = children[node][kinds[c]]
                path.append(node)
            (stem_end if is_stem else word_end)[node] = True
            if not is_stem and len(text) >= fuzzy_from:
                for x in path:
                    fuzzy[x] = True
        n = len(self.alphabet) + 1
        stem = -1  # absorbing: a stem has been read
        #: nodes of a fuzzy word's path whose subtree ends a fuzzy word
        long_end = {}
        for text, is_stem in entries:
            if not is_stem and len(text) >= fuzzy_from:
                node = 0
                for c in text:
                    node = children[node][kinds[c]]
                long_end[node] = True

        def closed(states: set[tuple[int, int]]) -> frozenset:
            more = set(states)
            for node, errors in states:
                if node != stem and errors == 0:
                    more |= {(child, 1) for child in children[node].values() if fuzzy[child]}  # a letter left out
            if any(node != stem and stem_end[node] and not errors for node, errors in more):
                more.add((stem, 0))
            return frozenset((x, e) for x, e in more if not (e and (x, 0) in more))

        def step(states: frozenset, kind: int) -> frozenset:
            out: set[tuple[int, int]] = set()
            for node, errors in states:
                if node == stem:
                    out.add((stem, 0))
                    continue
                child = children[node].get(kind)
                if child is not None and (not errors or fuzzy[child]):
                    out.add((child, errors))
                if not errors:
                    if fuzzy[node]:
                        out.add((node, 1))  # a letter too many
                    out |= {(x, 1) for x in children[node].values() if fuzzy[x]}  # another letter
            return closed(out)

        start = closed({(0, 0)})
        number, queue, table = {frozenset(): 0, start: 1}, [start], {}
        while queue:
            states = queue.pop()
            for kind in range(n):
                after = step(states, kind)
                if after not in number:
                    number[after] = len(number)
                    queue.append(after)
                table[number[states], kind] = number[after]
        self.table = np.zeros((len(number), n), np.int32)
        for (state, kind), after in table.items():
            self.table[state, kind] = after
        #: 0 no match, 1 exact, 2 misspelled
        self.accepts = np.zeros(len(number), np.uint8)
        for states, i in number.items():
            if any(x == stem or (not e and word_end[x]) for x, e in states):
                self.accepts[i] = 1
            elif any(e and long_end.get(x) for x, e in states):
                self.accepts[i] = 2

    @functools.cached_property
    def classes(self) -> np.ndarray:
        """0 separator, 1 other letter, 2 + i the i-th letter of the alphabet."""
        out = letters().copy()
        for i, c in enumerate(self.alphabet):
            out[ord(c)] = i + 2
        return out

    def match(self, kinds: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """accepts of each word; kinds: classes of all characters."""
        state, live, at = np.ones(len(start), np.int32), np.arange(len(start)), 0
        result = np.zeros(len(start), np.uint8)
        current = state
        while len(live):
            current = self.table[current, kinds[start[live] + at] - 1]
            at += 1
            done = length[live] == at
            result[live[done]] = self.accepts[current[done]]
            go = ~done & (current != 0)
            live, current = live[go], current[go]
        return result


def features(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """One row per text: 1, direct exact, direct misspelled, quoted exact, quoted misspelled (log1p of counts), density."""
    out, first = np.zeros((len(texts), 6)), 0
    out[:, 0] = 1
    size = np.cumsum([len(t) for t in texts])
    while first < len(texts):
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + CHUNK_CHARS, "right")))
        lower = [t.lower() for t in texts[first:last]]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in lower])])
        text = "".join(lower)
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kinds = automaton.classes[code]
        solid = kinds > 0
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edge = offsets[:-1][offsets[:-1] < len(code)]
        begin[edge] = solid[edge]
        end[edge[edge > 0] - 1] = solid[edge[edge > 0] - 1]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        found = automaton.match(kinds, start, stop - start)
        hits = np.flatnonzero(found)
        at = np.searchsorted(start, offsets)
        words = np.diff(at)
        if len(hits):
            doc = np.searchsorted(offsets, start[hits], "right") - 1
            from_word, to_word = np.maximum(hits - CONTEXT, at[doc]), np.minimum(hits + CONTEXT, at[doc + 1] - 1)
            left = np.where(from_word == at[doc], offsets[doc], start[from_word])
            right = np.where(to_word == at[doc + 1] - 1, offsets[doc + 1], stop[to_word])
            marks = np.concatenate([[0], np.cumsum(np.isin(code, [ord(c) for c in QUOTES]))])
            quoted = ((marks[start[hits]] - marks[left]) % 2 == 1) & (marks[right] > marks[stop[hits]])
            for i in np.flatnonzero(~quoted).tolist():
                quoted[i] = not REPORTING.isdisjoint(re.findall(r"\w+", text[left[i] : right[i]]))
            kind = (found[hits] - 1) + 2 * quoted
            count = np.bincount(doc * 4 + kind, minlength=4 * len(lower)).reshape(-1, 4)
            out[first:last, 1:5] = np.log1p(count)
            out[first:last, 5] = np.log1p(50 * count[:, :2].sum(1) / np.maximum(words, 1))
        first = last
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression around PRIOR, by Newton steps."""
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + STRENGTH * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(STRENGTH)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn_lexicon(sample: DataFrame, size: int, least_evidence: float, odds: float) -> list[tuple[str, bool]]:
    """sample (text, toxic) -> entries (text, is_stem), the best first; at most size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip((t for piece in pieces(batch["text"]) for t in piece.to_pylist()), batch["toxic"].to_pylist(), strict=True):
                words = set(re.findall(r"[^\W_]{3,30}", (text or "").lower()))
                counts.update((w, False, toxic) for w in words)
                counts.update((w, True, toxic) for w in {w[:k] for w in words for k in STEMS if len(w) > k})
            keys = list(counts)
            release()
            yield pa.RecordBatch.from_pydict({"entry": [k[0] for k in keys], "stem": [k[1] for k in keys], "toxic": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([counts[k] for k in keys], pa.int64())})

    total = {r[0]: r[1] for r in sample.groupBy("toxic").agg(F.count("*")).collect()}  # two rows
    counted = sample.mapInArrow(task, "entry string, stem boolean, toxic int, n long").groupBy("entry", "stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    score = F.log((F.col("bad") + 0.5) / (total.get(1, 0) + 1.0)) - F.log((F.col("good") + 0.5) / (total.get(0, 0) + 1.0))
    rate, n = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1.0), F.col("bad") + F.col("good")
    # likelihood ratio against chance, so that rare words of a few toxic documents stay out
    evidence = 2 * (F.col("bad") * F.log(F.col("bad") / (n * rate)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - rate)))).otherwise(0.0))
    best = counted.where(F.col("bad") >= 1).withColumn("score", score).where((F.col("score") >= odds) & (evidence >= least_evidence)).orderBy(F.desc("score"), F.desc("bad"), "entry", "stem").limit(8 * size).collect()  # bounded by size
    words = {r["entry"]: r["bad"] for r in best if not r["stem"]}
    chosen: list[tuple[str, bool]] = []
    for r in sorted((r for r in best if r["stem"]), key=lambda r: (len(r["entry"]), -r["bad"])):
        stem = r["entry"]
        inside = [n for w, n in words.items() if w.startswith(stem)]
        # a stem stands for several words, none of which explains it alone
        if not any(stem.startswith(c) for c, is_stem in chosen if is_stem) and max(inside, default=0) < 0.7 * r["bad"]:
            chosen.append((stem, True))
    words = {w for w in words if not any(w.startswith(c) for c, _ in chosen)}
    rank = {(r["entry"], r["stem"]): i for i, r in enumerate(best)}
    return sorted([*chosen, *((w, False) for w in words)], key=lambda x: rank[x])[:size]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 12_000, size: int = 200, least_evidence: float = 24.0, odds: float = 2.0) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """(lexicon, weights) from at most max_labelled labelled documents that are not held out, taken in hash order."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumnRenamed("doc_id", "_id")
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(known), "_id").select("text", "toxic")  # bounded by max_labelled
    lexicon = learn_lexicon(sample, size, least_evidence, odds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            x = [row for piece in pieces(batch["text"]) for row in features(automaton, piece.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["toxic"]], names=["x", "toxic"])
            release()

    rows = sample.mapInArrow(task, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()  # at most max_labelled
    if not rows:
        return lexicon, PRIOR
    x, y = np.repeat(np.array([r["x"] for r in rows]), [r["n"] for r in rows], axis=0), np.repeat([r["toxic"] for r in rows], [r["n"] for r in rows])
    return lexicon, fit(x, y.astype(float))


def pieces(texts: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[pa.Array]:
    """Slices of about that many bytes; a longer text stands alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + chars, "right")))
        yield texts.slice(first, last - first)
        first = last


def score_of(text_col: str, lexicon: list[tuple[str, bool]], weights: np.ndarray) -> Column:
    """The score of a text column. Only texts go to Python and only scores come back; null texts are empty, empty texts have the score of no match."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(lexicon)
        for batch in batches:
            x = [features(automaton, ["" if t is None else t for t in piece.to_pylist()]) @ weights for piece in pieces(batch)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(x) if x else np.empty(0), -30, 30))))
            del batch
            release()

    return score(F.col(text_col))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Without labels of both kinds, or with too few for least_evidence, there is no lexicon and every score is the prior's;
    null ids are held in; rows that repeat are scored alike; an empty table gives no rows; other columns are ignored.
    """
    lexicon, weights = train(df, labels, id_col, text_col, **options)
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), score_of(text_col, lexicon, weights).alias("score"))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "labels"))
