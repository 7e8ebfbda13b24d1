"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation, and an add-one unigram base.

Symbols are the end of a text, the most frequent words, and classes of all other words by a hash of their last two bytes. The
model predicts a symbol's vector as C1 r(previous) + C2 r(one before), scores all symbols by a product with their
output vectors plus a bias, and within a class gives a word its add-one share (each class keeps one share for words
never seen). So probabilities are normalised over all words.

1. Words are counted over all training documents: a group of documents sends each distinct word once, as a 96-bit hash
   with its count, dealt by hash; answers bring the whole corpus' count of each (see exchange.py). No task holds all
   occurrences of a word.
2. Documents become arrays of symbols, written once, with what the base needs.
3. Each round, every task trains on its own documents from the round's parameters, in numpy; the parameters that come back are
   averaged by the number of tokens, in two steps. All training documents take part in every round.
4. The score of exp(a + b) summed over symbols is a product of two matrices, so one matrix product gives the normaliser of
   every pair of context symbols, exactly; scoring a token takes three look-ups.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .rolling import LOWER, U64, chunks, distinct_pairs, utf8, word_hashes, words
from .scratch import documents_of, materialize

GROUP_BYTES = 8 << 20
#: Symbol 0 ends a text (and stands before it), 1 to CLASSES are classes of rarer words, the rest are words.
SYMBOLS, CLASSES, DIM = 2048, 255, 32
ROUNDS, BATCH, NOISE, RATE = 3, 2048, 96, 0.08
RECORD = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("n", "<u4"), ("cls", "<u2")])
TOTAL = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("n", "<u8"), ("cls", "<u2")])


@dataclass
class Parameters:
    """context: vectors of symbols as context; out: as predicted; bias; first, second: the two positions' matrices."""

    context: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int, seed: int = 11) -> "Parameters":
        """Small vectors, so that the first guess is the unigram distribution."""
        rng = np.random.default_rng(seed)
        n = len(unigram)
        draw = lambda: rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        return cls(draw(), draw(), np.log(unigram).astype(np.float32), np.eye(dim, dtype=np.float32), 0.5 * np.eye(dim, dtype=np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.out, self.bias, self.first, self.second]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> "Parameters":
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Parameters(*out)


def row_sums(size: int, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A matrix of size rows: the values of each row number, summed. Columns are added in pairs, as complex numbers."""
    width = parts[0][1].shape[1]
    out = np.zeros((size, width), np.float32)
    lanes = out if width % 2 else out.view(np.complex64)
    places = np.arange(lanes.size).reshape(lanes.shape)
    for rows, values in parts:
        np.add.at(lanes.reshape(-1), places.take(rows, 0).ravel(), values.view(lanes.dtype).ravel())
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def logistics(first: np.ndarray, second: np.ndarray, previous: np.ndarray, before: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(first[previous] + second[before])). Where no exponential nears the ends of single precision, the exponentials
    of the rows are multiplied, which takes one a distinct symbol instead of one a token."""
    with np.errstate(over="ignore"):  # exp may be infinite, its logistic is 0 then
        if max(np.abs(first).max(), np.abs(second).max()) < 80:
            out = np.exp(first).take(previous, 0)
            out *= np.exp(second).take(before, 0)
        else:
            out = first.take(previous, 0)
            out += second.take(before, 0)
            np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Trainer:
    """Noise-contrastive estimation by AdaGrad; noise symbols are drawn once a batch and shared by its tokens.

    A step's work follows its batch: products with the two matrices are made once a distinct symbol, equal noise symbols count
    as one with a weight, and rows without a gradient, which AdaGrad leaves as they are, aren't touched.
    """

    def __init__(self, model: Parameters, unigram: np.ndarray, rate: float, noise: int, seed: int) -> None:
        m = model
        self.context, self.turn = m.context.copy(), np.vstack([m.first, m.second])
        self.out = np.column_stack([m.out, m.bias])  # the bias is the weight of a constant
        self.square = {id(a): np.ones_like(a) for a in (self.context, self.out, self.turn)}
        self.rate, self.noise, self.rng = rate, noise, np.random.default_rng(seed)
        self.odds = np.log(noise * unigram).astype(np.float32)
        self.cumulative = np.cumsum(unigram)
        self.marked, self.number = np.zeros(len(unigram), bool), np.zeros(len(unigram), np.int64)
        self.tokens = 0

    @property
    def m(self) -> Parameters:
        dim = self.context.shape[1]
        return Parameters(self.context, self.out[:, :-1].copy(), self.out[:, -1].copy(), self.turn[:dim], self.turn[dim:])

    def distinct(self, *symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(all symbols once, ascending; where in these each is)."""
        for x in symbols:
            self.marked[x] = True
        rows = np.flatnonzero(self.marked)
        self.marked[rows] = False
        self.number[rows] = np.arange(len(rows))
        return rows, [self.number.take(x) for x in symbols]

    def move(self, array: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Uphill, in these rows."""
        square = self.square[id(array)]
        now = square.take(rows, 0)
        now += gradient * gradient
        square[rows] = now
        array[rows] += gradient * (self.rate / np.sqrt(now))

    def step(self, contexts: np.ndarray, word: np.ndarray) -> None:
        """contexts: (previous, one before) of each word."""
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise)), len(self.odds) - 1)
        noise, times = np.unique(noise, return_counts=True)
        times = times.astype(np.float32)[:, None]
        n, dim = len(word), self.context.shape[1]
        first, second = self.turn[:dim], self.turn[dim:]
        near, (previous, before) = self.distinct(contexts[:, 0], contexts[:, 1])
        seen = self.context.take(near, 0)
        by_first, by_second = seen @ first, seen @ second
        guess = by_first.take(previous, 0)
        guess += by_second.take(before, 0)
        target, others = self.out.take(word, 0), self.out.take(noise, 0)
        target, bias = target[:, :-1], target[:, -1]
        up = sigmoid(self.odds.take(word) - bias - np.einsum("ij,ij->i", guess, target))  # how far true words are from certainty
        against = -others[:, :-1].T
        down = logistics(by_first @ against, by_second @ against + (self.odds.take(noise) - others[:, -1]), previous, before)
        d_guess = target * up[:, None]
        d_guess -= down @ (others[:, :-1] * times)
        d_noise = np.column_stack([down.T @ guess, np.ones(n, np.float32) @ down])
        d_noise *= -times
        sums = row_sums(2 * len(near), (previous, d_guess), (before + len(near), d_guess))
        d_first, d_second = sums[: len(near)], sums[len(near) :]
        d_seen = d_first @ first.T + d_second @ second.T
        d_turn = np.vstack([seen.T @ d_first, seen.T @ d_second])
        far, (word, noise) = self.distinct(word, noise)
        d_out = np.empty((len(far), dim + 1), np.float32)
        guess *= up[:, None]
        d_out[:, :-1] = row_sums(len(far), (word, guess))
        d_out[:, -1] = np.bincount(word, up, len(far))
        d_out[noise] += d_noise
        self.move(self.context, near, d_seen)
        self.move(self.out, far, d_out)
        self.move(self.turn, np.arange(2 * dim), d_turn)
        self.tokens += n


def contexts_of(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one before the previous, previous) symbol of each token of texts that begin at at[:-1]; before a text stands its end."""
    previous, before = np.zeros_like(symbols), np.zeros_like(symbols)
    previous[1:], before[2:] = symbols[:-1], symbols[:-2]
    start = at[:-1]
    previous[start], before[start] = 0, 0
    second = (start + 1)[start + 1 < at[1:]]
    before[second] = 0
    return before, previous


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """Packed symbols of a batch's documents, and where each begins."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<u2").astype(np.int64), np.cumsum([0, *(len(b) // 2 for b in blobs)])


class Tables:
    """Scores by context position and the normaliser of every pair of contexts."""

    def __init__(self, m: Parameters) -> None:
        context, out = m.context.astype(np.float64), m.out.astype(np.float64)
        first = context @ m.first @ out.T + m.bias
        second = context @ m.second @ out.T
        a, b = first.max(1, keepdims=True), second.max(1, keepdims=True)
        self.normaliser = (np.log(np.exp(first - a) @ np.exp(second - b).T) + a + b.T).astype(np.float32)
        self.first, self.second = first.astype(np.float32), second.astype(np.float32)

    def log10(self, before: np.ndarray, previous: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (self.first[previous, word].astype(np.float64) + self.second[before, word] - self.normaliser[previous, before]) / math.log(10)


_TABLES: dict[int, Tables] = {}


def tables_of(m: Parameters) -> Tables:
    """Made once in a worker for a model, and kept for its later tasks."""
    key = zlib.crc32(m.flat().tobytes())
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Tables(m)
    return _TABLES[key]


@dataclass
class Corpus:
    """Counts of the training documents: tokens, distinct, of each symbol; share[class]: of its words' counts plus one, summed, plus one."""

    tokens: int
    distinct: int
    h1: np.ndarray
    h2: np.ndarray
    symbol: np.ndarray
    counts: np.ndarray
    share: np.ndarray

    @property
    def unigram(self) -> np.ndarray:
        return (self.counts + 1.0) / (self.counts.sum() + len(self.counts))

    def symbols(self, h1: np.ndarray, h2: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = 1 + cls.astype(np.int64)
        if len(self.h1):
            at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
            hit = (self.h1[at] == h1) & (self.h2[at] == h2)
            out[hit] = self.symbol[at[hit]]
        return out


class Reader:
    """Words of a group's documents and what is sent and said about them."""

    def __init__(self, buckets: int, every: int, held: int, classes: int) -> None:
        self.buckets, self.every, self.held, self.classes = buckets, every, held, classes

    def held_out(self, ids: list[int | None]) -> np.ndarray:
        return np.array([i is not None and zlib.crc32(b"%d" % i) % self.every == self.held for i in ids], bool)

    def scan(self, docs: pa.Table):
        """(first word of each document, order of words by hash, which of these begin a distinct word, hashes and classes of all)."""
        data, offsets = utf8(docs["text"])
        parts, total = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.uint16))], 0
        for a, b in chunks(offsets):
            begin = int(offsets[a])
            piece = LOWER[data[begin : int(offsets[b])]]
            s, e, at = words(piece, offsets[a : b + 1] - begin)
            h1, h2 = word_hashes(piece, s, e)
            last = piece[e - 1].astype(np.uint32) * np.uint32(257) + np.where(e - s > 1, piece[np.maximum(e - 2, 0)], 0)
            parts.append((at[:-1] + total, h1, (h2 >> U64(32)).astype(np.uint32), (last * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(self.classes)))
            total += len(s)
        at, h1, h2, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new = distinct_pairs(h1, h2)
        return np.append(at, total), order, new, h1, h2, cls.astype(np.uint16)

    def count(self, g: int, docs: pa.Table):
        """One record a distinct word: its count in the group's training documents, 0 where only others have it."""
        at, order, new, h1, h2, cls = self.scan(docs)
        learn = np.repeat(~self.held_out(docs["doc_id"].to_pylist()), np.diff(at))[order]
        first = np.flatnonzero(new)
        out = np.empty(len(first), RECORD)
        head = order[first]
        out["h1"], out["h2"], out["cls"] = h1[head], h2[head], cls[head]
        out["n"] = np.add.reduceat(learn, first, dtype=np.int64) if len(first) else 0
        return X.packed(g, 0, out, out["h1"], self.buckets)

    def sum(self, gs: list[int], _: list[int], blobs: list[bytes], most: int):
        """Each group hears its words' counts over all groups, in the order it sent them; group -1 gets sums (kind 1) and
        the bucket's most frequent words (kind 2)."""
        sent = [np.frombuffer(b, RECORD) for b in blobs]
        every = np.concatenate(sent)
        order, new = distinct_pairs(every["h1"], every["h2"].astype(U64))
        first = np.flatnonzero(new)
        totals = np.add.reduceat(every["n"][order], first, dtype=np.int64)
        back = np.empty(len(every), np.int64)
        back[order] = np.repeat(totals, np.diff(np.append(first, len(every))))
        edges = np.cumsum([0, *map(len, sent)])
        out = [(g, 0, back[edges[i] : edges[i + 1]].astype("<i8").tobytes()) for i, g in enumerate(gs)]
        head = every[order[first]]
        seen = np.flatnonzero(totals > 0)
        shares = np.bincount(head["cls"][seen], totals[seen] + 1, minlength=self.classes)
        counts = np.bincount(head["cls"][seen], totals[seen], minlength=self.classes)
        out.append((-1, 1, np.concatenate([[totals.sum(), len(seen)], shares, counts]).astype("<i8").tobytes()))
        top = seen[np.lexsort((head["h2"][seen], head["h1"][seen], -totals[seen]))[:most]]
        best = np.empty(len(top), TOTAL)
        for c in ("h1", "h2", "cls"):
            best[c] = head[c][top]
        best["n"] = totals[top]
        out.append((-1, 2, best.tobytes()))
        return out

    def encode(self, docs: pa.Table, mail: X.Inbox, corpus: Corpus) -> pa.Table:
        at, order, new, h1, h2, cls = self.scan(docs)
        first = np.flatnonzero(new)
        head = order[first]
        count = mail.get(0, "<i8")
        symbol = corpus.symbols(h1[head], h2[head], cls[head])
        base = np.log10((count + 1) / (corpus.tokens + corpus.distinct + 1.0))
        rare = np.where(symbol <= self.classes, np.log10((count + 1) / corpus.share[cls[head]]), 0.0)
        word = np.empty(len(order), np.int64)
        word[order] = np.cumsum(new) - 1
        ends = at[1:]
        end_count = int(corpus.counts[0])
        total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[word])])[at])
        exact = lambda values: np.array([math.fsum(values[word[a:b]].tolist()) for a, b in zip(at[:-1].tolist(), ends.tolist(), strict=True)])
        symbols = symbol[word].astype("<u2")
        blobs = [symbols[a:b].tobytes() + b"\0\0" for a, b in zip(at[:-1].tolist(), ends.tolist(), strict=True)]
        ids = docs["doc_id"].to_pylist()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(self.held_out(ids), pa.bool_()), "n_tokens": pa.array(np.diff(at) + 1, pa.int64()),
            "n_known": pa.array(total(count > 0) + (end_count > 0), pa.int64()),
            "base_score": pa.array(exact(base) + math.log10((end_count + 1) / (corpus.tokens + corpus.distinct + 1.0)), pa.float64()),
            "rare_score": pa.array(exact(rare), pa.float64()), "symbols": pa.array(blobs, pa.binary()),
        })


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare_score double, symbols binary"
ENCODED_ARROW = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("rare_score", pa.float64()), ("symbols", pa.binary())]


def _unpack_sums(batches):
    for batch in batches:
        rows = [np.frombuffer(b, "<i8") for b in batch["data"].to_pylist()]
        if rows:
            total = np.sum(rows, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.int64())], ["i", "v"])


def _unpack_words(batches):
    for batch in batches:
        x = np.frombuffer(b"".join(batch["data"].to_pylist()), TOTAL)
        yield pa.RecordBatch.from_arrays([pa.array(x[c].astype(U64).view(np.int64)) for c in TOTAL.names], TOTAL.names)


def corpus_of(answers: DataFrame, ends: int, symbols: int, classes: int) -> Corpus:
    """Sums and the most frequent words: a bounded number of rows reaches the driver."""
    sums = answers.where("g = -1 AND kind = 1").select("data").mapInArrow(_unpack_sums, "i long, v long").groupBy("i").agg(F.sum("v")).collect()
    values = np.zeros(2 + 2 * classes, np.int64)
    for i, v in sums:
        values[i] = v
    n, distinct, shares, counts = int(values[0]), int(values[1]), values[2 : 2 + classes].astype(float), values[2 + classes :]
    most = symbols - 1 - classes
    top = answers.where("g = -1 AND kind = 2").select("data").mapInArrow(_unpack_words, "h1 long, h2 long, n long, cls long")
    top = top.orderBy(F.desc("n"), "h1", "h2").limit(most).collect()
    h1, h2 = np.array([r[0] for r in top], np.int64).view(U64), np.array([r[1] for r in top], np.uint32)
    symbol_counts = np.concatenate([[ends], counts, [r[2] for r in top]]).astype(np.int64)
    for _, _, c, cls in top:
        shares[cls] -= c + 1
        symbol_counts[1 + cls] -= c
    order = np.argsort(h1)
    return Corpus(n + ends, distinct + (ends > 0), h1[order], h2[order], 1 + classes + order, symbol_counts, shares + 1)


def averaged(returned: DataFrame, size: int, pieces: int) -> tuple[np.ndarray, float]:
    """Mean of the tasks' parameters by their tokens: first within lanes of tasks, then over lanes."""

    def add(table):
        total = np.sum([np.frombuffer(b, "<f8") for b in table["data"].to_pylist()], 0)
        return pa.table({"lane": pa.array([0], pa.int64()), "piece": table["piece"].slice(0, 1), "weight": pa.array([sum(table["weight"].to_pylist())], pa.float64()), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "lane long, piece long, weight double, data binary"
    sums = returned.groupBy("lane", "piece").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema).collect()
    flat = np.zeros(size)
    weight = 0.0
    for r in sums:
        values = np.frombuffer(r["data"], "<f8")
        at = r["piece"] * -(-size // pieces)
        flat[at : at + len(values)] = values / max(r["weight"], 1.0)
        weight = r["weight"]
    return flat, weight


def trained(encoded: DataFrame, corpus: Corpus, dim: int = DIM, rounds: int = ROUNDS, rate: float = RATE, noise: int = NOISE, batch: int = BATCH, pieces: int = 16) -> Parameters:
    """Rounds of local training over all documents that aren't held out; the rate falls with the rounds."""
    spark = encoded.sparkSession
    model = Parameters.start(corpus.unigram, dim)
    learn = encoded.where("NOT held_out").select("symbols")
    lanes = max(1, math.isqrt(learn.rdd.getNumPartitions()))
    size = model.flat().size
    width = -(-size // pieces)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((model, corpus.unigram))
        step = rate / (1 + k)

        def task(batches, sent=sent, step=step, k=k):
            from pyspark import TaskContext

            start, unigram = sent.value
            place = TaskContext.get().partitionId()
            t = Trainer(start, unigram, step, noise, 1000 * k + place % 997)
            kept, waiting = [], 0

            def run():
                before, previous, word = (np.concatenate(x) for x in zip(*kept, strict=True))
                contexts = np.column_stack([previous, before])
                for i in range(0, len(word), batch):
                    t.step(contexts[i : i + batch], word[i : i + batch])

            for b in batches:
                for a in range(0, b.num_rows, 256):
                    symbols, at = joined(b["symbols"].slice(a, 256))
                    kept.append((*contexts_of(symbols, at), symbols))
                    waiting += len(symbols)
                    if waiting >= 32 * batch:
                        run()
                        kept, waiting = [], 0
            if kept:
                run()
            if t.tokens:
                flat = t.m.flat().astype("<f8") * t.tokens
                cut = [flat[i * width : (i + 1) * width].tobytes() for i in range(pieces)]
                yield pa.RecordBatch.from_arrays([pa.array([place % lanes] * pieces, pa.int64()), pa.array(range(pieces), pa.int64()), pa.array([float(t.tokens)] * pieces), pa.array(cut, pa.binary())], ["lane", "piece", "weight", "data"])

        flat, weight = averaged(learn.mapInArrow(task, "lane long, piece long, weight double, data binary"), size, pieces)
        if not weight:
            break
        model = model.like(flat)
    return model


def score_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 7, held: int = 2, symbols: int = SYMBOLS, classes: int = CLASSES,
                 dim: int = DIM, rounds: int = ROUNDS, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, Parameters, Corpus]:
    """(one row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model; the counts).

    Held out are ids whose crc32 as text is `held` modulo `every`; a null id isn't. A null or empty text is one token,
    its end. Without training documents all counts are 0 and the model is uniform. Repeated rows are documents of
    their own; an empty table gives no rows; other columns are ignored.
    """
    groups, n = X.document_groups(df, id_col, text_col, group_bytes)
    reader = Reader(max(1, n // 4), every, held, classes)
    most = symbols - 1 - classes
    answers = materialize(X.answer(X.send(groups, reader.count), reader.buckets, lambda g, k, b: reader.sum(g, k, b, most)), "counts")
    is_held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % every == held, F.lit(False))
    corpus = corpus_of(answers, df.where(~is_held).count(), symbols, classes)
    known = df.sparkSession.sparkContext.broadcast(corpus)
    encoded = X.send_again(groups, n, answers.where("g >= 0"), lambda g, docs, mail: reader.encode(docs, mail, known.value), ENCODED, ENCODED_ARROW)
    encoded = materialize(encoded, "symbols")
    model = trained(encoded, corpus, dim, rounds)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        tables = None
        for b in batches:
            if not b.num_rows:
                continue
            tables = tables or tables_of(sent.value)
            scores = []
            for a in range(0, b.num_rows, 256):
                values, at = joined(b["symbols"].slice(a, 256))
                scores.append(np.add.reduceat(tables.log10(*contexts_of(values, at), values), at[:-1]))
            out = pa.array(np.concatenate(scores) + b["rare_score"].to_numpy(zero_copy_only=False), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([corpus_tokens] * b.num_rows, pa.int64()), b["base_score"], out], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    corpus_tokens = corpus.tokens
    scored = encoded.mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored, model, corpus


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_corpus(documents_of(spark, sf_dir))[0]
