"""Packing token sequences by minimum bin slack.

Documents are tokenised, ended by an id, and cut into whole windows and one remainder each. What has to be packed is
then a multiset of lengths below the window: a histogram of at most ``window`` rows, whatever the corpus holds. On it,
minimum bin slack fills window after window: the longest remainder left opens one, a bitset subset-sum over the lengths
left (bounded by their counts) finds the sum closest to the space left, and backtracking through the bitsets gives
how many of each length to take. A filling is repeated as often as the counts allow. Documents get their places from
their rank within their length: in salted groups of about GROUP rows, whose sizes are summed by a prefix scan.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.prefix import prefix_scan

from .rolling import chunks, member, utf8, word_hashes, words
from .scratch import documents_of, materialize

GROUP = 256
CACHE_WORDS = 2_000_000

#: Printable ASCII and Latin letters that NFC and lower-casing leave alone or map one to one; other words take the tokenizer's whole path.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The tokenizer's own split pattern, for such characters.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 as itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


class WordTokens:
    """ids of words, remembered by a 128-bit hash. The tokenizer drops white space, so a text's ids are those of its words in a row."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, byte_letters()
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.first, self.count = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.pieces = np.empty(0, np.uint32), {}

    def piece(self, text: str) -> list[int]:
        found = self.pieces.get(text)
        if found is None:
            found = self.pieces[text] = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in text.encode()]))]
        return found

    def word(self, word: str) -> list[int]:
        if PLAIN.fullmatch(word) and "<|" not in word:
            parts = PIECES.findall(word.lower())
            return self.piece(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.piece(p)]
        return self.whole.encode(word, add_special_tokens=False).ids

    def learn(self, keys: np.ndarray, checks: np.ndarray, spans: Iterator[bytes]) -> None:
        ids = [self.word(w.decode()) for w in spans]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.pool) + np.concatenate([[0], np.cumsum(count)[:-1]]) if len(ids) else count
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)
        if len(self.pieces) > CACHE_WORDS // 4:
            self.pieces = {}

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, where each document's begin and the end)."""
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        s, e, at = words(data, offsets)
        first, second = word_hashes(data, s, e)
        keys, where, back = np.unique(first, return_index=True, return_inverse=True)
        new = ~member(keys, self.keys)
        view = memoryview(data)
        self.learn(keys[new], second[where[new]], (bytes(view[s[i] : e[i]]) for i in where[new].tolist()))
        slot = np.searchsorted(self.keys, keys)[back]
        if (self.checks[slot] != second).any():  # two words share 64 bits: without the memory
            ids = [self.word(bytes(view[b:x]).decode()) for b, x in zip(s.tolist(), e.tolist(), strict=True)]
            return np.array([i for x in ids for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)[at]
        count = self.count[slot]
        end = np.cumsum(count)
        take = np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[slot] - (end - count), count)
        return self.pool[take], np.concatenate([[0], end])[at]


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Pieces of at most window ids; each document ends with end_id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            owner, start, length, crc, total = [], [], [], [], []
            for first, last in chunks(offsets, 4 << 20):
                begin = int(offsets[first])
                ids, at = tokens.texts(data[begin : int(offsets[last])], offsets[first : last + 1] - begin)
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), first):
                    raw = np.append(ids[a:b], end_id).astype("<u4")
                    for x in range(0, len(raw), window):
                        owner.append(i)
                        start.append(x)
                        length.append(min(window, len(raw) - x))
                        crc.append(zlib.crc32(raw[x : x + window].tobytes()))
                        total.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, PIECE)


def fill(space: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """(length, how many) whose sum is closest to space from below; lengths descending. Stops as soon as space is met."""
    mask, reach = (1 << (space + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > space:
            continue
        left, part = min(counts[length], space // length), 1
        while left > 0:
            part = min(part, left)
            layers.append((length, part, reach))
            reach |= reach << (length * part) & mask
            left, part = left - part, 2 * part
        if reach >> space & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(layers):
        if not before >> total & 1:
            total -= length * part
            taken[length] = taken.get(length, 0) + part
    return sorted(taken.items(), reverse=True)


def bins(counts: dict[int, int], window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """((length, how many) of a sequence, how many such sequences), until no remainder is left."""
    counts = {k: v for k, v in counts.items() if v > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = dict(fill(window - longest, counts, sorted((k for k in counts if counts[k]), reverse=True)))
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((sorted(chosen.items(), reverse=True), times))
    return out


SLOT = np.dtype([("key", "<i8"), ("rank", "<i8"), ("sequence", "<i8"), ("each", "<i8"), ("offset", "<i8"), ("length", "<i8")])


def slots(counts: dict[int, int], window: int) -> np.ndarray:
    """Where ranks of each length go; ascending by (length, first rank)."""
    rows, given, sequence = [], dict.fromkeys(counts, 0), 0
    for chosen, times in bins(counts, window):
        offset = 0
        for length, each in chosen:
            rows.append((length << 48 | given[length], given[length], sequence, each, offset, length))
            given[length] += each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), SLOT)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone; rows that repeat are documents of their own; an empty table gives no
    rows; other columns are ignored. Ranks follow all columns of a piece, so pieces of one place are equal rows.
    """
    pieces = materialize(cut(df, id_col, text_col, tokenizer, end_id, window), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most window rows
    table = slots(counts, window)
    per_length, start = [], 0
    for length, n in sorted(counts.items()):
        per_length.append((length, math.ceil(n / GROUP), start))
        start += n
    salts = F.broadcast(df.sparkSession.createDataFrame(per_length, "l long, salts long, first long"))  # at most window rows
    salted = pieces.join(salts, F.col("length") == F.col("l")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))).drop("l", "salts", "first")
    sizes = prefix_scan(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), [F.asc("length"), F.asc("salt")], {"through": "n"})
    sizes = sizes.join(salts, F.col("length") == F.col("l")).select("l", F.col("salt").alias("s"), (F.col("through") - F.col("n") - F.col("first")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(sizes, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            slot = table[np.searchsorted(table["key"], length << 48 | rank, "right") - 1]
            nth = rank - slot["rank"]
            own = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(slot["sequence"] + nth // slot["each"]), pa.array(slot["offset"] + nth % slot["each"] * length)], names=[*own.schema.names, "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, PIECE + ", sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_slack_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents_of(spark, sf_dir), tokenizer_path())
