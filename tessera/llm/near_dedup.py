"""MinHash near-dedup with odd sketches.

A document's set is its distinct 5-word shingles (A-Z lower-cased). Documents with J >= 0.75 are linked, components
of links are groups, the smallest doc_id of a group stays.

1. Sketch: ``bands * rows`` MinHash values; band keys; an odd sketch, which folds the samples (i, value) into a bitmap
   by parity. The XOR of two odd sketches is the odd sketch of the symmetric difference of the samples, so its
   population count estimates how many samples differ, most precisely where few do.
2. Documents with equal sets (by 128-bit hashes of their shingles) form a class, which goes on as one node.
3. Stars: each band bucket proposes its members as links of one of them, its hub, so a bucket of n gives n - 1 pairs.
   Pairs whose odd sketches are too far apart go; the rest meets in slices of a hub's star and is verified on full sets.
4. The rest, exactly: buckets that still hold several components are cut into blocks, and tiles of two blocks compare
   odd sketches inside a task. A tile doesn't give pairs: it says which of its nodes have a candidate in which part of
   it, and those nodes meet, part by part, with their full sets, which gives a spanning forest of the links. A pair
   that shares several buckets is compared in the fullest of them only. So rows grow with members, not with pairs.
5. Components over all links.

With 32 bands of 4 rows a pair at J = 0.75 misses every band with probability (1 - 0.75^4)^32 = 5e-6; the sketch
threshold lies five standard deviations below the expected agreement at J = 0.75.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import release, spread
from .rolling import LOWER, U64, chunks, distinct_pairs, mix, run_hashes, utf8, word_hashes, words
from .scratch import documents_of, materialize
from .skew import skew_join

WORDS, SKETCH_LONGS = 5, 8
#: Words of a star's slice, of a part of a tile, and of the texts that a task holds at once.
SLICE_WORDS, TASK_WORDS = 200_000, 500_000
#: Members of a block of a bucket, and of a part of a tile.
BLOCK, PART = 8_192, 1_024

Shingles = tuple[np.ndarray, np.ndarray]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[Shingles]:
    """For each document its distinct shingles as two arrays of 64-bit hashes, ascending by the first; with fewer words, the whole sequence is one."""
    empty = np.empty(0, U64)
    for first, last in chunks(offsets):
        begin = int(offsets[first])
        piece = LOWER[data[begin : int(offsets[last])]]
        s, e, at = words(piece, offsets[first : last + 1] - begin)
        h1, h2 = word_hashes(piece, s, e)
        runs1, runs2 = run_hashes(h1, WORDS), run_hashes(h2, WORDS, 1)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WORDS:
                x, y = runs1[a : b - WORDS + 1], runs2[a : b - WORDS + 1]
                order, new = distinct_pairs(x, y)
                keep = order[new]
                yield x[keep], y[keep]
            elif b > a:
                whole = xxhash.xxh3_128_intdigest(h1[a:b].tobytes() + h2[a:b].tobytes())
                yield np.array([whole >> 64], U64), np.array([whole & 0xFFFFFFFFFFFFFFFF], U64)
            else:
                yield empty, empty


class Sketcher:
    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(31)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.multiply = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.flip = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.weigh = rng.integers(0, 2**64, (bands, rows), dtype=U64) | U64(1)
        self.salt = rng.integers(0, 2**64, bands, dtype=U64)
        self.own = rng.integers(0, 2**64, n, dtype=U64)

    def minhash(self, shingles: np.ndarray) -> np.ndarray:
        """Samples of 32 bits: the least of (x ^ flip) * multiply over the shingles' high halves."""
        high = (shingles >> U64(32)).astype(np.uint32)
        least = np.full(len(self.flip), 2**32 - 1, np.uint32)
        for i in range(0, len(high), 1024):
            np.minimum(least, ((high[i : i + 1024, None] ^ self.flip) * self.multiply).min(0), out=least)
        return least.astype(U64)

    def sketch(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, odd sketch)."""
        least = self.minhash(shingles)
        keys = mix((least.reshape(self.bands, self.rows) * self.weigh).sum(1, dtype=U64) ^ self.salt)
        bits = (mix(least ^ self.own) % U64(64 * SKETCH_LONGS)).astype(np.int64)
        odd = np.bincount(bits, minlength=64 * SKETCH_LONGS) & 1
        return keys, np.packbits(odd.astype(np.uint8)).view("<i8")


def sketch_limit(samples: int, similarity: float) -> int:
    """Largest XOR population count kept: the expectation at five standard deviations below similarity, and three more for the folding."""
    j = max(0.0, similarity - 5 * math.sqrt(similarity * (1 - similarity) / samples))
    n, differ = 64 * SKETCH_LONGS, 2 * samples * (1 - j)
    mean = n * (1 - (1 - 2 / n) ** differ) / 2
    return math.ceil(mean + 3 * math.sqrt(mean / 2))


SKETCHES = "doc_id long, tkey long, n_shingles long, node binary, bands array<long>, odd array<long>"


def sketches(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """texts (doc_id, text, tkey) -> SKETCHES; node is the digest of the shingle set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            out: tuple[list, ...] = [], [], [], []
            for x, y in shingle_sets(data, offsets):
                keys, odd = sketcher.sketch(x) if len(x) else (None, None)
                for column, value in zip(out, (len(x), xxhash.xxh3_128_digest(x.tobytes() + y.tobytes()), None if keys is None else keys.view(np.int64), odd), strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
            del data, offsets
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tkey"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "tkey", "n_shingles", "node", "bands", "odd"])
            release()

    return texts.select("doc_id", "tkey", "text").mapInArrow(task, SKETCHES)


def apart(x: str, y: str) -> Column:
    """Population count of the XOR of two odd sketches."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, SKETCH_LONGS)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def enough(both: np.ndarray, x, y, percent: int) -> np.ndarray:
    return (both > 0) & (100 * both >= percent * (x + y - both))


def with_hub(sets: list[Shingles], hub: Shingles, percent: int) -> np.ndarray:
    """Which sets are similar to the hub's."""
    size = np.array([len(x) for x, _ in sets])
    first, second = np.concatenate([x for x, _ in sets]), np.concatenate([y for _, y in sets])
    at = np.searchsorted(hub[0], first)
    at[at == len(hub[0])] = 0
    hit = np.concatenate([[0], np.cumsum((hub[0][at] == first) & (hub[1][at] == second))])
    end = np.cumsum(size)
    return enough(hit[end] - hit[end - size], size, len(hub[0]), percent)


def forest(sets: list[Shingles], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels, as many as join the labels that any link joins: intersections by bitmaps over the shingles that several sets hold."""
    size = np.array([len(x) for x, _ in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order, new = distinct_pairs(np.concatenate([x for x, _ in sets]), np.concatenate([y for _, y in sets]))
    rank = np.cumsum(new) - 1
    often = np.bincount(rank) > 1
    keep = often[rank]
    column, row = (np.cumsum(often) - 1)[rank[keep]], owner[order[keep]]
    both = np.zeros((len(sets), len(sets)), np.int64)
    step = 1 << 13
    by_column = np.argsort(column, kind="stable")
    column, row = column[by_column], row[by_column]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (low, low + step))
        bits = np.zeros((len(sets), step), np.uint8)
        bits[row[a:b], column[a:b] - low] = 1
        packed = np.packbits(bits, axis=1).view(U64)
        for i in range(len(sets)):
            both[i, i + 1 :] += np.bitwise_count(packed[i] & packed[i + 1 :]).sum(1, dtype=np.int64)
    x, y = np.nonzero(enough(both, size[:, None], size, percent) & (labels[:, None] != labels))
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while v in up:
            v = up[v]
        return v

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def edges_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    differ = np.zeros(n - 1, bool)
    for c in columns:
        differ |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(differ) + 1, [n]])


def verified(met: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """met (meeting, node, label, hub) -> links (a, b) of nodes whose full sets are similar.

    A meeting with a hub links its other nodes to the hub; one without gives a spanning forest of the links between labels.
    """
    placed = materialize(met.join(nodes.select("node", "doc_id", "tkey", "n_shingles"), "node"), "meetings")
    parts = max(1, math.ceil((placed.agg(F.sum("n_shingles")).first()[0] or 0) / TASK_WORDS))

    def task(key, table):
        table = table.take(pc.sort_indices(table, sort_keys=[("meeting", "ascending"), ("node", "ascending"), ("hub", "descending")]))
        meeting, hub = table["meeting"].to_numpy(), table["hub"].to_numpy()
        node = table["node"].combine_chunks().dictionary_encode()
        node = (node.chunk(0) if isinstance(node, pa.ChunkedArray) else node).indices.to_numpy()
        label = pc.dictionary_encode(table["label"].combine_chunks())
        label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
        sets = list(shingle_sets(*utf8(table["text"])))
        a, b = [], []
        edges = edges_of(meeting)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            who = np.arange(s, e)
            who = who[np.concatenate([[True], node[who][1:] != node[who][:-1]])]  # rows that repeat
            hubs = who[hub[who]]
            if len(hubs):
                for h in hubs.tolist():
                    rest = who[who != h]
                    if len(rest):
                        good = rest[with_hub([sets[i] for i in rest.tolist()], sets[h], percent)]
                        a.extend(good.tolist())
                        b.extend([h] * len(good))
            elif len(who) > 1:
                for i, j in forest([sets[i] for i in who.tolist()], label[who], percent):
                    a.append(int(who[i]))
                    b.append(int(who[j]))
        out = pa.table({"a": table["node"].take(pa.array(a, pa.int64())), "b": table["node"].take(pa.array(b, pa.int64()))})
        del table, sets
        release()
        return out

    dealt = placed.withColumn("part", F.pmod(F.xxhash64("meeting"), F.lit(parts))).join(texts, ["doc_id", "tkey"])
    dealt = spread(dealt.select("part", "meeting", "node", "label", "hub", "text"), "part", parts)
    return dealt.groupBy("part").applyInArrow(task, "a binary, b binary")


def starred(reps: DataFrame, texts: DataFrame, total: int, limit: int, percent: int) -> DataFrame:
    """Links of each bucket's members to the bucket's hub, its smallest node."""
    keyed = reps.select("node", F.explode("bands").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "buckets")
    pairs = skew_join(keyed, buckets, "key", "n", total).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    pairs = materialize(pairs, "pairs")
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n")).join(reps.select(F.col("node").alias("b"), F.col("odd").alias("odd_b")), "b")
    members = pairs.join(reps.select(F.col("node").alias("a"), F.col("odd").alias("odd_a"), F.col("n_shingles").alias("size")), "a")
    close = skew_join(members, materialize(hubs, "hubs"), "b", "n", total).where(apart("odd_a", "odd_b") <= limit)
    close = materialize(close.select("a", "b", "size"), "close")
    slices = close.groupBy("b").agg(F.count("*").alias("n"), (F.floor(F.sum("size") / SLICE_WORDS) + 1).alias("slices"))
    sliced = skew_join(close, materialize(slices, "slices"), "b", "n", total)
    sliced = sliced.withColumn("meeting", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("slices"))))
    met = sliced.select("meeting", F.col("a").alias("node"), F.lit(False).alias("hub"))
    met = met.unionByName(sliced.select("meeting", F.col("b").alias("node"), F.lit(True).alias("hub")).distinct())
    return materialize(verified(met.withColumn("label", F.col("node")), reps, texts, percent), "links")


TILE = [("meeting", pa.int64()), ("node", pa.binary()), ("label", pa.binary())]


def meetings_of(limit: int, block: int = BLOCK, part: int = PART):
    """The task that compares tiles: rows (tile, key, band, node, label, low, n_shingles, bands, sizes, odd) -> TILE.

    low: the row belongs to the tile's first block (all rows of a tile of one block do, and are compared among themselves).
    """

    def task(key, table):
        table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending"), ("tile", "ascending"), ("low", "descending"), ("node", "ascending")]))
        n = table.num_rows

        def matrix(name, kind):
            column = table[name].combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)

        tile, bucket, low, band, size = (table[c].to_numpy() for c in ("tile", "key", "low", "band", "n_shingles"))
        label = pc.dictionary_encode(table["label"].combine_chunks())
        label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
        bands, sizes, odd = matrix("bands", np.int64), matrix("sizes", np.int64), matrix("odd", np.int64).view(U64)
        meeting, rows = [], []
        edges = edges_of(bucket, tile)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            split = s + int(low[s:e].sum())
            one = split == e  # a block with itself
            if not one and split == s:
                continue
            # parts of the tile's members, by number and words
            fill = np.cumsum(size[s:e])
            where = np.maximum(np.arange(e - s) // part, fill // SLICE_WORDS)
            where = np.unique(where, return_inverse=True)[1]
            need = np.zeros((e - s, int(where[-1]) + 1), bool)
            width = max(1, (1 << 20) // max(e - split, e - s if one else 1))
            y = np.arange(s, e) if one else np.arange(split, e)
            for at in range(s, split, width):
                x = np.arange(at, min(at + width, split))
                differ = np.zeros((len(x), len(y)), np.uint16)
                for i in range(odd.shape[1]):
                    differ += np.bitwise_count(odd[x, i][:, None] ^ odd[y, i])
                good = (differ <= limit) & (label[x][:, None] != label[y])
                if one:
                    good &= y > x[:, None]
                i, j = np.nonzero(good)
                for c in range(0, len(i), 1 << 16):
                    p, q = x[i[c : c + (1 << 16)]], y[j[c : c + (1 << 16)]]
                    # a pair is compared in the fullest bucket that it shares
                    best = np.where(bands[p] == bands[q], sizes[p], -1).argmax(1) == band[p]
                    p, q = p[best] - s, q[best] - s
                    need[p, where[q]] = True
                    need[q, where[p]] = True
            for p in range(need.shape[1]):
                for q in range(p, need.shape[1]):
                    who = np.flatnonzero((where == p) & need[:, q] | (where == q) & need[:, p])
                    if len(who):
                        name = xxhash.xxh3_64_intdigest(np.array([bucket[s], tile[s], p, q], np.int64).tobytes())
                        meeting.append(np.full(len(who), name, U64).view(np.int64))
                        rows.append(who + s)
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        out = pa.table({"meeting": pa.array(np.concatenate(meeting) if meeting else np.empty(0, np.int64)), "node": table["node"].take(pa.array(rows)), "label": table["label"].take(pa.array(rows))})
        release()
        return out

    return task


def rest_of_buckets(reps: DataFrame, links: DataFrame, texts: DataFrame, total: int, limit: int, percent: int, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Links across the components in each bucket that holds several."""
    label = components(links).withColumnRenamed("component", "label")
    keyed = reps.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.posexplode("bands").alias("band", "key"))
    still_open = keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    still = materialize(skew_join(keyed, materialize(still_open, "buckets"), "key", "n", total), "open")
    # a node's open buckets, at most one a band, meet its sketch once and are then told apart again
    nodes = still.groupBy("node").agg(F.first("label").alias("label"), F.collect_list(F.struct("band", "key", "n")).alias("of"))
    nodes = nodes.join(reps.select("node", "n_shingles", "bands", "odd"), "node")
    size_of = F.map_from_arrays(F.transform("of", lambda b: b["band"]), F.transform("of", lambda b: b["n"]))
    sizes = F.transform(F.sequence(F.lit(0), F.size("bands") - 1), lambda b: F.coalesce(size_of[b], F.lit(0).cast("long")))

    def tiles_of(bucket: Column) -> Column:
        blocks = F.ceil(bucket["n"] / block)
        own = F.pmod(F.xxhash64("node"), blocks)
        return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.struct(F.xxhash64(bucket["key"], F.least(own, other), F.greatest(own, other)).alias("tile"), bucket["key"].alias("key"), bucket["band"].alias("band"), (own <= other).alias("low")))

    rows = nodes.withColumn("sizes", sizes).withColumn("at", F.explode(F.flatten(F.transform("of", tiles_of))))
    rows = rows.select("at.tile", "at.key", "at.band", "node", "label", "at.low", "n_shingles", "bands", "odd", "sizes")
    parts = max(1, math.ceil(still.count() / BLOCK))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(parts)))
    met = spread(rows, "part", parts).groupBy("part").applyInArrow(meetings_of(limit, block, part), "meeting long, node binary, label binary")
    return materialize(verified(met.withColumn("hub", F.lit(False)), reps, texts, percent), "links")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents without words or text have an empty set and are linked with nothing. doc_id is the documents' key: rows
    that share one count as one document with several texts, so they share a component; null ids stay alone. An empty
    table gives no rows; other columns are ignored.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    sketched = materialize(sketches(texts, bands, rows), "sketches")
    whole = sketched.where("n_shingles > 0 and doc_id is not null")
    least = F.min_by(F.struct("doc_id", "tkey", "n_shingles", "bands", "odd"), F.struct("doc_id", "tkey"))
    reps = materialize(whole.groupBy("node").agg(least.alias("r"), F.count("*").alias("n")).select("node", "n", "r.*"), "classes")
    total = sketched.count()
    limit = sketch_limit(bands * rows, percent / 100)
    star_links = starred(reps, texts, total, limit, percent)
    rest_links = rest_of_buckets(reps, star_links, texts, total, limit, percent)

    # texts of one id are one document
    several = whole.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b <> hi").select("doc_id", "b")
    same = whole.select("doc_id", F.col("node").alias("a")).join(several, "doc_id").where("a <> b").select("a", "b")
    reached = components(same.unionByName(star_links).unionByName(rest_links))
    reached = reached.unionByName(reached.select(F.col("component").alias("node"), "component").distinct())  # a component's own node
    joined = reps.select("node", "doc_id").join(reached, "node")
    joined = materialize(joined, "components")
    lowest = materialize(joined.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")), "lowest")
    named = skew_join(joined.select("component", "node"), lowest, "component", "members", total).select("node", "component_id")
    named = reps.select("node", "doc_id", "n").join(named, "node", "left").select("node", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = skew_join(whole.select("doc_id", "n_shingles", "node"), materialize(named, "named"), "node", "n", total).select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents_of(spark, sf_dir))


OP8_SQL = """
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM word),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * joint >= 75 * (x.n + y.n - joint)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
