"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's vector holds, level by level, how many of its letters fall in each group of an alphabet's partition; four broad
groups come first, narrow ones after. One edit takes at most one letter out of a group and puts at most one into a group,
so near words differ at the levels of one partition by a surplus of one and a deficit of one at most.

1. The trie's top is routed by Spark: nodes of more than shard_words words are cut at the next level. A word goes to its own
   shard and, as a query, to the later shards that a depth-first search with both budgets reaches.
2. A shard lays its words out as a trie (sorted vectors; a node is a range) and searches it depth first, all queries of a
   node at once, each with what is left of its budgets. Leaves are compared by the counts of single letters, packed in 64 bits,
   then verified letter by letter.
3. Each shard gives a word its number of near words and the best of them; these are added up by word. Roots come by
   pointer doubling along forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import documents_of, materialize

#: Letters by how common they are in European texts: the fifteen first have narrow groups of their own.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
OWN_GROUP, BROAD, OTHERS = 15, 4, 4
LEVELS = BROAD + OWN_GROUP + 1 + OTHERS
SHARD_WORDS, MOST_CUTS, LEAF, FLUSH = 50_000, 20_000, 64, 300_000
MATRIX = 48
LETTERS = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(65, 91)}


def group_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Broad and narrow group of every code point below size: by place in COMMON, others by code point."""
    cp = np.arange(size)
    broad, narrow = cp % BROAD, OWN_GROUP + 1 + cp % OTHERS
    for i, c in enumerate(COMMON):
        broad[ord(c)], narrow[ord(c)] = i % BROAD, min(i, OWN_GROUP)
    return broad, narrow


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, offsets)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum([0, *map(len, words)])


def vectors(words: list[str]) -> np.ndarray:
    """Counts by level, one row a word. Counts stop at 255: a difference can only look smaller, so nothing near is missed."""
    flat, at = letters_of(words)
    broad, narrow = group_tables(max(256, int(flat.max()) + 1 if len(flat) else 0))
    row = np.repeat(np.arange(len(words)), np.diff(at))
    out = np.empty((len(words), LEVELS), np.uint8)
    for first, last, group in ((0, BROAD, broad), (BROAD, LEVELS, narrow)):
        counts = np.bincount(row * (last - first) + group[flat], minlength=len(words) * (last - first))
        out[:, first:last] = np.minimum(counts, 255).reshape(len(words), -1)
    return out


def signatures(words: list[str]) -> np.ndarray:
    """Two bits a letter (it occurs; it occurs again), others in six classes by code point: one edit changes two bits at most."""
    flat, at = letters_of(words)
    cls = 26 + np.arange(max(256, int(flat.max()) + 1 if len(flat) else 0)) % 6
    cls[[ord(c) for c in COMMON]] = np.arange(26)
    row = np.repeat(np.arange(len(words)), np.diff(at))
    counts = np.bincount(row * 32 + cls[flat], minlength=len(words) * 32).reshape(-1, 32)
    bits = np.stack([counts > 0, counts > 1], 2).reshape(-1, 64)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def spend(query: np.ndarray, value: int, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which queries may go to a child with that count, surplus left, deficit left)."""
    over = query.astype(np.int16) - value
    live = (over == 0) | ((over == 1) & surplus) | ((over == -1) & deficit)
    return live, (surplus & (over != 1))[live], (deficit & (over != -1))[live]


def route(vec: np.ndarray, children: dict[bytes, list[tuple[int, int]]]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(shard, words that reach it): children of each cut node as (count at its level, salts of a shard without further levels, else 0)."""
    every = np.arange(len(vec))
    free = np.ones(len(vec), bool)
    stack = [(b"", every, free, free)]
    while stack:
        node, q, s, d = stack.pop()
        if node not in children:
            yield node, q
            continue
        level = len(node)
        if level == BROAD:
            s = d = np.ones(len(q), bool)
        for value, salts in children[node]:
            live, left_s, left_d = spend(vec[q, level], value, s, d)
            if live.any():
                child = node + bytes([value])
                if salts:
                    yield from ((child + b"/" + str(i).encode(), q[live]) for i in range(salts))
                else:
                    stack.append((child, q[live], left_s, left_d))


def one_edit(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether padded words a and b differ by exactly one inserted, deleted or replaced code point."""
    out = np.zeros(len(a), bool)
    same = np.flatnonzero(na == nb)
    out[same] = (a[same] != b[same]).sum(1) == 1
    for x, y, rows in ((a, b, np.flatnonzero(na == nb + 1)), (b, a, np.flatnonzero(nb == na + 1))):
        long, short = x[rows], y[rows]
        at = (long != short).argmax(1)
        out[rows] = ~((long[:, 1:] != short[:, :-1]) & (np.arange(long.shape[1] - 1) >= at[:, None])).any(1)
    return out


def one_edit_long(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


class Shard:
    """Words of one shard, its own first, and the queries that came from earlier shards."""

    def __init__(self, words: list[str], n: list[int], own: list[bool], leaf: int = LEAF) -> None:
        vec = vectors(words)
        mine = np.array(own, bool)
        order = np.lexsort((*vec.T[::-1], ~mine))  # own words first, in the order of the trie
        self.words, self.vec, self.n = [words[i] for i in order], vec[order], np.array(n, np.int64)[order]
        self.own, self.leaf = int(mine.sum()), leaf
        flat, at = letters_of(self.words)
        self.size = np.diff(at)
        self.sig = signatures(self.words)
        short = self.size <= MATRIX
        self.matrix = np.zeros((len(self.words), int(self.size[short].max(initial=0)) + 1), np.uint8 if flat.max(initial=0) < 256 else np.uint32)
        row = np.repeat(np.arange(len(self.words)), self.size)
        col = np.arange(len(flat)) - at[row]
        fits = short[row]
        self.matrix[row[fits], col[fits]] = flat[fits]
        self.short = short
        by_word = sorted(range(len(self.words)), key=self.words.__getitem__)
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[by_word] = np.arange(len(self.words))
        self.near = np.zeros(len(self.words), np.int64)
        self.best = np.full(len(self.words), -1, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def verify(self, q: np.ndarray, w: np.ndarray) -> None:
        """Candidate pairs, whose letter counts have passed."""
        ok = np.zeros(len(q), bool)
        plain = np.flatnonzero(self.short[q] & self.short[w])
        ok[plain] = one_edit(self.matrix[q[plain]], self.matrix[w[plain]], self.size[q[plain]], self.size[w[plain]])
        for i in np.flatnonzero(~(self.short[q] & self.short[w])).tolist():
            ok[i] = one_edit_long(self.words[q[i]], self.words[w[i]])
        q, w = q[ok], w[ok]
        if len(q):
            self.found.append((np.concatenate([q, w]), np.concatenate([w, q])))
            self.waiting += len(q)
            if self.waiting > 2_000_000:
                self.fold()

    def fold(self) -> None:
        if not self.found:
            return
        q, w = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.waiting = [], 0
        np.add.at(self.near, q, 1)
        held = np.flatnonzero(self.best >= 0)
        q, w = np.concatenate([q, held]), np.concatenate([w, self.best[held]])
        order = np.lexsort((self.rank[w], -self.n[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        self.best[q[first]] = w[first]

    def compare(self, lo: int, hi: int, q: np.ndarray) -> None:
        step = max(1, 1_000_000 // (hi - lo))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            pair = np.flatnonzero(np.bitwise_count(self.sig[part][:, None] ^ self.sig[lo:hi]) <= 2)
            a, b = np.divmod(pair, hi - lo)
            a, b = part[a], lo + b
            ok = (np.abs(self.size[a] - self.size[b]) <= 1) & (a > b)
            if ok.any():
                self.verify(a[ok], b[ok])

    def search(self) -> None:
        free = np.ones(len(self.words), bool)
        stack = [(0, 0, self.own, np.arange(len(self.words)), free, free)] if self.own else []
        while stack:
            level, lo, hi, q, s, d = stack.pop()
            if q[0] <= lo:  # a pair is found from its later word, queries from elsewhere are later than all
                later = q > lo
                q, s, d = q[later], s[later], d[later]
                if not len(q):
                    continue
            if hi - lo <= self.leaf or level == LEVELS:
                self.compare(lo, hi, q)
                continue
            if level == BROAD:
                s = d = np.ones(len(q), bool)
            column, query = self.vec[lo:hi, level], self.vec[q, level]
            edges = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1], [True]]))
            if len(edges) == 2 and query.min() == query.max() == column[0]:
                stack.append((level + 1, lo, hi, q, s, d))
                continue
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                live, left_s, left_d = spend(query, int(column[a]), s, d)
                if live.any():
                    stack.append((level + 1, lo + a, lo + b, q[live], left_s, left_d))
        self.fold()

    def results(self) -> pa.Table:
        self.search()
        some = np.flatnonzero(self.near)
        best = self.best[some]
        return pa.table({
            "word": pa.array([self.words[i] for i in some.tolist()], pa.string()), "n_near": pa.array(self.near[some], pa.int64()),
            "best_n": pa.array(self.n[best], pa.int64()), "best": pa.array([self.words[i] for i in best.tolist()], pa.string()),
        })


def occurring_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, delete_every: int = 31) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, one code point deleted from some by the crc32 of `<doc_id>:<run>`
    (a null id is written as nothing), of at least `least` code points then. Null texts have none. Counted before they are shuffled."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def task(batches):
        count: Counter[str] = Counter()

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["word", "n"])
            count.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                seed = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                for w, m in Counter(runs.findall((text.as_py() or "").translate(LOWER))).items():
                    h = zlib.crc32(w.encode(), seed)
                    if h % delete_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    count[w] += m
                if len(count) > FLUSH:
                    yield full()
        yield full()

    counted = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _with_vectors(batches):
    for batch in batches:
        vec = vectors(batch["word"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array([v.tobytes() for v in vec], pa.binary())], ["word", "n", "vec"])


def routing_table(words: DataFrame, shard_words: int) -> dict[bytes, list[tuple[int, int]]]:
    """Children of the nodes that hold more than shard_words words: fewer than all words / shard_words nodes a level."""
    by_vector = materialize(words.groupBy("vec").agg(F.count("*").alias("n")), "vectors")
    children: dict[bytes, list[tuple[int, int]]] = {}
    cut = {b""} if (by_vector.agg(F.sum("n")).first()[0] or 0) > shard_words else set()
    for level in range(LEVELS):
        if not cut:
            break
        spark = words.sparkSession
        parents = spark.createDataFrame([(bytearray(p),) for p in cut], "up binary")
        found = by_vector.groupBy(F.substring("vec", 1, level + 1).alias("node")).agg(F.sum("n").alias("n"))
        found = found.join(F.broadcast(parents), F.substring("node", 1, level) == F.col("up")).collect()
        cut = set()
        for node, n, up in found:
            big = n > shard_words
            salts = -(-n // shard_words) if big and level + 1 == LEVELS else 0
            children.setdefault(bytes(up), []).append((node[level], salts))
            if big and not salts:
                cut.add(bytes(node))
    return children


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, leaf: int = LEAF) -> DataFrame:
    """Distinct (word, n) -> (word, n_near, best_n, best) for words with a near word: how many, and the one of largest n
    (ties: smallest in code-point order)."""
    words = materialize(words.mapInArrow(_with_vectors, "word string, n long, vec binary"), "words")
    children = routing_table(words, max(shard_words, words.count() // MOST_CUTS))
    sent = words.sparkSession.sparkContext.broadcast(children)

    def deal(batches):
        table = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = np.stack([np.frombuffer(v, np.uint8) for v in batch["vec"].to_pylist()])
            home = home_shards(vec, batch["word"].to_pylist(), table)
            for shard, q in route(vec, table):
                at = np.array([home[i] <= shard for i in q.tolist()], bool)
                q = q[at]
                rows = batch.select(["word", "n"]).take(pa.array(q))
                own = [home[i] == shard for i in q.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(q), pa.binary()), rows["word"], rows["n"], pa.array(own, pa.bool_())], ["shard", "word", "n", "own"])

    def task(table):
        return Shard(table["word"].to_pylist(), table["n"].to_pylist(), table["own"].to_pylist(), leaf).results()

    dealt = words.mapInArrow(deal, "shard binary, word string, n long, own boolean")
    found = dealt.groupBy("shard").applyInArrow(task, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def home_shards(vec: np.ndarray, words: list[str], children: dict[bytes, list[tuple[int, int]]]) -> list[bytes]:
    out = []
    for v, w in zip(vec, words, strict=True):
        whole, node = v.tobytes(), b""
        while node in children:
            value = whole[len(node)]
            salts = next(s for x, s in children[node] if x == value)
            node += bytes([value])
            if salts:
                node += b"/" + str(zlib.crc32(w.encode()) % salts).encode()
                break
        out.append(node)
    return out


def follow(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, form) without cycles -> (word, root): the last word along forms, by pointer doubling."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.where("moved").limit(1).count():
            return at.drop("moved")
        at = at.drop("moved")
    raise RuntimeError(f"roots aren't settled after {max_rounds} rounds")


def spelling_groups(words: DataFrame, times: int = 10, shard_words: int = SHARD_WORDS, leaf: int = LEAF) -> DataFrame:
    """Distinct (word, n) -> word, form, root, n, n_near, form_n.

    form is the near word of largest n if that is at least `times` n, else null; root the last word along forms (a form's n
    grows tenfold each step, so there are few steps and no cycles), the word itself without form. An empty table gives no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    known = words.join(near_words(words, shard_words, leaf), "word", "left")
    enough = F.col("best_n") >= times * F.col("n")
    known = materialize(known.select("word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best_n")).alias("form_n")), "near")
    roots = follow(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(occurring_words(documents_of(spark, sf_dir)).where("n >= 2"))


OP13_SQL = """
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
run AS (
  SELECT doc_id, lower_az AS w, count(*) AS m FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
  WHERE length(lower_az) >= 7 GROUP BY ALL),
coded AS (SELECT w, m, hex(encode(doc_id || ':' || w)) AS x FROM run),
hashed AS (
  SELECT w, m, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc),
word AS (
  SELECT word, sum(m)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, m FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN word b ON a.v = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN word b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
form AS (
  SELECT word.word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * word.n THEN other END AS form, CASE WHEN other_n >= 10 * word.n THEN other_n END AS form_n
  FROM word LEFT JOIN best USING (word)),
chain AS (
  WITH RECURSIVE c AS (SELECT word, word AS last, 0 AS k FROM form UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN form f ON f.word = c.last WHERE f.form IS NOT NULL)
  SELECT word, arg_max(last, k) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM form JOIN chain USING (word)
"""
