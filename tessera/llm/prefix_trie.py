"""Prefix trie of conversations: which openings conversations share, and what computing a shared opening once would save.

1. Turns are dictionary-encoded: a distinct (role, text) gets a dense id. Equal conversations become one sequence of ids.
2. Sequences are range-partitioned in lexicographic order, so a node's members are neighbours. A shard builds a ternary
   search tree over its sequences, inserted median first, and one iterative traversal accumulates members, leaves and
   savings upwards.
3. Only prefixes of a shard's first and last sequence can continue in a neighbouring shard. How far they do is the common
   prefix of two border sequences, so such nodes are known in the shard, counted once (by the leftmost shard) and merged by key.

One sequence (8 bytes a turn) is held in one task, and a shard's sequences; texts aren't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.prefix import global_row_number

from .scratch import documents_of, materialize
from .skew import skew_join

WORDS = r"[^\x20\x09-\x0D]+"
NO_MEMBER = hashlib.sha256(b"").hexdigest()
#: Ids of a shard, and how many neighbouring conv_ids (a power of two) make a piece of a member list.
SHARD_IDS, PIECE_BITS = 500_000, 10

NODES = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
ARROW = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])


def encoded_turns(df: DataFrame) -> DataFrame:
    """conversations -> (conv_id, pos, id, words): pos from 0 by turn (null first), then role, then text; id of the distinct (role, text).

    Null role or text is empty; rows without conv_id belong to no conversation and are left out.
    """
    rows = df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = global_row_number(rows, order, "at").select(
        "conv_id", "at", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    placed = materialize(placed, "turns")
    total = placed.count()
    starts = materialize(placed.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n")), "starts")
    distinct = placed.groupBy("digest").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    dictionary = materialize(global_row_number(distinct, [F.col("digest")], "id"), "dictionary")
    out = skew_join(placed.drop("words"), dictionary, "digest", "n", total).drop("n", "digest")
    return skew_join(out, starts, "conv_id", "n", total).select("conv_id", (F.col("at") - F.col("start")).alias("pos"), "id", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, ids, words) for every conversation c: the first h turns of conversation c - c % family (all if fewer, none if
    absent), then its own turns after its first h, where h is crc32 of c as decimal modulo most + 1. % keeps the sign of c."""
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    convs = turns.select("conv_id").distinct()
    own = turns.where(F.col("pos") >= h)
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base").where(F.col("pos") < h)
    no_turn = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("words"))
    rows = own.unionByName(lent.select("conv_id", "pos", "id", "words")).unionByName(no_turn)
    seq = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("s"))
    seq = seq.withColumn("s", F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))))
    return seq.select("conv_id", F.col("s.id").alias("ids"), F.col("s.words").alias("words"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of member lists, ordered by sequence and place -> one digest a sequence; holds one piece at a time."""
    last, state, keys, out = None, None, [], []
    for batch in batches:
        for key, text in zip(batch["seq"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if key == last:
                state.update(b"," + text.encode())
                continue
            if last is not None:
                keys.append(last)
                out.append(state.hexdigest())
            last, state = key, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["seq", "ends"])
        keys, out = [], []
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["seq", "ends"])


def member_digests(members: DataFrame) -> DataFrame:
    """(seq, conv_id), conv_id unique -> (seq, ends): SHA-256 of the ascending conv_ids, comma-joined.

    Lists are joined in pieces of neighbouring ids, at most 1,024 of them each, by all tasks; one task then reads a list's
    pieces in order and keeps only the state of the hash, which is sequential by its nature.
    """
    pieces = members.groupBy("seq", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("seq", "piece", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("text"))
    return pieces.repartition("seq").sortWithinPartitions("seq", "piece").drop("piece").mapInArrow(_digests, "seq binary, ends string")


def sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, ids, words) -> one row a distinct sequence: ids, words, n (members), low (least conv_id), ends (digest of the members)."""
    convs = materialize(convs.withColumn("seq", F.unhex(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))), "sequences")
    distinct = convs.groupBy("seq").agg(F.first("ids").alias("ids"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    return distinct.join(member_digests(convs.select("seq", "conv_id")), "seq").drop("seq")


class TernaryTree:
    """A ternary search tree: lo and hi lead to other ids at the same depth, eq to the ids that follow."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.key, self.lo, self.eq, self.hi, self.end = [], [], [], [], []
        self.root, self.sequences = -1, sequences
        spans = [(0, len(sequences))]
        while spans:
            a, b = spans.pop()
            if a < b:
                m = (a + b) // 2
                self.insert(m)
                spans += [(m + 1, b), (a, m)]

    def child(self, node: int, key: int) -> tuple[int, list[int], int]:
        """(node with that key below node, or -1; the link that leads or would lead to it)."""
        links, at = (self.eq, node) if node >= 0 else (None, -1)
        x = self.eq[node] if node >= 0 else self.root
        while x >= 0 and self.key[x] != key:
            links, at = (self.lo, x) if key < self.key[x] else (self.hi, x)
            x = links[x]
        return x, links, at

    def insert(self, m: int) -> None:
        node = -1
        for key in self.sequences[m]:
            x, links, at = self.child(node, key)
            if x < 0:
                x = len(self.key)
                for values, first in ((self.key, key), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.end, -1)):
                    values.append(first)
                if links is None:
                    self.root = x
                else:
                    links[at] = x
            node = x
        if node >= 0:
            self.end[node] = m

    def path(self, sequence: list[int], depth: int) -> list[int]:
        out, node = [], -1
        for key in sequence[:depth]:
            node = self.child(node, key)[0]
            out.append(node)
        return out

    def walk(self) -> tuple[list[int], dict[int, int]]:
        """(nodes, parents first; parent of each, -1 for the top's children)."""
        order, up, stack = [], {}, [(self.root, -1)] if self.root >= 0 else []
        while stack:
            x, parent = stack.pop()
            order.append(x)
            up[x] = parent
            stack += [(y, p) for y, p in ((self.lo[x], parent), (self.hi[x], parent), (self.eq[x], x)) if y >= 0]
        return order, up


def shard_nodes(ids: list[list[int]], words: list[list[int]], n: list[int], low: list[int], ends: list[str], left: int, right: int) -> list[tuple]:
    """Nodes of one shard; left and right: turns that its first and last sequence share with the neighbouring shards, -1 without neighbour."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, words, n, low, ends = ([x[i] for i in order] for x in (ids, words, n, low, ends))
    tree = TernaryTree(ids)
    nodes, up = tree.walk()
    top, size = len(tree.key), len(tree.key) + 1  # the textless root stands last in the lists
    members, least, depth, cost = [0] * size, [None] * size, [0] * size, [0] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    ended: list[str | None] = [None] * size
    at_root = 0 if not ids[0] else None
    terminal = {x: tree.end[x] for x in nodes if tree.end[x] >= 0}
    if at_root is not None:
        terminal[top] = at_root
    for x in nodes:
        depth[x] = (depth[up[x]] if up[x] >= 0 else 0) + 1
    for m, sequence in enumerate(ids):
        # each node's words, from the sequences' own; only the part that the sequence before doesn't share is new
        shared = 0
        if m:
            before = ids[m - 1]
            while shared < len(before) and shared < len(sequence) and before[shared] == sequence[shared]:
                shared += 1
        for d, x in enumerate(tree.path(sequence, len(sequence))):
            if d >= shared:
                cost[x] = words[m][d]
    seen_left = {top} if left >= 0 else set()
    seen_left.update(tree.path(ids[0], max(left, 0)))
    seen_right = {top} if right >= 0 else set()
    seen_right.update(tree.path(ids[-1], max(right, 0)))
    goes_on = len(ids) - 1 if right == len(ids[-1]) else -1
    for x in [top, *nodes][::-1]:
        if (m := terminal.get(x)) is not None:
            members[x] += n[m]
            least[x] = low[m] if least[x] is None else min(least[x], low[m])
            ended[x] = ends[m]
            leaves[x] += children[x] == 0 and m != goes_on
        owned = x not in seen_left
        saved[x] += (members[x] - owned) * cost[x]
        if x != top:
            p = up[x] if up[x] >= 0 else top
            members[p] += members[x]
            least[p] = least[x] if least[p] is None else min(least[p], least[x])
            children[p] += owned
            leaves[p] += leaves[x]
            saved[p] += saved[x]
    key: dict[int, bytes] = {}
    for sequence, shared in ((ids[0], left), (ids[-1], right)):
        if shared >= 0:
            chain = key[top] = b""
            for turn, x in zip(sequence, tree.path(sequence, shared), strict=False):
                chain = key[x] = hashlib.blake2b(chain + turn.to_bytes(8, "little"), digest_size=16).digest()
    out = []
    for x in [top, *nodes]:
        p = None if x == top else up[x] if up[x] >= 0 else top
        merged = p is not None and p in key
        out.append((key.get(x), key[p] if merged else None, least[x], depth[x], None if p is None or merged else least[p], members[x], children[x], leaves[x], saved[x], ended[x]))
    return out


def _shard(table: pa.Table) -> pa.Table:
    column = {c: table[c].to_pylist() for c in ("ids", "words", "n", "low", "ends", "left", "right")}
    found = shard_nodes(*(column[c] for c in ("ids", "words", "n", "low", "ends")), column["left"][0], column["right"][0])
    return pa.table([pa.array([r[i] for r in found], field.type) for i, field in enumerate(ARROW)], schema=ARROW)


def prefix_nodes(seqs: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Distinct sequences -> one row a node of their trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. No sequence gives no node, not even the root."""
    seqs = materialize(seqs, "distinct")
    total = seqs.agg(F.sum(F.size("ids"))).first()[0] or 0
    shards = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_ids))
    ranged = materialize(seqs.repartitionByRange(shards, "ids").withColumn("part", F.spark_partition_id()), "shards")
    order = Window.orderBy("part")  # one row a shard
    common = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN -1 ELSE CASE array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false) WHEN 0 THEN size({a}) ELSE array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false) - 1 END END"
    edges = ranged.groupBy("part").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    edges = edges.withColumns({"before": F.lag("last").over(order), "after": F.lead("first").over(order)})
    edges = edges.select("part", F.expr(common.format(a="before", b="first")).cast("int").alias("left"), F.expr(common.format(a="last", b="after")).cast("int").alias("right"))
    nodes = ranged.join(F.broadcast(edges), "part").groupBy("part").applyInArrow(_shard, NODES)
    nodes = materialize(nodes, "nodes")
    merged = nodes.where("key IS NOT NULL").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"))
    merged = materialize(merged, "merged")
    every = nodes.where("key IS NULL").unionByName(merged)
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"), F.col("n_children").alias("n"))
    out = skew_join(every, parents, "parent_key", "n", nodes.count(), "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NO_MEMBER)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, family: int = 20, most: int = 3, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The trie of rebuilt conversations; see encoded_turns, rebuilt and prefix_nodes for nulls, ties and empty tables.

    Repeated rows of a turn are turns of their own; columns other than conv_id, turn, role and text are ignored.
    """
    return prefix_nodes(sequences(rebuilt(encoded_turns(df), family, most)), shard_ids)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(documents_of(spark, sf_dir, "conversations"))


#: crc32 of decimal digits in plain SQL, by the reflected polynomial 0xEDB88320.
CRC32_DIGITS = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32_DIGITS.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
part AS (
  SELECT c.conv_id, o.pos, o.x, o.words FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h
  UNION ALL SELECT c.conv_id, o.pos, o.x, o.words FROM conv c JOIN own o ON o.conv_id = c.base AND o.pos < c.h),
seq AS (
  SELECT conv_id, coalesce(list(x ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s, coalesce(list(words ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w
  FROM conv LEFT JOIN part USING (conv_id) GROUP BY conv_id),
pre AS (SELECT conv_id, unnest(range(len(s) + 1)) AS d, s, w FROM seq),
node AS (
  SELECT md5(s[1:d]::VARCHAR) || d AS k, d, any_value(CASE WHEN d > 0 THEN md5(s[1:d - 1]::VARCHAR) || (d - 1) END) AS up, min(conv_id) AS conv_id,
    count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN w[d] ELSE 0 END) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256, any_value(s[1:d]) AS s
  FROM pre GROUP BY k, d),
child AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
above AS (SELECT k, n_convs, words, unnest(list_transform(range(d + 1), lambda i: md5(s[1:i]::VARCHAR) || i)) AS a FROM node),
below AS (
  SELECT a AS k, sum((n_convs - 1) * words) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM above LEFT JOIN child c USING (k) GROUP BY a)
SELECT node.conv_id, node.d::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below USING (k) LEFT JOIN child USING (k) LEFT JOIN node p ON p.k = node.up
"""
