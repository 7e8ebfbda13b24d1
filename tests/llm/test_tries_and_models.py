"""The conversation trie, the language model and the spelling groups against plain versions."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from tessera.llm import lm_scoring, prefix_trie, queries, spelling
from tests import oracle

from . import brute

CONVERSATIONS = "conv_id long, turn long, role string, text string, words string, pos int, id string, n int"
DOCS = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_spelling_groups"])
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, oracle.connection(oracle.DATA), oracle.DATA, queries.queries()[name], queries.oracle_sql()[name]) == ""


def trie_of(turns, family=20, most=3):
    own = collections.defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(x)] for c, x in own.items()}
    seqs = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        seqs[c] = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + x[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = collections.Counter(s[:-1] for s in members if s)
    out = []
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ended = sorted(c for c in m if len(seqs[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], sum(1 for x in below if not children[x]), saved, hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    turns = []
    for c in [*range(-45, 90), 10**12, 10**12 + 3]:
        if c % 20 == 0 and c % 3 == 0:
            continue  # families without their first conversation
        for t in range(rng.randrange(1, 7)):
            turns.append((c, t, rng.choice(["user", "system"]), rng.choice(["hi there", "what  is\nthis", "", "a b c d"])))
    turns += [(None, 1, "user", "x"), (5, None, "user", "first"), (5, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (8, 1, None, "é ü x")]
    return turns


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_trie(spark, seed):
    turns = conversations(seed)
    df = spark.createDataFrame([(*t, "x", 1, "y", 2) for t in turns], CONVERSATIONS)
    assert rows(prefix_trie.conversation_trie(df)) == trie_of(turns)


def test_conversation_trie_of_many_shards_copies_and_long_conversations(spark):
    turns = [(c, t, "user", f"copy {t}") for c in range(2600) for t in range(5)]
    turns += [(c, t, "user", f"long {min(t, 150 + c % 7)} w") for c in range(5000, 5006) for t in range(300)]
    df = spark.createDataFrame([(*t, "x", 1, "y", 2) for t in turns], CONVERSATIONS)
    want = trie_of(turns)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert rows(prefix_trie.conversation_trie(df, shard_ids=100)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_conversation_trie_of_few_rows(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    one = [(3, 0, "user", "only turn")]  # crc32 decides whether it is left out, then only the root remains
    df = spark.createDataFrame([(*t, "x", 1, "y", 2) for t in one], CONVERSATIONS)
    assert rows(prefix_trie.conversation_trie(df)) == trie_of(one)
    nulls = spark.createDataFrame([(None, 1, "a", "b", "x", 1, "y", 2)], CONVERSATIONS)
    assert prefix_trie.conversation_trie(nulls).count() == 0


def test_ternary_tree_is_balanced():
    tree = prefix_trie.TernaryTree([[i] for i in range(1023)])
    depth, stack = 0, [(tree.root, 1)]
    while stack:
        x, d = stack.pop()
        depth = max(depth, d)
        stack += [(y, d + 1) for y in (tree.lo[x], tree.hi[x]) if y >= 0]
    assert depth == 10


def near_forms(count, times=10):
    near = {w: [x for x in count if x != w and abs(len(x) - len(w)) <= 1 and brute.edit_distance(w, x) == 1] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= times * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def words_of(docs, least=7, every=31):
    count = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 2}


def spelling_docs(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeétz") for _ in range(rng.randrange(7, 10))) for _ in range(40)]
    docs = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.25)), 39)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÉ") + w[k:], w[:k] + "x" + w[k + 1 :], w.upper()])
            words.append(w)
        docs.append((i, rng.choice([" ", "-", "1"]).join(words)))
    long = "abcdefghij" * 30
    return docs + [(None, f"{base[0]} {base[0]}"), (500, None), (501, ""), (502, f"{long} {long} {long[:-1]} {long[:-1]} {long[:-2]} {long[:-2]}"), (502, "×÷×÷×÷×÷ ×÷×÷×÷×÷ ×÷×÷×÷×")]


@pytest.mark.parametrize(("shard", "leaf"), [(50_000, 64), (60, 4), (7, 2)])
def test_spelling_groups(spark, monkeypatch, shard, leaf):
    docs = spelling_docs(3)
    monkeypatch.setattr(spelling, "FLUSH", 50)
    df = spark.createDataFrame([(d, t, "x", 1, b"y") for d, t in docs], DOCS + ", word string, n int, vec binary")
    words = spelling.occurring_words(df).where("n >= 2")
    count = words_of(docs)
    assert {r["word"]: r["n"] for r in words.collect()} == count
    assert rows(spelling.spelling_groups(words, shard_words=shard, leaf=leaf)) == near_forms(count)


def test_spelling_groups_of_few_words(spark):
    empty = spelling.occurring_words(spark.createDataFrame([], DOCS))
    assert spelling.spelling_groups(empty).count() == 0
    chain = [("abcdefgh", 1), ("abcdefg", 20), ("abcdefx", 300), ("abcdexx", 300), ("abcdexy", 5000), ("bacdexy", 2)]
    df = spark.createDataFrame(chain, "word string, n long")
    assert rows(spelling.spelling_groups(df)) == near_forms(dict(chain))


def test_words_of_one_vector_are_salted(spark):
    """Anagrams fill one node of the trie's last level."""
    rng = random.Random(6)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(150)} | {"abcdefg", "abcdefgg"}
    count = {w: rng.choice([2, 30, 500]) for w in words}
    got = spelling.spelling_groups(spark.createDataFrame(list(count.items()), "word string, n long"), shard_words=10, leaf=2)
    assert rows(got) == near_forms(count)


def lm_docs(seed, n=240):
    rng = random.Random(seed)
    vocabulary = [[f"{p}{i}" for i in range(60)] for p in ("a", "b", "c")]
    docs = []
    for i in range(n):
        own = vocabulary[i % 3]
        docs.append((i, " ".join(own[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randrange(5, 90)))))
    return docs + [(1000, None), (1001, ""), (1002, "A1 a1\tB2 é " + "x" * 400), (1002, "A1 a1\tB2 é " + "x" * 400), (None, "a1 b2 zzz")]


def tokens_of(text):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return [*brute.WORD.findall(low), None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def plain_lm(docs, model, corpus, symbols, classes):
    """Counts and scores, one softmax a token."""
    count = collections.Counter(t for d, x in docs if not held(d) for t in tokens_of(x))
    total, distinct = sum(count.values()), len(count)

    def cls(w):
        last = w[-1] * 257 + (w[-2] if len(w) > 1 else 0)
        return (last * 2654435761 % 2**32 >> 8) % classes

    by_class = collections.Counter()
    kept = {w for w, n in count.items() if w is not None and in_model(w, corpus)}
    for w, n in count.items():
        if w is not None and w not in kept:
            by_class[cls(w)] += n + 1
    out = []
    for d, x in docs:
        words = tokens_of(x)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        before, previous, score = 0, 0, 0.0
        for w in words:
            symbol = 0 if w is None else in_model(w, corpus) if w in kept else 1 + cls(w)
            guess = model.context[previous].astype(float) @ model.first + model.context[before].astype(float) @ model.second
            logit = model.out.astype(float) @ guess + model.bias
            score += (logit[symbol] - np.log(np.exp(logit - logit.max()).sum()) - logit.max()) / math.log(10)
            if w is not None and w not in kept:
                score += math.log10((count[w] + 1) / (by_class[cls(w)] + 1))
            before, previous = previous, symbol
        out.append((d, held(d), len(words), sum(count[w] > 0 for w in words), total, base, score))
    return out


def in_model(w, corpus):
    from tessera.llm.rolling import word_hashes

    data = np.frombuffer(w, np.uint8)
    h1, h2 = word_hashes(data, np.array([0]), np.array([len(w)]))
    symbol = int(corpus.symbols(h1, (h2 >> np.uint64(32)).astype(np.uint32), np.array([0]))[0])
    return symbol if symbol != 1 else 0


@pytest.mark.parametrize("group_bytes", [1 << 20, 2000])
def test_lm_scoring(spark, group_bytes):
    docs = lm_docs(4)
    df = spark.createDataFrame([(d, t, "x", 1, b"y", 2) for d, t in docs], DOCS + ", g string, n int, symbols binary, held_out int")
    scored, model, corpus = lm_scoring.score_corpus(df, symbols=64, classes=7, dim=8, group_bytes=group_bytes)
    got = sorted((tuple(r) for r in scored.collect()), key=lambda r: repr(r[:5]))
    want = sorted(plain_lm(docs, model, corpus, 64, 7), key=lambda r: repr(r[:5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert sorted(r[5] for r in got) == pytest.approx(sorted(r[5] for r in want), rel=1e-12)
    assert sorted(r[6] for r in got) == pytest.approx(sorted(r[6] for r in want), rel=1e-4, abs=1e-3)
    unseen = [r for r in got if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen) + 0.02 * sum(r[2] for r in unseen)


def test_lm_of_nothing_and_of_held_out_only(spark):
    assert lm_scoring.score_corpus(spark.createDataFrame([], DOCS))[0].count() == 0
    only = [(d, "some words here") for d in range(60) if held(d)]
    got = lm_scoring.score_corpus(spark.createDataFrame(only, DOCS))[0].collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(4, 0, 0, 0.0)}
    assert all(r["score"] < 0 for r in got)


def test_normaliser_and_scores_are_those_of_the_model():
    rng = np.random.default_rng(2)
    m = lm_scoring.Parameters(*(rng.normal(0, 1.5, s).astype(np.float32) for s in ((30, 6), (30, 6), (30,), (6, 6), (6, 6))))
    tables = lm_scoring.Tables(m)
    before, previous = np.meshgrid(np.arange(30), np.arange(30))
    total = sum(10 ** tables.log10(before.ravel(), previous.ravel(), np.full(900, w)) for w in range(30))
    assert total == pytest.approx(np.ones(900), rel=2e-4)


def test_contexts_stop_at_the_start_of_a_text():
    symbols, at = np.array([5, 6, 0, 0, 7, 0]), np.array([0, 3, 4, 6])
    before, previous = lm_scoring.contexts_of(symbols, at)
    assert previous.tolist() == [0, 5, 6, 0, 0, 7]
    assert before.tolist() == [0, 0, 5, 0, 0, 0]


def test_training_raises_the_likelihood_of_what_follows():
    rng = np.random.default_rng(5)
    unigram = np.full(8, 1 / 8)
    word = rng.integers(0, 8, 4000)
    previous = np.concatenate([[0], (word[1:] + 1) % 8])  # the symbol before tells the next
    before = np.zeros_like(word)
    start = lm_scoring.Parameters.start(unigram, 8)
    t = lm_scoring.Trainer(start, unigram, 0.2, 20, 1)
    for _ in range(20):
        for i in range(0, 4000, 500):
            t.step(np.column_stack([previous, before])[i : i + 500], word[i : i + 500])
    gained = lm_scoring.Tables(t.m).log10(before, previous, word).mean() - lm_scoring.Tables(start).log10(before, previous, word).mean()
    assert gained > 0.5


def plain_step(t, contexts, word, noise):
    """(context, out with the bias, both matrices) after one step of the trainer t, token by token in double precision."""
    dim = t.context.shape[1]
    context, out, turn = t.context.astype(float), t.out.astype(float), t.turn.astype(float)
    d_context, d_out, d_turn = np.zeros_like(context), np.zeros_like(out), np.zeros_like(turn)
    for (previous, before), w in zip(contexts, word, strict=True):
        seen = np.concatenate([context[previous], context[before]])
        guess = np.append(seen @ turn, 1)
        d_guess = np.zeros(dim + 1)
        for symbol, true in [(w, 1), *((k, 0) for k in noise)]:
            x = out[symbol] @ guess - t.odds[symbol]
            error = 1 / (1 + math.exp(x)) if true else -1 / (1 + math.exp(-x))
            d_guess += error * out[symbol]
            d_out[symbol] += error * guess
        d_turn += np.outer(seen, d_guess[:-1])
        d_context[previous] += turn[:dim] @ d_guess[:-1]
        d_context[before] += turn[dim:] @ d_guess[:-1]
    return [a + t.rate * d / np.sqrt(1 + d * d) for a, d in ((context, d_context), (out, d_out), (turn, d_turn))]


@pytest.mark.parametrize(("dim", "scale"), [(8, 1), (7, 1), (8, 120)])
def test_a_step_of_training_is_the_plain_one(dim, scale):
    rng = np.random.default_rng(dim)
    unigram = rng.dirichlet(np.ones(20))
    m = lm_scoring.Parameters(*(rng.normal(0, 0.5, s).astype(np.float32) for s in ((20, dim), (20, dim), (20,), (dim, dim), (dim, dim))))
    m.context *= scale  # far out, exponentials leave single precision
    t = lm_scoring.Trainer(m, unigram, 0.1, 30, 4)
    drawn = np.minimum(np.searchsorted(t.cumulative, np.random.default_rng(4).random(30)), 19)
    contexts, word = rng.integers(0, 9, (50, 2)), rng.integers(0, 12, 50)
    assert len(set(drawn.tolist())) < 30
    want = plain_step(t, contexts, word, drawn)
    t.step(contexts, word)
    for got, plain in zip((t.context, t.out, t.turn), want, strict=True):
        assert got == pytest.approx(plain, rel=1e-4, abs=1e-4)


def test_logistics_by_products_and_where_exponentials_leave_single_precision():
    rng = np.random.default_rng(8)
    previous, before = rng.integers(0, 5, 40), rng.integers(0, 5, 40)
    for scale in (1, 60, 300):
        first, second = (rng.uniform(-scale, scale, (5, 6)).astype(np.float32) for _ in range(2))
        got = lm_scoring.logistics(first, second, previous, before)
        x = np.minimum(first[previous].astype(float) + second[before], 700)
        assert got == pytest.approx(1 / (1 + np.exp(x)), rel=1e-4, abs=1e-30)


def test_a_step_of_training_works_on_its_batch_not_on_the_whole_table():
    """Rows without a gradient stay as they are, so a step needs no room of the table's size."""
    symbols, dim = 200_000, 32
    unigram = np.full(symbols, 1 / symbols)
    t = lm_scoring.Trainer(lm_scoring.Parameters.start(unigram, dim), unigram, 0.1, 20, 1)
    rng = np.random.default_rng(3)
    tracemalloc.start()
    try:
        t.step(rng.integers(0, symbols, (64, 2)), rng.integers(0, symbols, 64))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < t.context.nbytes / 10
