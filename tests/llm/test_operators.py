"""The text operators against plain versions, on small and awkward inputs."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import embedding_dedup, exact_dedup, license_scan, mixing, near_dedup, packing, substring_dedup, suffix_dedup, toxicity, warc
from tessera.llm.scratch import documents_of
from tests import oracle

from . import brute

DOCS = "doc_id long, text string"


def awkward(seed=1):
    rng = random.Random(seed)
    docs = [(i, "".join(rng.choice("ab \0é") for _ in range(rng.randrange(300)))) for i in range(25)]
    shared = "".join(rng.choice("abc ") for _ in range(120))
    for i in range(30):
        before, after = ("".join(rng.choice("xyz ") for _ in range(rng.randrange(50))) for _ in range(2))
        docs.append((100 + i, before + shared[rng.randrange(40) : rng.randrange(60, 120)] + after))
    return docs + [(200, None), (201, ""), (202, "a " * 300), (203, docs[3][1]), (203, docs[3][1]), (None, docs[5][1]), (204, docs[32][1].replace(" ", "\n"))]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def with_more_columns(spark, docs):
    """Extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "x", 1, 2.0, "y") for d, t in docs], DOCS + ", g string, key int, score double, digest string")


@pytest.mark.parametrize(("size", "limit", "hot"), [(20, 4000, 64), (50, 4000, 64), (50, 1, 64), (50, 4000, 2), (20, 4000, 4)])
def test_suffix_dedup(spark, size, limit, hot):
    docs = awkward()
    got = suffix_dedup.remove_repeats(with_more_columns(spark, docs), length=size, group_bytes=900, open_limit=limit, hot_from=hot).drop("kept")
    assert rows(got) == brute.repeats(docs, size)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS), length=size).count() == 0


@pytest.mark.parametrize("size", [2, 5, 20])
def test_substring_dedup(spark, size):
    docs = awkward(2)
    got = substring_dedup.remove_later_copies(with_more_columns(spark, docs), window=size, group_bytes=900).drop("kept")
    assert rows(got) == brute.later_copies(docs, size)
    assert substring_dedup.remove_later_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_near_dedup(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(8)]
    docs = []
    for i in range(80):
        words = list(base[i % 8])
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        docs.append((i, " ".join(words)))
    docs += [(90, None), (91, ""), (92, "One two"), (93, "one  TWO"), (94, " \n")]
    assert rows(near_dedup.near_groups(with_more_columns(spark, docs))) == brute.near_groups(docs)
    assert near_dedup.near_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_dedup(spark):
    docs = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (4, "X")]
    got = [r[:4] for r in rows(exact_dedup.exact_groups(with_more_columns(spark, docs)))]
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (4, 4, 1, True)], key=repr)
    small = [r[:4] for r in rows(exact_dedup.exact_groups(with_more_columns(spark, docs), keep="smallest"))]
    assert (1, 1, 2, True) in small
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_digest_index_grows_and_compacts(spark):
    def rows_of(docs):
        return exact_dedup.rows_of(spark.createDataFrame(docs, DOCS), "doc_id", "text")

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    index = exact_dedup.DigestIndex(spark, fanout=2)
    hits = [{r[0] for r in index.insert(rows_of(docs)).collect()} for docs in ([(5, "a"), (6, "b"), (9, "b")], [(1, "a"), (7, "c")], [(0, "c"), (8, "d")])]
    assert hits == [{digest("b")}, {digest("a")}, {digest("c")}]
    assert [len(level) for level in index.levels] == [1, 1]
    asked = spark.createDataFrame([(digest(t),) for t in "abcdz"], "digest string")
    want = {digest("a"): (1, 2), digest("b"): (6, 2), digest("c"): (0, 2), digest("d"): (8, 1)}
    assert {r["digest"]: (r["key"], r["rows"]) for r in index.lookup(asked).collect()} == want
    index.compact()
    assert [len(level) for level in index.levels] == [0, 0, 1]
    assert {r["digest"]: (r["key"], r["rows"]) for r in index.lookup(asked).collect()} == want


def test_filters_rule_out_most_other_digests(spark):
    index = exact_dedup.DigestIndex(spark)
    index.insert(exact_dedup.rows_of(spark.createDataFrame([(i, f"in {i}") for i in range(3000)], DOCS), "doc_id", "text"))
    others = exact_dedup.rows_of(spark.createDataFrame([(i, f"out {i}") for i in range(3000)], DOCS), "doc_id", "text")
    (run,) = index.runs
    assert run.passing(run.entries.select("digest")).count() == 3000
    assert run.passing(others).count() < 300
    assert run.lookup(others).count() == 0


def test_exact_dedup_of_texts_that_share_a_digest(spark, monkeypatch):
    """Were a digest ever shared, bytes decide; lengths alone stand for it here."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.octet_length(c).cast("string"))
    docs = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, "c"), (6, "x" * 1_200_000), (7, "x" * 1_200_000), (8, "y" * 1_200_000)]
    got = [r[:4] for r in rows(exact_dedup.exact_groups(spark.createDataFrame(docs, DOCS)))]
    assert got == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True)]


def test_embedding_dedup_of_two_lengths_with_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PANEL", 3)
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(700)]
    vectors += [(1000 + i, [1.01 * x for x in vectors[i][1]]) for i in range(100)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r[0]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_groups(df, block=2, pivots=600).collect()}
    links, up = collections.Counter(), {i: i for i, _ in vectors}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors}
    for size in (4, 5):
        own = sorted(i for i, v in vectors if len(v) == size)
        m = np.array([unit[i] for i in own])
        near = m @ m.T >= 0.9
        np.fill_diagonal(near, False)
        low = np.arange(len(own))
        while True:
            new = np.minimum(low, np.where(near, low[None, :], len(own)).min(1))
            if (new == low).all():
                break
            low = new
        for k, i in enumerate(own):
            links[i], up[i] = int(near[k].sum()), own[low[k]]
    assert got == {i: (links[i], up[i]) for i, _ in vectors}


@pytest.mark.parametrize("strip", [512, 2])
def test_embedding_dedup(spark, monkeypatch, strip):
    monkeypatch.setattr(embedding_dedup, "STRIP", strip)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    vectors = [(i, (base[i % 20] + 0.25 * rng.normal(size=16)).tolist()) for i in range(150)]
    vectors += [(200, vectors[0][1]), (201, [2 * v for v in vectors[0][1]]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] * 16), (206, [1.0]), (207, [])]
    df = spark.createDataFrame([(i, v, "z") for i, v in vectors], "vec_id long, embedding array<double>, digest string")
    got = {r[0]: tuple(r)[1:] for r in embedding_dedup.embedding_groups(df, block=40, pivots=4).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    up = {i: i for i, _ in vectors}
    links = collections.Counter()
    for _ in range(len(good)):
        changed = False
        for a, x in good.items():
            for b, y in good.items():
                if a < b and x @ y >= 0.9 and up[a] != up[b]:
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
        if not changed:
            break
    for a, x in good.items():
        links[a] = sum(1 for b, y in good.items() if a != b and x @ y >= 0.9)
    assert got == {i: (links[i], up[i], up[i] == i) for i, _ in vectors}
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(8)
    u = rng.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, scale, err, norm = embedding_dedup.quantised(u)
    approx = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert np.all(np.abs(u @ u.T - approx) <= norm[:, None] * err + err[:, None])


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    words = [("abcde", False), ("abd", False), ("bcab", True), ("aabbcc", False)]
    automaton = toxicity.Automaton(words)
    for _ in range(2000):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
        kinds = automaton.classes[np.frombuffer(w.encode("utf-32-le"), np.uint32)]
        want = 1 if w in ("abcde", "abd", "aabbcc") or w.startswith("bcab") else 2 if min(brute.edit_distance(w, x) for x in ("abcde", "aabbcc")) <= 1 else 0
        assert automaton.match(kinds, np.array([0]), np.array([len(w)]))[0] == want


def test_quoted_matches_count_apart():
    automaton = toxicity.Automaton([("idiot", False)])
    x = toxicity.features(automaton, ["you idiot", 'he said "idiot" then', "an idi0t here", "", "nothing"])
    assert x[0, 1] > 0 and x[1, 1] == 0 and x[1, 3] > 0 and x[2, 2] > 0 and not x[3, 1:].any() and not x[4, 1:].any()


def test_toxicity_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = documents_of(spark, sf, "labels")
    got = toxicity.toxicity(documents_of(spark, sf), labels)
    joined = got.where("held_out").join(labels.where("toxic is not null"), "doc_id").select("toxic", "predicted").collect()
    right = sum(r["toxic"] == r["predicted"] for r in joined) / len(joined)
    assert right > 0.95
    assert got.count() == documents_of(spark, sf).count()


def test_toxicity_without_labels(spark):
    docs = with_more_columns(spark, [(1, None), (2, ""), (None, "x"), (3, "long " * 5000)])
    got = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in got.collect()} == {0} and got.count() == 4


def test_mixing(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["a", "b", "c", None, "tiny"] if i % 50 == 0 else ["a", "a", "b", None])) for i in range(400)]
    docs += [(500, None, "a"), (501, "", "empty"), (502, "one two", "b"), (502, "one two", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    by_size, source = collections.Counter(), dict((d, s) for d, _, s in docs)
    size = {d: len((t or "").split()) for d, t, _ in docs}
    for d, t, s in docs:
        by_size[s] += len((t or "").split())
    names = sorted((s for s in by_size if s is not None)) + ([None] if None in by_size else [])
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(by_size.values())
    capped: set = set()
    while True:
        level = (total - sum(3 * by_size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * by_size[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_size[s] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(3 * by_size[s] if s in capped else weight[s] * level)
        assert r["taken"] == r["copies"] * r["size"] + r["part"]
        taken[s] += r["taken"]
    target = {source[r["doc_id"]]: r["target"] for r in got}
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert rows(mixing.mix(df)) == rows(mixing.mix(df.repartition(7)))
    assert mixing.mix(df.limit(0)).count() == 0


def test_two_margins_are_balanced(spark):
    cells = spark.createDataFrame([("a", "x", 30.0), ("a", "y", 10.0), ("b", "x", 20.0), ("b", "y", 40.0)], "s string, l string, size double")
    wanted = {"s": spark.createDataFrame([("a", 50.0), ("b", 50.0)], "s string, target double"), "l": spark.createDataFrame([("x", 40.0), ("y", 60.0)], "l string, target double")}
    got = mixing.balanced_rates(cells, wanted).collect()
    for key, table in (("s", {"a": 50, "b": 50}), ("l", {"x": 40, "y": 60})):
        for level, target in table.items():
            assert sum(r["size"] * r["rate"] for r in got if r[key] == level) == pytest.approx(target)


def pages(spark):
    return spark.createDataFrame([(1, "u", "x" * 50000), (2, None, "x" * 50000), (3, "a b\r\nc", None), (4, "u", ""), (None, "u", "x" * 50000), (5, "u", "é" * 30000), (5, "u", "é" * 30000), (6, "u", "0\r\n\r\n")], "page_id long, url string, html string")


def test_warc_round_trip(spark):
    found = warc.round_trip(pages(spark), segment_bytes=1000, archive_bytes=2000)
    whole = {(r["page"], bytes(r["payload"])) for r in found.where("record_type = 'response'").collect()}
    assert whole == {("1", b"x" * 50000), ("3", b""), ("5", "é".encode() * 30000), ("6", b"0\r\n\r\n")}
    got = rows(warc.resolved(found))
    digest = {p: base64.b32encode(hashlib.sha1(p.encode()).digest()).decode() for p in ("x" * 50000, "", "é" * 30000, "0\r\n\r\n")}
    long, wide = digest["x" * 50000], digest["é" * 30000]
    assert got == sorted([(1, 50000, long, "response", None), (2, 50000, long, "revisit", 1), (None, 50000, long, "revisit", 1), (3, 0, digest[""], "response", None), (4, 0, digest[""], "revisit", 3), (5, 60000, wide, "response", None), (5, 60000, wide, "response", None), (6, 5, digest["0\r\n\r\n"], "response", None)], key=repr)
    assert warc.resolved(warc.round_trip(pages(spark).limit(0))).count() == 0


def test_warc_faults_are_named(spark):
    from pyspark.sql import functions as F

    rows_of = spark.createDataFrame([("a", "response", None, None, "D", None, [(1, b"x"), (3, b"y")]), ("b", "response", None, None, "D", 5, [(1, b"x"), (2, b"y")]), ("c", "response", None, None, "D", None, [(0, b"Transfer-Encoding: chunked\r\n\r\nzz")])], "origin string, kind string, refers_to string, url string, digest string, total long, blocks array<struct<segment:int,block:binary>>")
    faults = {r["record_id"]: r["fault"] for r in warc.decode(rows_of).select("record_id", F.col("fault")).collect()}
    assert faults == {"a": "segments are missing or repeated", "b": "the segments' length isn't the total length", "c": "broken transfer framing"}


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = [None, "", "É <|endoftext|> x́ ﬁ İ don't 12\xa03", "word " * 9000, "".join(chr(rng.choice([65, 97, 233, 32, 0x4E2D, 0x301, 48, 39, 10])) for _ in range(3000))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(i, "some words here " * rng.randrange(1, 900)) for i in range(10, 60)] + [(1, ""), (None, "a b")]
    got = packing.pack(with_more_columns(spark, docs), path).collect()
    ids = {d: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in docs}
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {d: len(ids[d]) * (2 if d == 1 else 1) for d in ids}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    # 53 remainders: what no sum fills is at most two windows
    assert sum(4096 - sum(n for _, n in p) for p in sequences.values()) <= 2 * 4096
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


def test_slack_filling_is_optimal_on_small_cases():
    rng = random.Random(9)
    for _ in range(100):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(6)}
        space = rng.randrange(1, 80)
        got = packing.fill(space, counts, sorted(counts, reverse=True))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        assert sum(k * n for k, n in got) == max(s for s in sums if s <= space)
        assert all(n <= counts[k] for k, n in got)


def test_license_scan_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "Released under  the MIT\nLicense."), (3, "x Released under the MIT License. y"), (4, license_scan.NOTICES[7][1].replace("terms", "term")), (None, license_scan.NOTICES[0][1]), (5, "license " * 20000)]
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(with_more_columns(spark, docs)).collect()}
    assert got == {(3, "MIT"), (4, "GPL-2.0-or-later"), (None, "Apache-2.0")}
    assert license_scan.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op4_substring_dedup", "op7_exact_dedup", "op8_minhash_near_dedup", "op9_license_scan"])
def test_query_equals_sql(spark, name):
    from tessera.llm import queries

    assert oracle.compare(spark, oracle.connection(oracle.DATA), oracle.DATA, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_near_copies_of_both_texts_of_an_id(spark):
    one, two = ([f"{kind}{i}" for i in range(60)] for kind in "pq")
    texts = [(1, one), (1, two), (2, [*one, "end"]), (3, [*two, "end"]), (4, [f"r{i}" for i in range(60)])]
    df = spark.createDataFrame([(i, " ".join(words)) for i, words in texts], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_groups(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def thue_morse(n):
    """A word and its complement that collide under every polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_polynomial_hashes_confuse(spark, n):
    from tokenizers import Tokenizer

    x, y = thue_morse(n)
    same = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, x), (4, y)]
    df = spark.createDataFrame(docs, DOCS)
    assert rows(substring_dedup.remove_later_copies(df).drop("kept")) == brute.later_copies(docs, 20)
    assert rows(near_dedup.near_groups(df)) == brute.near_groups(docs)
    whole = Tokenizer.from_file(packing.tokenizer_path())
    got = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.pack(df, packing.tokenizer_path()).collect()}
    for d, t in docs:
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4")
        for at in range(0, len(ids), 4096):
            assert got[d, at] == zlib.crc32(ids[at : at + 4096].tobytes())


def test_word_hashes_tell_words_apart():
    from tessera.llm.rolling import run_hashes, word_hashes, words

    rng = random.Random(11)
    tokens = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["a" * n for n in (255, 256, 257, 258)] * 2
    data = np.frombuffer(" ".join(tokens).encode(), np.uint8)
    s, e, _ = words(data, np.array([0, len(data)]))
    first, second = word_hashes(data, s, e)
    assert len(s) == len(tokens) and len(set(first.tolist())) == len(set(second.tolist())) == len(set(tokens))
    for size in (1, 2, 3, 5, 7, 8, 20):
        runs = [tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)]
        got = run_hashes(first, size).tolist()
        assert len(got) == len(runs) and len(set(zip(got, runs, strict=True))) == len(set(got)) == len(set(runs))


def test_packing_with_words_of_one_key(monkeypatch):
    from tokenizers import Tokenizer

    from tessera.llm.rolling import word_hashes

    monkeypatch.setattr(packing, "word_hashes", lambda *x: (word_hashes(*x)[0] & np.uint64(3), word_hashes(*x)[1]))
    text = "some words that all share very few keys".encode()
    ids, at = packing.WordTokens(packing.tokenizer_path()).texts(np.frombuffer(text, np.uint8), np.array([0, 10, len(text)]))
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = [whole.encode(t.decode(), add_special_tokens=False).ids for t in (text[:10], text[10:])]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_bands_retrieve_the_notices(spark):
    """All notices in other text are found with all bands, and many are lost with one band: it is the bands that find them."""
    rng = random.Random(12)
    docs = []
    for i in range(60):
        lic, text = license_scan.NOTICES[i % len(license_scan.NOTICES)]
        around = [" ".join(f"v{rng.randrange(5000)}" for _ in range(2 * len(text.split()))) for _ in range(2)]
        docs.append((i, f"{around[0]} {text} {around[1]}"))
    df = spark.createDataFrame(docs, DOCS)
    want = {(i, license_scan.NOTICES[i % len(license_scan.NOTICES)][0]) for i in range(60)}

    def found(bands):
        return {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(df, bands=bands).collect()}

    assert want <= found(license_scan.BANDS)
    assert len(want & found(1)) < 0.8 * len(want)


@pytest.mark.parametrize(("block", "part"), [(8192, 1024), (7, 3)])
def test_buckets_of_many_components(spark, monkeypatch, block, part):
    """Chains of near copies whose ends are far apart, and families below the threshold, in blocks and parts of any size."""
    rng = random.Random(13)
    words = [f"u{i}" for i in range(80)]
    docs, now = [], list(words)
    for i in range(40):  # a chain: each step changes two words
        docs.append((i, " ".join(now)))
        for _ in range(2):
            now[rng.randrange(80)] = f"c{rng.randrange(10**6)}"
    for i in range(40, 80):  # variants of one text, mostly too far from each other
        other = list(words)
        for _ in range(rng.randrange(4, 10)):
            other[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        docs.append((i, " ".join(other)))
    plain = near_dedup.rest_of_buckets
    monkeypatch.setattr(near_dedup, "rest_of_buckets", lambda *a: plain(*a, block=block, part=part))
    monkeypatch.setattr(near_dedup, "TASK_WORDS", 2000)
    assert rows(near_dedup.near_groups(spark.createDataFrame(docs, DOCS))) == brute.near_groups(docs)


def test_toxicity_scores_of_every_document(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents_of(spark, sf), documents_of(spark, sf, "labels")
    lexicon, weights = toxicity.train(docs, labels)
    assert lexicon
    word = next(w for w, stem in lexicon if not stem and len(w) >= 5)
    odd = [(10**6, f"{word[:-1]} x"), (10**6 + 1, f'she said "{word}" today'), (10**6 + 2, f"{word}s {word[0]}{word} @{word}"), (10**6 + 3, None), (10**6 + 4, ""), (10**6 + 5, "“" + word + "” " * 3 + "pad " * 40 + word)]
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, DOCS))
    got = {r["doc_id"]: r["score"] for r in texts.select("doc_id", toxicity.score_of("text", lexicon, weights).alias("score")).collect()}
    plain = [tuple(r) for r in texts.collect() if r["doc_id"] % 4 == 0 or r["doc_id"] >= 10**6]
    want = brute.toxicity_scores([t for _, t in plain], lexicon, weights, toxicity.QUOTES, toxicity.REPORTING)
    assert len(got) == texts.count() and [got[d] for d, _ in plain] == pytest.approx(want)
    query = {r["doc_id"]: r["score"] for r in toxicity.op3_toxicity(spark, sf).collect()}
    assert {d: got[d] for d in query} == pytest.approx(query)


def test_mixing_takes_the_right_words_of_each_document(spark):
    rng = random.Random(14)
    docs = [(i, " ".join("w" * rng.randrange(0, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(None, "no id here", "a"), (7, "x " * 700_000, "b"), (8, None, "d")]
    df = spark.createDataFrame([(d, t, s, "y", 3, 4) for d, t, s in docs], "doc_id long, text string, source string, bucket string, size int, h int")
    got = mixing.mix(df).collect()
    source = {mixing_key(r): None for r in got}
    hashed = spark.createDataFrame(docs, DOCS + ", source string").select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.row_hash("doc_id", "text").alias("h")).collect()
    by_source = {}
    for r in got:
        s = next(x["source"] for x in hashed if (x["doc_id"], x["h"]) == (r["doc_id"], r["h"]))
        by_source[s] = r["target"]
    want = brute.taken_words([tuple(x) for x in hashed], by_source)
    assert collections.Counter((r["doc_id"], r["h"], r["taken"]) for r in got) == collections.Counter((x["doc_id"], x["h"], w) for x, w in zip(hashed, want, strict=True))
    assert len(source) == len(got)


def mixing_key(row):
    return row["doc_id"], row["h"]


def test_suffix_dedup_at_its_own_length(spark):
    """200 bytes, with texts beyond a chunk of 1 MiB."""
    rng = random.Random(15)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    shared = noise(260)
    docs = [(i, noise(rng.randrange(300)) + shared[rng.randrange(60) :] + noise(rng.randrange(300))) for i in range(20)]
    docs += [(30, noise(1_100_000) + shared + noise(200)), (31, noise(500) + shared[:199]), (32, "z" * 2000), (None, shared), (None, noise(250)), (33, None), (33, "")]
    got = suffix_dedup.remove_repeats(with_more_columns(spark, docs), group_bytes=200_000, hot_from=3).drop("kept")
    assert rows(got) == brute.repeats(docs, 200)


def test_long_texts_of_op4_and_op8(spark):
    rng = random.Random(16)
    long = [f"w{rng.randrange(30_000)}" for _ in range(200_000)]
    docs = [(1, " ".join(long)), (2, " ".join([*long[:150_000], "x", *long[150_001:]])), (3, " ".join(long[1000:1100])), (4, "short text of six words here")]
    df = spark.createDataFrame(docs, DOCS)
    assert rows(substring_dedup.remove_later_copies(df).drop("kept")) == brute.later_copies(docs, 20)
    assert rows(near_dedup.near_groups(df)) == brute.near_groups(docs)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_beyond_the_broadcast(spark, monkeypatch, how):
    from tessera.llm import skew

    monkeypatch.setattr(skew, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    left = [(k % 3 if k < 60 else k, k) for k in range(100)] + [(None, 7)]
    right = [(k, f"r{k}", sum(1 for x, _ in left if x == k)) for k in [0, 1, *range(60, 90)]]
    a, b = spark.createDataFrame(left, "key int, v int"), spark.createDataFrame(right, "key int, r string, n long")
    got = rows(skew.skew_join(a, b, "key", "n", len(left), how).select("key", "v", "r"))
    value = {k: r for k, r, _ in right}
    assert got == sorted(((k, v, value.get(k)) for k, v in left if how == "left" or k in value), key=repr)
    kept = rows(skew.with_keys(a, b.select("key"), "key", "left_anti"))
    assert kept == sorted(((k, v) for k, v in left if k not in value), key=repr)
