"""Each stage of the pipeline, judged on its own input."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from tessera.llm.scratch import documents_of, materialize

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents_of(spark, SF)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), name))
    for before, after in zip(seen[:-2], seen[1:-1], strict=True):
        assert after.columns == docs.columns and after.count() > 0
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    plain = {i: {r["doc_id"]: r["text"] for r in df.collect()} for i, df in enumerate(seen[:-1])}
    # exact: one row a text, the largest id
    largest = {}
    for d, t in plain[1].items():
        largest[t] = max(d, largest.get(t, d))
    assert set(plain[2]) == set(largest.values())
    # near: one document a group
    assert set(plain[3]) == {d for d, _, _, kept in brute.near_groups(sorted(plain[2].items())) if kept}
    # mixing: copies of whole texts, parts are their first words
    for r in seen[4].collect():
        whole = plain[3][r["doc_id"]]
        assert r["text"] == whole or whole.split()[: len(r["text"].split())] == r["text"].split()
    # packing: all ids of all rows, each once
    from tokenizers import Tokenizer

    from tessera.llm.packing import tokenizer_path

    whole = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in seen[4].collect():
        ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want.update((r["doc_id"], s, zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096))
    assert collections.Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in seen[5].collect()) == want


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


EXTRA = ["_id", "_h", "_part", "_n", "_digest", "_toxicity", "__key", "key", "kept", "score", "h", "source_size", "labels", "toxic", "node", "part", "g"]


def awkward_docs(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(4)]
    texts = [(1, None, "a"), (2, "", "a"), (3, None, None), (4, "one two three", "b"), (5, "one two three", "b"), (5, "one two three", "b"), (None, "one two three", "c"), (None, "alone", "c")]
    texts += [(10 + i, t, "d") for i, t in enumerate(near)]
    texts += [(20, "long word " * 150_000, "e"), (21, "x" * 1_100_000, "e"), (22, " \n\t", "e")]
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), *(f"c{i}" for i in range(len(EXTRA)))) for d, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))


def test_stages_on_awkward_rows(spark):
    docs = awkward_docs(spark)
    every = sorted((tuple(r) for r in docs.collect()), key=repr)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        assert seen[name].columns == docs.columns
    assert sorted((tuple(r) for r in seen["toxicity"].collect()), key=repr) == every
    exact = sorted((tuple(r) for r in seen["exact_dedup"].collect()), key=repr)
    largest, want = {}, set()
    for r in every:
        largest[r[1] or ""] = max(-1 if r[0] is None else r[0], largest.get(r[1] or "", -1))
    want = {r for r in every if (-1 if r[0] is None else r[0]) == largest[r[1] or ""]}
    assert exact == sorted(want, key=repr)
    groups = brute.near_groups([(r[0], r[1]) for r in every if r[0] is not None])
    gone = {d for d, _, _, kept in groups if not kept}
    assert collections.Counter(tuple(r) for r in seen["near_dedup"].collect()) == collections.Counter(r for r in every if r[0] not in gone)
    mixed = seen["mixing"].collect()
    text = {(r[0], r[1]) for r in every}
    for r in mixed:
        assert r["text"].split() and any(d == r["doc_id"] and t and t.split()[: len(r["text"].split())] == r["text"].split() for d, t in text)
        assert tuple(r)[5:] == every[0][5:]
    assert sum(p["length"] for p in seen["packing"].select("length").collect()) >= len(every)
    assert seen["packing"].select("doc_id", "start").where("start = 0").count() == len(every)


def test_toxicity_stage_drops_what_scores_half(spark):
    from tessera.llm import toxicity

    sf = "/root/testdata/sf0.01"
    docs = documents_of(spark, sf)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, documents_of(spark, sf, "labels")).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    assert kept == {d for d, x in scores.items() if x < 0.5} and len(kept) < len(scores)
