"""The forest of split planes: recall and budget against all pairs, equal rows, exact answers where a budget is too small."""

import numpy as np
import pytest

from tessera.operators import forest as K
from tessera.operators import vectors as V


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>").repartition(3)


def clustered(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 24)) * 4
    return centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 24)) @ np.diag(np.linspace(1.0, 0.05, 24))


def test_recall_at_a_tenth_of_the_comparisons(spark):
    x = clustered()
    data, queries = table(spark, x), table(spark, x[::30], start=0)
    budget = len(x) // 10
    got = K.nearest_in_forest(queries.withColumn("id", queries["id"] * 30), data, 5, budget, trees=3).collect()
    d = ((x[::30, None] - x[None]) ** 2).sum(2)
    true = {30 * i: set(np.argsort(row, kind="stable")[:5].tolist()) for i, row in enumerate(d)}
    assert max(r["comparisons"] for r in got) <= budget
    found = sum(r["b"] in true[r["a"]] for r in got)
    assert found >= 0.9 * 5 * len(true)
    for r in got:
        assert r["distance"] == pytest.approx(d[r["a"] // 30, r["b"]], abs=1e-9)
    assert sorted({r["rank"] for r in got}) == [1, 2, 3, 4, 5]


def test_a_whole_budget_is_exact(spark):
    x = clustered(400)
    data = table(spark, x)
    got = {(r["a"], r["rank"]): r["b"] for r in K.nearest_in_forest(data.where("id < 40"), data, 4, 400, trees=1, leaf=16).collect()}
    want = {(r["a"], r["rank"]): r["b"] for r in V.nearest(data.where("id < 40"), data, 4).collect()}
    assert got == want


def test_copies_fill_one_leaf_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "PART", 20)
    monkeypatch.setattr(K, "ASKING", 7)
    x = np.concatenate([np.zeros((200, 3)), clustered(100)[:, :3]])
    data = table(spark, x)
    got = K.nearest_in_forest(data.where("id % 10 = 0"), data, 3, 80, trees=2, leaf=8).collect()
    assert {r["a"] for r in got} == set(range(0, 300, 10))
    assert all(r["comparisons"] <= 80 or r["comparisons"] == 300 for r in got)
    assert all(r["distance"] == 0 for r in got if r["a"] < 200)


def test_few_rows_and_small_budgets(spark):
    x = clustered(30)
    data = table(spark, x)
    short = K.nearest_in_forest(data.where("id < 3"), data, 5, 1, trees=1, leaf=4).collect()
    assert len(short) == 15 and all(r["comparisons"] == 30 for r in short)  # the budget holds no part: compared with all
    assert K.nearest_in_forest(data.where("id < 3"), data.where("id < 2"), 5, 10).count() == 6
    assert K.nearest_in_forest(data.where("false"), data, 5, 10).count() == 0
    assert K.nearest_in_forest(data.where("id < 3"), data.where("false"), 5, 10).count() == 0


def test_bins_come_in_the_order_of_their_distance():
    tree = K.Tree().grow(np.arange(16.0)[:, None], 2, np.random.default_rng(0))
    sizes = {(0, int(b)): [2] for b in set(tree.leaf_of(np.arange(16.0)[:, None]).tolist())}
    seen = [b for _, b, _ in K.visits(np.array([5.2]), [tree], sizes, 16)]
    middle = {int(tree.leaf_of(np.array([[v]]))[0]): v for v in np.arange(0.5, 16, 2)}
    gaps = [max(abs(5.2 - middle[b]) - 1.0, 0) for b in seen]
    assert len(seen) == 8 and gaps == sorted(gaps)


def test_a_task_keeps_each_querys_best(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), float(d)) for a, b, d in zip(rng.integers(0, 20, 3000), rng.permutation(3000), rng.integers(0, 50, 3000), strict=True)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[j : j + 100]]) for i in range(3)], ["a", "b", "distance"]) for j in range(0, 3000, 100)]
    want = sorted(r for a in range(20) for r in sorted((x for x in rows if x[0] == a), key=lambda x: (x[2], x[1]))[:4])
    for limit, exact in ((10**6, True), (500, True), (60, False)):
        monkeypatch.setattr(V, "HELD", limit)
        out = [tuple(r.values()) for b in V.keep_best(iter(batches), 4) for r in b.to_pylist()]
        again = sorted(r for a in range(20) for r in sorted((x for x in out if x[0] == a), key=lambda x: (x[2], x[1]))[:4])
        assert again == want and (not exact or len(out) == 80)
    assert list(V.keep_best(iter([]), 4)) == []
