"""Whole jobs: nothing is lost to a fixed limit, an order of arrival or an early end."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import transforms, vectors
from tessera.plans import q_grid
from tessera.plans.catalog import QUERIES
from tessera.streaming import stages
from tests import oracle


def recall(spark, folder):
    """Share of j10's neighbours that j11 finds, and the fewest rows of a query."""
    exact = QUERIES["j10_knn_exact"](spark, folder).select("a", "b")
    found = QUERIES["j11_knn_approx"](spark, folder).select("a", "b").cache()
    least = exact.select("a").distinct().join(found.groupBy("a").count(), "a", "left").agg(F.min(F.coalesce("count", F.lit(0)))).first()[0]
    return exact.join(found, ["a", "b"]).count() / exact.count(), least


def test_approximate_neighbours_recall(spark):
    share, least = recall(spark, oracle.DATA)
    assert share >= 0.9 and least == 5


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_approximate_neighbours_of_isolated_vectors(spark, tmp_path, scale):
    x = np.random.default_rng(7).normal(size=(200, 64)) * scale
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    share, least = recall(spark, str(tmp_path))
    assert share >= 0.9 and least == 5


def reversed_times(feed):
    """Makes the first file the newest."""
    for i, file in enumerate(feed.files):
        os.utime(file.removeprefix("file:"), (1_600_000_000 - 60 * i,) * 2)


def test_windows_survive_files_of_any_time(spark):
    days = pd.date_range("2024-01-01", periods=240, freq="h")
    df = spark.createDataFrame([(i, d.to_pydatetime(), "a") for i, d in enumerate(days)], "event_id long, ts timestamp, event_type string")
    feed = stages.replay(df, "event_id", 3)
    reversed_times(feed)
    got = stages.drained(stages.windowed_counts(feed.stream, "ts", "event_type", "1 day", "2 hours"), feed)
    assert sorted(r["start"].day for r in got.collect()) == list(range(1, 10)) and {r["n"] for r in got.collect()} == {24}


def test_accumulate_keeps_cut_and_open_measurements(spark):
    df = spark.range(250).selectExpr("id AS event_id", "CAST(id AS DOUBLE) AS value", "id DIV 100 AS m", "id % 10 AS cell", "id % 100 = 99 AS last")
    feed = stages.replay(df, "event_id", 3, clock=True)
    reversed_times(feed)
    got = stages.drained(stages.accumulate(feed.stream, "m", "cell", "value", "event_id", "last"), feed).collect()
    assert sorted((r["key"], r["cell"], r["value"]) for r in got) == [(m, c, float(top - 10 + c)) for m, top in enumerate((100, 200, 250)) for c in range(10)]


def test_accumulate_counts_records_after_the_end(spark):
    """The end flag comes with the first file; the records of the others are late."""
    df = spark.range(90).selectExpr("id AS event_id", "CAST(id AS DOUBLE) AS value", "0 AS m", "id % 10 AS cell", "id = 5 AS last")
    feed = stages.replay(df, "event_id", 3, clock=True)
    got = stages.drained(stages.accumulate(feed.stream, "m", "cell", "value", "event_id", "last"), feed).collect()
    first = sum(1 for r in spark.read.parquet(feed.shown).where("event_id is not null").collect() if r["event_id"] < 30)
    late = [r["value"] for r in got if r["cell"] is None]
    seen = 90 - late[0]
    assert len(late) == 1 and first == 30 and 6 <= seen < 90
    assert sorted((r["cell"], r["value"]) for r in got if r["cell"] is not None) == [(c, float(max(i for i in range(int(seen)) if i % 10 == c))) for c in range(10)]


def test_all_coefficients(spark):
    got = QUERIES["x1_dft"](spark, oracle.DATA).groupBy("vec_id").agg(F.count("*").alias("n"), F.count_distinct("k").alias("k")).agg(F.min("n"), F.max("n"), F.min("k")).first()
    assert tuple(got) == (64, 64, 64)


def test_zero_fill_of_all_rows(spark):
    got = QUERIES["j2_dense_zero_fill"](spark, oracle.DATA)
    total = spark.read.parquet(f"{oracle.DATA}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
    n, q, holes = got.agg(F.count("*"), F.sum("q"), F.count_if(F.col("q") == 0)).first()
    assert n == 64 * 9 * 8 and float(q) == pytest.approx(float(total)) and holes >= 64 * 2 * 8


def test_density_weights_with_holes(spark):
    cells = [(x, y) for x in range(64) for y in range(64) if x % 2 == 0]
    got = {(r["x"], r["y"]): r["weight"] for r in q_grid.density_weights(spark.createDataFrame(cells, "x long, y long").withColumn("hit", F.lit(1))).collect()}
    assert set(got) == set(cells) and got[32, 32] == 1 and got[2, 32] == pytest.approx(2)


def test_svm_has_a_weight_for_each_component(spark):
    names = [r["name"] for r in QUERIES["l7_linear_svm"](spark, oracle.DATA).collect()]
    assert names == [*(f"w{i}" for i in range(65)), "objective"]


def test_quick_shift_of_all_vectors(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(60, 6)) * [0.3, 0.2, 0.01, 0.01, 0.01, 0.01]
    x = np.concatenate([x[:, ::-1], x[:5, ::-1]])  # the two wide components last, and five copies
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = x - x.mean(0)
    p = np.round(c @ np.linalg.svd(c)[2][:2].T * 10, 2)
    d2 = ((p[:, None] - p) ** 2).sum(2)
    density = np.round(np.where(d2 <= 2.25, np.exp(-d2 / 0.5), 0).sum(1), 9)
    want = []
    for a in range(len(x)):
        denser = [b for b in range(len(x)) if d2[a, b] <= 1 and (density[b] > density[a] or density[b] == density[a] and b < a)]
        want.append(min(denser, key=lambda b: (d2[a, b], b), default=None))
    got = {r["id"]: r for r in QUERIES["l16_quick_shift_pca"](spark, str(tmp_path)).collect()}
    assert [got[i]["parent"] for i in range(len(x))] == want
    assert np.allclose([got[i]["density"] for i in range(len(x))], density, atol=1e-6)
    assert QUERIES["l16_quick_shift_roots"](spark, str(tmp_path)).count() == len(x)


def test_kmeans_by_medians(spark):
    x = [0.0, 1.0, 8.0, 20.0, 21.0, 90.0]
    df = spark.createDataFrame([(i, [v, -v]) for i, v in enumerate(x)], "id long, v array<double>")
    centres, energy = vectors.kmeans_l1(df, "v", [[0.0, 0.0], [30.0, -30.0]], 5)
    assert centres == [[1.0, -1.0], [21.0, -21.0]]
    assert all(b <= a + 1e-9 for a, b in zip(energy, energy[1:], strict=False))


@pytest.mark.parametrize("kernel", ["intersection", "js"])
def test_kernel_maps(spark, kernel):
    x, y = 0.3, 0.8
    want = min(x, y) if kernel == "intersection" else x / 2 * np.log2((x + y) / x) + y / 2 * np.log2((x + y) / y)
    df = spark.createDataFrame([([x], [y])], "x array<double>, y array<double>")
    a, b = df.select(*(vectors.kernel_map(F.col(c), 60, 0.3, kernel) for c in "xy")).first()
    assert np.dot(a, b) == pytest.approx(want, abs=0.02)


def test_aligned_series_have_the_matched_cost(spark):
    r = np.random.default_rng(9).normal(size=16)
    df = spark.createDataFrame([(0, np.roll(r, 3).tolist()), (1, np.roll(r, -2).tolist())], "id long, e array<double>")
    reference = spark.createDataFrame([(r.tolist(),)], "e array<double>")
    got = transforms.align(df, "id", "e", transforms.best_shift(df, "id", "e", reference, 4)).collect()
    assert len(got) == 2 and all(np.allclose(g["e"], r) for g in got)


def test_hierarchical_clusters_equal_node_by_node_clustering(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 3)) + 4 * rng.integers(0, 3, size=(120, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, None)], "id long, v array<double>")
    got = {r["id"]: r["path"] for r in vectors.hierarchical(df, "v", "id", branch=2, depth=2).collect()}

    def split(rows):
        start = [list(r["v"]) for r in rows.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(2).collect()]
        centres, _ = vectors.kmeans_l2(rows, "v", start, 5)
        return {r["id"]: r["cluster"] for r in vectors.assign(rows, "v", centres).collect()}

    top = split(df)
    assert all(got[i][0] == c for i, c in top.items() if i != 200)
    for branch in (0, 1):
        inside = split(df.where(F.col("id").isin([i for i, c in top.items() if c == branch and i != 200])))
        assert all(got[i][1] == c for i, c in inside.items())
