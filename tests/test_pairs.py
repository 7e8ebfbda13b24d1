"""All pairs of two tables: whole, in tasks that share them, in batches of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def test_pairs_are_shared_by_tasks(spark):
    """Blocks as small as these lay in one partition, so that one task gave all rows."""
    df = table(spark, np.random.default_rng(15).normal(size=(8300, 2)))
    got = vectors.pairwise(df, df.where("id < 4200"), "l2").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    assert sum(r["n"] for r in got) == 8300 * 4200 and sum(r["a"] for r in got) == 4200 * (8300 * 8299 // 2) and sum(r["b"] for r in got) == 8300 * (4200 * 4199 // 2)
    assert len(got) >= 4 and max(r["n"] for r in got) < 8300 * 4200 * 0.6


@pytest.mark.parametrize("metric", ["l2", "l1", "linf", "l0", "chi2", "hell", "kl2", "kl1", "kchi2", "khell"])
def test_pairs_in_small_batches(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "PAIRS", 500)
    x = np.round(np.abs(np.random.default_rng(16).normal(size=(130, 5))), 1)
    df = table(spark, x)
    got = {(r["a"], r["b"]): r["distance"] for r in vectors.pairwise(df.where("id % 2 = 0"), df, metric).collect()}
    assert len(got) == 65 * 130
    want = vectors.distances(x, x, metric)
    assert all(np.isclose(v, want[a, b], atol=1e-9) for (a, b), v in got.items())


@pytest.mark.parametrize("odd", [[1.0], [1.0, None]])
def test_pairs_of_uneven_vectors_raise(spark, odd):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, odd), (2, [1.0, 2.0, 3.0])], "id long, vector array<double>").where("id < 2 or size(vector) = 3")
    with pytest.raises(Exception, match="differ in length or miss"):
        vectors.pairwise(df, df, "l1").collect()
