"""Series in small blocks against the same series in one array."""

import numpy as np
import pytest

from tessera.operators import long_series as B
from tessera.operators import series as S
from tessera.operators import transforms as T


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    return {"a": rng.normal(size=347), "b": rng.normal(size=20), "c": rng.normal(size=1), None: rng.normal(size=41)}


@pytest.fixture(scope="module")
def at(spark, rows):
    df = spark.createDataFrame([(s, i, float(v)) for s, x in rows.items() for i, v in enumerate(x)], "s string, t long, v double").repartition(5)
    placed = B.placed(df, "s", ["t"])
    assert placed.where("place <> t").count() == 0
    return placed


def by_series(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["s"], {})[r["t"] if "t" in r.asDict() else r["place"]] = r[value]
    return {s: [x[i] for i in sorted(x)] for s, x in out.items()}


@pytest.mark.parametrize("size", [7, 20, 1000])
def test_smooth_and_median(at, rows, size):
    taps = S.gaussian_taps(9)
    smooth = by_series(B.smooth(at, "s", ["s", "t"], "v", taps, rows=size), "y")
    median = by_series(B.moving_median(at, "s", ["s", "t"], "v", 5, rows=size), "y")
    for s, x in rows.items():
        wide = np.pad(x, 4)
        assert smooth[s] == pytest.approx(sum(w * wide[4 + i : 4 + i + len(x)] for i, w in taps.items()))
        wide = np.pad(x, 2, mode="edge")
        assert median[s] == pytest.approx([np.median(wide[i : i + 5]) for i in range(len(x))])


def test_a_halo_of_several_blocks(at, rows):
    taps = {i: 1.0 for i in range(-10, 11)}
    got = by_series(B.smooth(at, "s", ["s", "t"], "v", taps, rows=3), "y")
    for s, x in rows.items():
        assert got[s] == pytest.approx([x[max(0, i - 10) : i + 11].sum() for i in range(len(x))])


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_bandpass_equals_the_array_form(spark, at, rows, size):
    got = by_series(B.bandpass(at, "s", "v", 0.05, 0.2, rows=size), "filtered")
    whole = T.bandpass(spark.createDataFrame([(s, [float(v) for v in x]) for s, x in rows.items()], "s string, e array<double>"), "e", 0.05, 0.2)
    want = {r["s"]: r["filtered"] for r in whole.collect()}
    for s in rows:
        assert got[s] == pytest.approx(want[s], abs=1e-12)


def test_peaks(at):
    got = sorted((r["s"] or "", r["t"]) for r in B.find_peaks(at, "s", "t", "v", ["s", "t"], rows=11).collect())
    plain = at.drop("place", "total").na.fill({"s": ""})
    assert got == sorted((r["s"], r["t"]) for r in S.find_peaks(plain, "s", "t", "v").collect())


@pytest.mark.parametrize("size", [5, 1000])
def test_interpolation_over_far_knots(spark, at, size):
    plain = at.na.fill({"s": ""}).withColumn("x", at["t"].cast("double"))
    knots, raster = plain.where("t % 17 = 3 OR s = 'b' AND t IN (2, 4)"), plain.where("t % 17 <> 3")
    got = sorted(map(tuple, B.interpolate(knots, raster, "s", "x", "v", rows=size).collect()), key=repr)
    want = sorted(map(tuple, S.interpolate(knots, raster, "s", "x", "v").collect()), key=repr)
    known = {r["s"] for r in knots.select("s").distinct().collect()}
    assert [g[:2] for g in got if g[0] in known] == [w[:2] for w in want if w[0] in known]
    assert [g[2] for g in got if g[0] in known] == pytest.approx([w[2] for w in want if w[0] in known])
    assert all(g[2] is None for g in got if g[0] not in known)


def test_one_long_series_is_dealt_evenly(spark):
    df = spark.range(4000).selectExpr("'x' AS s", "id AS t", "CAST(id % 7 AS double) AS v").repartition(4)
    sizes = [r["count"] for r in B.with_halo(B.placed(df, "s", ["t"]), 2, 2, rows=250).groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 254


def test_empty_tables_and_nulls(spark):
    empty = B.placed(spark.createDataFrame([], "s string, t long, v double"), "s", ["t"])
    assert B.smooth(empty, "s", ["s", "t"], "v", {0: 1.0}).count() == 0
    assert B.bandpass(empty, "s", "v", 0.1, 0.3).count() == 0
    holes = B.placed(spark.createDataFrame([("a", i, None if i == 3 else 1.0) for i in range(6)], "s string, t long, v double"), "s", ["t"])
    assert by_series(B.smooth(holes, "s", ["s", "t"], "v", {-1: 0.5, 0: 0.5}, rows=2), "y")["a"] == [0.5, 1.0, 1.0, None, None, 1.0]
