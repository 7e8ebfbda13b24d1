"""Selected quantiles against sorting."""

import math

import numpy as np
import pytest

from tessera.operators import selection as Q


def groups(seed=1):
    rng = np.random.default_rng(seed)
    out = {"hot": np.concatenate([rng.normal(size=800), [0.0] * 300]), "two": np.array([1.0, 3.0]), "one": np.array([-5.0]), None: rng.normal(size=31) * 1e200, "wide": 10.0 ** rng.uniform(-300, 300, 200) * rng.choice([-1, 1], 200)}
    out["edge"] = np.array([-math.inf, -0.0, 0.0, 5e-324, -5e-324, math.inf, 1.0])
    return out


@pytest.mark.parametrize("bits", [13, 7])
def test_quantiles(spark, bits):
    data = groups()
    rows = [(g, float(v), "x") for g, x in data.items() for v in x] + [("hot", None, "x"), ("hot", math.nan, "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "k string, value double, g string").repartition(4)
    got = {(r["k"], r["share"]): r["quantile"] for r in Q.quantiles(df, ["k"], "value", [0.0, 0.25, 0.5, 1.0], bits).collect()}
    assert set(got) == {(g, s) for g in data for s in (0.0, 0.25, 0.5, 1.0)}
    for (g, s), v in got.items():
        x = np.sort(data[g])
        at = s * (len(x) - 1)
        low, high = x[math.floor(at)], x[math.ceil(at)]
        want = low if at == math.floor(at) or low == high else low + (at - math.floor(at)) * (high - low)
        assert v == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_order_of_bits():
    x = np.array([-math.inf, -1e300, -2.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, math.inf])
    bits = Q.ordered_bits(x)
    assert (np.diff(bits) >= 0).all() and bits[4] == bits[5] and len(set(bits.tolist())) == 8


def test_deviation_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), (None, 4.0)], "k string, v double")
    assert sorted(map(tuple, Q.absolute_deviation(df, ["k"], "v").collect()), key=repr) == [("a", 2.0, 1.0), (None, 4.0, 0.0)]
    assert [tuple(r) for r in Q.absolute_deviation(df, [], "v").collect()] == [(3.0, 1.5)]
    assert Q.quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0
