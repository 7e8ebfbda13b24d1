"""Sparse linear models, merging and sample design over the supplied tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import linear as L
from tessera.operators import sampling as D
from tessera.operators import vectors as V

from .registry import query

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "month", "part"]


def design(t) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"), F.month("l_shipdate").cast("double").alias("month"), (F.col("l_partkey") % 100).cast("double").alias("part"), "l_extendedprice", "l_returnflag")
    return L.standardised(rows, FEATURES, "l_extendedprice")


def weights(t, rows) -> DataFrame:
    return t.spark.createDataFrame([(str(g), f, round(float(w), 6)) for g, ws in rows for f, w in zip(FEATURES, ws, strict=False)], "model string, feature string, weight double")  # one row per weight


@query("l8_lasso")
def _(t):
    d = design(t)
    return weights(t, [("lasso", L.lasso(d, FEATURES, "l_extendedprice", 0.01)), ("elastic_net", L.lasso(d, FEATURES, "l_extendedprice", 0.01, ridge=1000.0)), ("nonnegative", L.lasso(d, FEATURES, "l_extendedprice", 0.01, nonnegative=True))])


@query("l8_lasso_ball")
def _(t):
    _, gram, cross, _ = L.statistics(design(t), FEATURES, "l_extendedprice")[None]
    return weights(t, [("ball", L.solve(gram, cross, L.l1_ball(0.5)))])


@query("l10_group_lasso")
def _(t):
    _, gram, cross, _ = L.statistics(design(t), FEATURES, "l_extendedprice")[None]
    lam = 0.05 * np.abs(cross).max()
    groups = [[0], [1, 2], [3, 4, 5]]
    return weights(t, [("group", L.solve(gram, cross, L.shrink_groups(groups)(lam))), ("sparse_group", L.solve(gram, cross, L.shrink_groups(groups, within=0.5)(lam)))])


@query("l11_multitask_lasso")
def _(t):
    return weights(t, sorted(L.multitask(design(t), FEATURES, "l_extendedprice", "l_returnflag", 100.0).items()))


@query("l12_fused_lasso")
def _(t):
    _, gram, cross, _ = L.statistics(design(t), FEATURES, "l_extendedprice")[None]
    top = np.abs(cross).max()
    return weights(t, [("fused", L.solve(gram, cross, L.fused(0.01 * top, 0.05 * top)))])


@query("l13_regularisation_path")
def _(t):
    return weights(t, L.path(design(t), FEATURES, "l_extendedprice", [0.5, 0.1, 0.01, 0.001]))


@query("l14_nonconvex_fit")
def _(t):
    _, gram, cross, _ = L.statistics(design(t), FEATURES, "l_extendedprice")[None]
    n = gram[0, 0]
    return weights(t, [(k, L.solve(gram / n, cross / n, L.nonconvex(k, 0.01, 3.0), steps=2000)) for k in ("capped", "log", "scad", "mcp")])


def quality_rows(t) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select(F.log1p(F.col("n_chars").cast("double")).alias("size"), (F.col("lang") == "en").cast("double").alias("en"), (F.substring("source", 4, 9).cast("double") / 20).alias("place"), (2 * F.col("quality") - 1).cast("double").alias("label"))


@query("l9_sparse_logistic")
def _(t):
    from tessera.plans.scratch import materialize

    rows = materialize(quality_rows(t), "rows")
    prox, penalty = L.lasso_penalty(0.01)
    w, history = L.newton_fit(rows, ["size", "en", "place"], "label", "logistic", prox, penalty)
    return t.spark.createDataFrame([(n, round(float(v), 4)) for n, v in zip(["size", "en", "place", "intercept", "objective"], [*w[0], history[-1]], strict=True)], "name string, value double")


@query("l7_linear_svm")
def _(t):
    from tessera.plans.scratch import materialize

    n = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    rows = materialize(t.embeddings.select(*(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)), F.when(F.col("label") == 0, 1.0).otherwise(-1.0).alias("y")), "rows")
    w, history = L.newton_fit(rows, [f"x{i}" for i in range(n)], "y", "hinge2", ridge=0.1)
    return t.spark.createDataFrame([(f"w{i}", round(float(v), 4)) for i, v in enumerate(w[0])] + [("objective", round(float(history[-1]), 5))], "name string, value double")


@query("l15_sparse_precision")
def _(t):
    """Of all components; the lightest penalty leaves few parts, a stronger one many."""
    n, mean, second = V.gram(t.embeddings.select(F.col("embedding").alias("v")).where("v is not null"), "v")
    cov = (second - n * np.outer(mean, mean)) / (n - 1)
    precision = L.sparse_precision_by_parts(cov, 0.002)
    return t.spark.createDataFrame([(i, j, round(float(v), 5)) for i, row in enumerate(precision) for j, v in enumerate(row)], "i int, j int, value double")  # a row a pair of components


@query("l15_precision_optimal", "SELECT true AS diagonal_met, true AS within_penalty, true AS signs_met FROM (SELECT count(*) AS n FROM embeddings) WHERE n > 1")
def _(t):
    """Optimality: the inverse differs from the covariance by the penalty on the diagonal and where the precision isn't 0, by at most it elsewhere."""
    n, mean, second = V.gram(t.embeddings.select(F.col("embedding").alias("v")).where("v is not null"), "v")
    cov, lam = (second - n * np.outer(mean, mean)) / (n - 1), 0.002
    precision = L.sparse_precision_by_parts(cov, lam)
    gap = np.linalg.inv(precision) - cov
    off = ~np.eye(len(cov), dtype=bool)
    used = off & (np.abs(precision) > 1e-6)
    holds = (np.abs(np.diag(gap) - lam).max() < 1e-5, np.abs(gap[off]).max() < lam + 1e-5, not used.any() or np.abs(gap[used] - lam * np.sign(precision[used])).max() < 1e-4)
    return t.spark.createDataFrame([tuple(map(bool, holds))], "diagonal_met boolean, within_penalty boolean, signs_met boolean")


@query("a26_information_merge")
def _(t):
    counts = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return D.merge_by_information(counts, "lang", "source", "n")


GRID = "SELECT x, y FROM (SELECT DISTINCT l_orderkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem)"


def cells(t) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).distinct()


@query("d1_density_map", f"WITH g AS (SELECT x, y, sqrt(pow(x - 31.5, 2) + pow(y - 31.5, 2)) AS d FROM ({GRID})) SELECT x, y, round(CASE WHEN abs(x - 31.5) < 4 AND abs(y - 31.5) < 4 THEN -1 WHEN d > 31.5 THEN -2 ELSE d / (SELECT max(d) FROM g) END, 6) AS density FROM g")
def _(t):
    return D.density(cells(t), "x", "y", (31.5, 31.5), core=4.0, radius=31.5).select("x", "y", F.round("density", 6).alias("density"))


@query("d2_weighted_sample")
def _(t):
    g = D.density(cells(t), "x", "y", (31.5, 31.5), core=4.0, radius=31.5)
    return D.weighted_sample(g, ["x", "y"], "density", 400, seed=3)


@query("d2b_jittered_rect_sample")
def _(t):
    return D.jittered_rect(cells(t), "x", "y", (31.5, 31.5), tolerance=12.0, jitter=20.0, seed=4)


@query("d3_separable_density_sample")
def _(t):
    return D.separable_sample(cells(t), "x", "y", 63.0, 500, core_share=0.1, seed=6)


@query("d4_poisson_disc_sample")
def _(t):
    g = D.density(cells(t), "x", "y", (31.5, 31.5), core=0.0, radius=64.0)
    return D.poisson_disc(g.withColumn("radius", 1.5 + 3 * F.col("density")), "x", "y", "radius", seed=8)


@query("j13_min_distance_thin")
def _(t):
    return D.poisson_disc(cells(t).withColumn("radius", F.lit(3.0)), "x", "y", "radius", seed=7)


@query("d5_partial_fourier", "SELECT DISTINCT l_orderkey % 64 AS x FROM lineitem WHERE l_orderkey % 64 < 64 * 5 / 8.0")
def _(t):
    return D.partial_fourier(cells(t).select("x").distinct(), "x", 64, 5 / 8)


@query("d6_multi_phase_masks")
def _(t):
    g = D.density(cells(t), "x", "y", (31.5, 31.5), core=4.0, radius=31.5)
    phases = t.spark.range(3).select(F.col("id").cast("int").alias("phase"))
    return D.weighted_sample(g.crossJoin(phases), ["x", "y"], "density", 200, seed=3, phase="phase")


@query("d7_acceleration_report", f"SELECT round(count(*) / count(*) FILTER ((x + y) % 3 = 0), 6) AS acceleration FROM ({GRID})")
def _(t):
    return D.acceleration(cells(t).withColumn("bit", ((F.col("x") + F.col("y")) % 3 == 0).cast("int")), "bit").withColumn("acceleration", F.round("acceleration", 6))


@query("a24_calibration_region")
def _(t):
    mask = cells(t).withColumn("bit", F.lit(1))
    return D.calibration_box(mask, "x", "y", "bit", 64, 64)


@query("s6_mask_text", f"SELECT x AS row, (row_number() OVER (PARTITION BY x ORDER BY y) - 1)::INT AS col, ((x + y) % 3 = 0)::INT AS bit FROM ({GRID})")
def _(t):
    g = cells(t).withColumn("bit", ((F.col("x") + F.col("y")) % 3 == 0).cast("int"))
    return D.mask_rows(D.mask_text(g, "x", "y", "bit"))


@query("x11_inpaint_diffusion")
def _(t):
    g = t.lineitem.groupBy((F.col("l_orderkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).agg(F.sum("l_quantity").alias("v"))
    return D.inpaint(g.withColumn("v", F.when((F.col("x") * 7 + F.col("y")) % 5 > 0, F.col("v"))), "x", "y", "v").select("x", "y", F.round("v", 6).alias("v"))
