"""Arrays, transforms, neighbours, clusters and encoders over embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators import forest as K
from tessera.operators import transforms as T
from tessera.operators import vectors as V

from .registry import query
from .scratch import materialize

E = "CAST(embedding AS DOUBLE[])"


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def total(values):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def weighed(values):
    """A number that tells arrays and their order apart."""
    return F.round(total(F.transform(values, lambda v, i: v * (i + 1))), 6)


def weighed_sql(values: str) -> str:
    return f"round(list_sum(list_transform({values}, lambda v, i: v * i)), 6)"


@query("f9_oversampling_crop", f"SELECT vec_id, {weighed_sql(E + '[17:48]')} AS y FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", weighed(F.slice(F.col("embedding").cast("array<double>"), 17, 32)).alias("y"))


@query("f10_center_crop_pad", f"SELECT vec_id, {weighed_sql(E + '[23:42]')} AS crop, {weighed_sql(f'list_concat(list_concat(list_transform(range(8), lambda i: 0.0::DOUBLE), {E}), list_transform(range(8), lambda i: 0.0::DOUBLE))')} AS pad FROM embeddings")
def _(t):
    e = F.col("embedding").cast("array<double>")
    zeros = F.array_repeat(F.lit(0.0), 8)
    return t.embeddings.select("vec_id", weighed(F.slice(e, 23, 20)).alias("crop"), weighed(F.concat(zeros, e, zeros)).alias("pad"))


@query("f11_flip_reverse", f"SELECT vec_id, {weighed_sql(f'CASE WHEN (vec_id >> 2) & 1 = 1 THEN list_reverse({E}) ELSE {E} END')} AS y FROM embeddings")
def _(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", weighed(F.when(bits.bit(F.col("vec_id"), 2), F.reverse(e)).otherwise(e)).alias("y"))


@query("f12_quadrant_shift", f"SELECT vec_id, {weighed_sql(f'list_concat({E}[33:], {E}[:32])')} AS half, {weighed_sql(f'list_concat({E}[60:], {E}[:59])')} AS shifted FROM embeddings")
def _(t):
    e = F.col("embedding").cast("array<double>")

    def rolled(by):
        return F.concat(F.slice(e, 64 - by + 1, by), F.slice(e, 1, 64 - by))

    return t.embeddings.select("vec_id", weighed(rolled(32)).alias("half"), weighed(rolled(5)).alias("shifted"))


@query("t4_stream_slice", "SELECT vec_id, r AS row, round(list_sum(CAST(embedding AS DOUBLE[])[r * 8 + 1 : r * 8 + 8]), 6) AS total FROM embeddings, range(8) g(r)")
def _(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"))
    return rows.select("vec_id", F.col("row").cast("long").alias("row"), F.round(total(F.slice("e", F.col("row") * 8 + 1, F.lit(8))), 6).alias("total"))


@query("x1_dft", f"WITH e AS (SELECT vec_id, {E} AS e FROM embeddings) SELECT vec_id, k, round(list_sum(list_transform(e, lambda v, i: v * cos(2 * pi() * k * (i - 1) / 64))), 6) AS re, round(-list_sum(list_transform(e, lambda v, i: v * sin(2 * pi() * k * (i - 1) / 64))), 6) AS im FROM e, range(64) g(k)")
def _(t):
    """All coefficients of x1_dft."""
    out = T.dft(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e")
    rows = out.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


@query("x2_band_power", f"WITH e AS (SELECT vec_id, {E} AS e FROM embeddings), k AS (SELECT vec_id, pow(list_sum(list_transform(e, lambda v, i: v * cos(2 * pi() * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(e, lambda v, i: v * sin(2 * pi() * k * (i - 1) / 64))), 2) AS p FROM e, range(13, 22) g(k)) SELECT vec_id, round(sum(p), 6) AS power FROM k GROUP BY 1")
def _(t):
    out = T.band_power(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", 0.2, 1 / 3, 1.0)
    return out.select("vec_id", F.round("power", 6).alias("power"))


@query("x4_bandpass")
def _(t):
    out = T.bandpass(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", 0.1, 0.3)
    return out.select("vec_id", weighed(F.col("filtered")).alias("y"))


@query("x5_haar_levels", f"WITH e AS (SELECT vec_id, {E} AS e FROM embeddings), a AS (SELECT vec_id, list_transform(range(32), lambda i: (e[2 * i + 1] + e[2 * i + 2]) / sqrt(2)) AS low, list_transform(range(32), lambda i: (e[2 * i + 1] - e[2 * i + 2]) / sqrt(2)) AS high FROM e), b AS (SELECT vec_id, high, list_transform(range(16), lambda i: (low[2 * i + 1] + low[2 * i + 2]) / sqrt(2)) AS low2, list_transform(range(16), lambda i: (low[2 * i + 1] - low[2 * i + 2]) / sqrt(2)) AS high2 FROM a) SELECT vec_id, {weighed_sql('high')} AS d1, {weighed_sql('high2')} AS d2, {weighed_sql('low2')} AS a2 FROM b")
def _(t):
    low, high = T.haar_step(F.col("e"))
    one = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", low.alias("low"), high.alias("high"))
    low2, high2 = T.haar_step(F.col("low"))
    return one.select("vec_id", weighed(F.col("high")).alias("d1"), weighed(high2).alias("d2"), weighed(low2).alias("a2"))


D4 = T.DAUBECHIES4
LOW = " + ".join(f"e[(2 * k + {j}) % 64 + 1] * {h!r}" for j, h in enumerate(D4))
HIGH = " + ".join(f"e[(2 * k + {j}) % 64 + 1] * {(-1) ** j * h!r}" for j, h in enumerate(reversed(D4)))


@query("x6_daubechies_step", f"WITH e AS (SELECT vec_id, {E} AS e FROM embeddings) SELECT vec_id, {weighed_sql(f'list_transform(range(32), lambda k: {LOW})')} AS low, {weighed_sql(f'list_transform(range(32), lambda k: {HIGH})')} AS high FROM e")
def _(t):
    low, high = T.wavelet_step(F.col("e"))
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", weighed(low).alias("low"), weighed(high).alias("high"))


@query("x7_wavelet_denoise")
def _(t):
    out = T.wavelet_denoise(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e")
    return out.select("vec_id", weighed(F.col("denoised")).alias("y"))


@query("x8_dct", f"WITH e AS (SELECT vec_id, {E} AS e FROM embeddings) SELECT vec_id, k, round(CASE WHEN k = 0 THEN sqrt(1 / 64.0) ELSE sqrt(2 / 64.0) END * list_sum(list_transform(e, lambda v, i: v * cos(pi() * (2 * (i - 1) + 1) * k / 128))), 6) AS y FROM e, range(64) g(k)")
def _(t):
    rows = t.embeddings.select("vec_id", F.posexplode(T.dct(F.col("embedding"), 64)).alias("k", "y"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.round("y", 6).alias("y"))


@query("x9_tv_denoise")
def _(t):
    out = T.tv_denoise(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", 0.05)
    return out.select("vec_id", weighed(F.col("denoised")).alias("y"))


@query("x10_shift_match", f"WITH e AS (SELECT vec_id, {E} AS e FROM embeddings), r AS (SELECT e AS r FROM e ORDER BY vec_id DESC LIMIT 1), c AS (SELECT vec_id, s, round(list_sum(list_transform(range(64), lambda i: pow(e[(i + s + 64) % 64 + 1] - r[i + 1], 2))), 9) AS cost FROM e, r, range(-4, 5) g(s)) SELECT vec_id, arg_min(s, (cost, abs(s), s))::INT AS shift, round(min(cost), 6) AS cost FROM c GROUP BY 1")
def _(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return T.best_shift(e, "vec_id", "e", e.orderBy(F.desc("vec_id")).limit(1), 4).withColumn("cost", F.round("cost", 6))


@query("x10_shift_align")
def _(t):
    """The vectors of x10_shift_match, each moved by its shift."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    shifts = T.best_shift(e, "vec_id", "e", e.orderBy(F.desc("vec_id")).limit(1), 4)
    return T.align(e, "vec_id", "e", shifts).select("vec_id", "shift", weighed(F.col("e")).alias("y"))


POINTS = f"v AS (SELECT vec_id AS id, {E} AS v, label FROM embeddings)"
METRICS = {
    "l2": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: pow(p[1] - p[2], 2)))",
    "l1": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))",
    "linf": "list_max(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))",
    "kl2": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))",
}
ABS = f"v AS (SELECT vec_id AS id, list_transform({E}, lambda x: abs(x)) AS v FROM embeddings)"
POSITIVE = {
    "chi2": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: CASE WHEN p[1] + p[2] > 0 THEN pow(p[1] - p[2], 2) / (p[1] + p[2]) ELSE 0 END))",
    "hell": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: pow(sqrt(p[1]) - sqrt(p[2]), 2)))",
    "kl1": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: least(p[1], p[2])))",
    "kchi2": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: CASE WHEN p[1] + p[2] > 0 THEN 2 * p[1] * p[2] / (p[1] + p[2]) ELSE 0 END))",
    "khell": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: sqrt(p[1] * p[2])))",
}


def asked(df):
    """The stated query set: ids divisible by 20."""
    return df.where("id % 20 = 0")


for metric, text in {**METRICS, **POSITIVE}.items():
    source = ABS if metric in POSITIVE else POINTS

    @query(f"j9_pairwise_{metric}", f"WITH {source} SELECT a.id AS a, b.id AS b, round({text}, 6) AS distance FROM v a, v b WHERE a.id % 20 = 0")
    def _(t, metric=metric):
        v = vectors(t)
        v = v.withColumn("vector", F.transform("vector", lambda x: F.abs(x))) if metric in POSITIVE else v
        return V.pairwise(asked(v), v, metric).withColumn("distance", F.round("distance", 6))


KNN = f"{POINTS}, d AS (SELECT a.id AS a, b.id AS b, {METRICS['l2']} AS distance FROM v a, v b WHERE a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(distance, 9), b) AS rank FROM d)"


@query("j10_knn_exact", f"WITH {KNN} SELECT a, b, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5")
def _(t):
    v = vectors(t)
    return V.nearest(asked(v), v, 5).withColumn("distance", F.round("distance", 6))


@query("j12_ratio_match", f"WITH {POINTS}, d AS (SELECT a.id AS a, b.id AS b, {METRICS['l2']} AS distance FROM v a, v b WHERE a.label % 2 = 0 AND b.label % 2 = 1 AND a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(distance, 9), b) AS rank FROM d), m AS (SELECT a, arg_min(b, rank) AS b, min(distance) AS distance, max(distance) AS second FROM r WHERE rank <= 2 GROUP BY 1) SELECT a, b, round(distance, 6) AS distance FROM m WHERE distance * 1.05 <= second")
def _(t):
    v = vectors(t)
    return V.ratio_match(asked(v).where("label % 2 = 0"), v.where("label % 2 = 1"), 1.05).withColumn("distance", F.round("distance", 6))


@query("j11_knn_approx")
def _(t):
    """By a tree of split planes, with three quarters of the rows as each query's budget: these vectors point in all directions
    alike, so that bins say little, and less finds too few of the true neighbours."""
    v = vectors(t).select("id", "vector")
    return K.nearest_in_forest(asked(v), v, 5, max_comparisons=v.count() * 3 // 4, trees=1).select("a", "b", F.round(F.sqrt("distance"), 6).alias("distance"))


@query("j11_budget_kept", f"WITH {POINTS} SELECT count(*) FILTER (id % 20 = 0) AS queries, true AS within_budget, true AS recall_reached, true AS distances_true FROM v")
def _(t):
    """Whether every query of the approximate search stays in its budget, nine tenths of the true neighbours are found, and the
    distances that it gives are those of the exact search."""
    v = vectors(t).select("id", "vector")
    budget = v.count() * 3 // 4
    got = materialize(K.nearest_in_forest(asked(v), v, 5, budget, trees=1), "approximate")
    true = materialize(V.nearest(asked(v), v, 5), "exact")
    both = true.alias("t").join(got.alias("g"), (F.col("t.a") == F.col("g.a")) & (F.col("t.b") == F.col("g.b")), "left")
    recall = both.agg((F.count("g.a") >= 0.9 * F.count("*")).alias("recall_reached"), F.coalesce(F.bool_and(F.abs(F.col("t.distance") - F.col("g.distance")) < 1e-9), F.lit(True)).alias("distances_true"))
    kept = got.agg(F.count_distinct("a").alias("queries"), (F.max("comparisons") <= budget).alias("within_budget"))
    return kept.crossJoin(recall).select("queries", "within_budget", "recall_reached", "distances_true")  # single rows


def first_centres(t, k: int = 8) -> list[list[float]]:
    return [list(r[0]) for r in vectors(t).orderBy("id").limit(k).select("vector").collect()]  # k rows


CENTRES = f"{POINTS}, c AS (SELECT id AS k, v AS c FROM v ORDER BY id LIMIT 8), d AS (SELECT v.id, v.label, v.v, k, list_sum(list_transform(list_zip(v.v, c.c), lambda p: pow(p[1] - p[2], 2))) AS distance FROM v, c), own AS (SELECT id, any_value(label) AS label, any_value(v) AS v, arg_min(k, (distance, k)) AS cluster, min(distance) AS distance FROM d GROUP BY id)"


@query("l3_assign_nearest", f"WITH {CENTRES} SELECT id, cluster::INT AS cluster, round(distance, 6) AS distance FROM own")
def _(t):
    return V.assign(vectors(t), "vector", first_centres(t)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query("l1_kmeans_step", f"WITH {CENTRES}, m AS (SELECT cluster, g.i, avg(v[g.i + 1]) AS x FROM own, range(64) g(i) GROUP BY ALL) SELECT cluster::INT AS cluster, i::INT AS dim, round(x, 6) AS x FROM m")
def _(t):
    centres, _energy = V.kmeans_l2(vectors(t), "vector", first_centres(t), steps=1)
    rows = [(c, d, float(x)) for c, row in enumerate(centres) for d, x in enumerate(row)]  # clusters x dims
    return t.spark.createDataFrame(rows, "cluster int, dim int, x double").withColumn("x", F.round("x", 6))


@query("l1_kmeans")
def _(t):
    v = vectors(t)
    centres, _energy = V.kmeans_l2(v, "vector", V.plus_plus(v, "vector", "id", 10), steps=10)
    return V.assign(v, "vector", centres).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query("l1_kmeans_median")
def _(t):
    """l1_kmeans by L1 distance, with medians as centres."""
    v = vectors(t)
    centres, _energy = V.kmeans_l1(v, "vector", V.plus_plus(v, "vector", "id", 10), steps=10)
    return V.assign_l1(v, "vector", centres).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query("l2_hierarchical_kmeans")
def _(t):
    return V.hierarchical(vectors(t), "vector", "id", branch=3, depth=2).select("id", F.array_join("path", "/").alias("path"))


@query("l5_vlad_encode", f"WITH {CENTRES}, s AS (SELECT label, cluster, g.i, sum(own.v[g.i + 1] - c.c[g.i + 1]) AS x FROM own JOIN c ON c.k = own.cluster, range(64) g(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY 1) SELECT label, cluster::INT AS cluster, i::INT AS dim, round(x / n, 6) AS value FROM s JOIN n USING (label)")
def _(t):
    return V.vlad(vectors(t), "label", "vector", first_centres(t)).withColumn("value", F.round("value", 6))


FISHER = f"""WITH {POINTS}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, v AS c FROM (SELECT * FROM v ORDER BY id LIMIT 4)),
l AS (SELECT v.id, label, k, v, c, -0.5 * list_sum(list_transform(list_zip(v, c), lambda p: pow(p[1] - p[2], 2) / 0.02)) AS l FROM v, c),
m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM l), q AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS q FROM m), n AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
z AS (SELECT label, k, i, q, (v[i + 1] - c[i + 1]) / sqrt(0.02) AS z FROM q, range(64) g(i)),
f AS (SELECT label, k::INT AS cluster, i::INT AS dim, sum(q * z) / (any_value(n) * 0.5) AS u, sum(q * (z * z - 1)) / (any_value(n) * sqrt(0.5)) AS v FROM z JOIN n USING (label) GROUP BY label, k, i)"""


@query("l6_fisher_encode", f"{FISHER} SELECT label, cluster, dim, round(u, 6) AS u, round(v, 6) AS v FROM f")
def _(t):
    centres = first_centres(t, 4)
    return V.fisher(vectors(t), "label", "vector", centres, [[0.02] * 64] * 4, [0.25] * 4).select("label", "cluster", "dim", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("a19_covariance", f"WITH {POINTS}, x AS (SELECT id, i, v[i + 1] AS x FROM v, range(64) g(i)) SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM x a JOIN x b USING (id) GROUP BY 1, 2")
def _(t):
    return V.covariance(vectors(t), "vector").withColumn("cov", F.round("cov", 8))


@query("a20_pca_project")
def _(t):
    out, _modes, _values = V.pca(vectors(t), "vector", 4)
    return out.select("id", *(F.round(F.col("projected")[i], 6).alias(f"p{i}") for i in range(4)))


@query("a21_singular_values")
def _(t):
    n, mean, second = V.gram(vectors(t), "vector")
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(second)[::-1][:6], 0))
    return t.spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "mode int, value double").withColumn("value", F.round("value", 6))


def kernel_sql(kernel: str, order: int = 2, period: float = 0.6) -> str:
    """The features of vectors.kernel_map in a row, weighed."""
    spectrum = [period * V.SPECTRA[kernel](j * period) for j in range(order + 1)]
    parts = [f"sign(x) * sqrt(abs(x) * {spectrum[0]!r})"]
    for j in range(1, order + 1):
        parts += [f"sign(x) * sqrt(2 * abs(x) * {spectrum[j]!r}) * {f}({j * period!r} * ln(greatest(abs(x), 1e-300)))" for f in ("cos", "sin")]
    return f"SELECT vec_id AS id, {weighed_sql(f'flatten(list_transform({E}, lambda x: [{chr(44).join(parts)}]))')} AS y FROM embeddings"


@query("c11_kernel_map", kernel_sql("chi2"))
def _(t):
    return vectors(t).select("id", weighed(V.kernel_map(F.col("vector"), 2)).alias("y"))


for kernel in ("intersection", "js"):

    @query(f"c11_kernel_map_{kernel}", kernel_sql(kernel))
    def _(t, kernel=kernel):
        return vectors(t).select("id", weighed(V.kernel_map(F.col("vector"), 2, kernel=kernel)).alias("y"))




@query("l16_quick_shift", "WITH p AS (SELECT min(vec_id) AS id, round(embedding[1]::DOUBLE * 10, 2) AS x, round(embedding[2]::DOUBLE * 10, 2) AS y FROM embeddings GROUP BY 2, 3), d AS (SELECT a.id AS a, b.id AS b, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2 FROM p a, p b), k AS (SELECT a, round(sum(exp(-d2 / 0.5)) FILTER (d2 <= 2.25), 9) AS density FROM d GROUP BY 1), m AS (SELECT d.a, arg_min(d.b, (d2, d.b)) AS parent FROM d JOIN k x ON x.a = d.a JOIN k y ON y.a = d.b WHERE d2 <= 1 AND (y.density > x.density OR (y.density = x.density AND d.b < d.a)) GROUP BY 1) SELECT k.a AS id, round(k.density, 6) AS density, parent FROM k LEFT JOIN m ON m.a = k.a")
def _(t):
    e = t.embeddings.select("vec_id", *(F.round(F.col("embedding")[i].cast("double") * 10, 2).alias(c) for i, c in enumerate("xy")))
    p = e.groupBy("x", "y").agg(F.min("vec_id").alias("id"))
    return V.quick_shift(p, "id", "x", "y", sigma=0.5, reach=1.0).withColumn("density", F.round("density", 6))


def pca_links(t):
    """(id, density, parent) of all vectors in their plane of two principal components; vectors at one place are shifted once, with their number as weight."""
    e, _modes, _values = V.pca(vectors(t).where("vector is not null"), "vector", 2)
    e = e.select("id", *(F.round(F.col("projected")[i] * 10, 2).alias(c) for i, c in enumerate("xy")))
    p = materialize(e.groupBy("x", "y").agg(F.min("id").alias("first"), F.count("*").alias("n")), "places")
    links = V.quick_shift(p, "first", "x", "y", sigma=0.5, reach=1.0, weight="n")
    every = e.join(p.join(links, "first"), ["x", "y"])
    return every.select("id", F.round("density", 6).alias("density"), F.when(F.col("id") == F.col("first"), F.col("parent")).otherwise(F.col("first")).alias("parent"))


@query("l16_quick_shift_pca")
def _(t):
    return pca_links(t)


@query("l16_quick_shift_roots")
def _(t):
    return V.roots(pca_links(t), "id")


@query("l4_gmm_diag")
def _(t):
    out, _modes, _values = V.pca(vectors(t), "vector", 4)
    points = out.select("id", "projected")
    start = [list(r[0]) for r in points.orderBy("id").limit(3).select("projected").collect()]  # 3 rows
    means, variances, weights, _likelihood = V.gmm_diag(points, "projected", start, [[0.05] * 4] * 3, [1 / 3] * 3, steps=8)
    rows = [(k, d, float(means[k][d]), float(variances[k][d]), float(weights[k])) for k in range(3) for d in range(4)]  # components x dims
    return t.spark.createDataFrame(rows, "component int, dim int, mean double, variance double, weight double").select("component", "dim", *(F.round(c, 6).alias(c) for c in ("mean", "variance", "weight")))


@query("x3_dominant_component")
def _(t):
    rows = t.embeddings.select(F.col("label").alias("series"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("v"))
    return T.dominant_component(rows, "v", 4, 0.1, 0.3, 1.0).select("series", "component", F.round("amplitude", 6).alias("amplitude"))


@query("s8_series_sink", "SELECT printf('%s_%04d', regexp_replace(replace(concat_ws(' ', source, lang), ' ', '_'), '[*<>/&%$=+]', '', 'g'), CAST(substring(source, 4, 9) AS INT)) AS series, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(t):
    """Each series in its own folder, read back."""
    from tessera.operators import records as R
    from tessera.plans.scratch import scratch_path

    path = scratch_path(t.spark, "series")
    named = t.documents.select("doc_id", "n_chars", R.path_safe(F.concat_ws(" ", "source", "lang"), F.substring("source", 4, 9)).alias("series"))
    named.write.partitionBy("series").parquet(path)
    return t.spark.read.parquet(path).groupBy("series").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s5_mask_text_scan", "SELECT x AS row, (row_number() OVER (PARTITION BY x ORDER BY y) - 1)::INT AS col, ((x + y) % 3 = 0)::INT AS bit FROM (SELECT DISTINCT l_orderkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem)")
def _(t):
    """A mask written as text lines and scanned back."""
    from tessera.operators import sampling as D
    from tessera.plans.scratch import scratch_path

    path = scratch_path(t.spark, "mask")
    mask = t.lineitem.select((F.col("l_orderkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).distinct().withColumn("bit", ((F.col("x") + F.col("y")) % 3 == 0).cast("int"))
    lines = D.mask_text(mask, "x", "y", "bit")
    lines.select(F.format_string("%06d %s", F.col("row"), F.col("line")).alias("value")).orderBy("value").write.text(path)
    text = t.spark.read.text(path)
    return D.mask_rows(text.select(F.substring("value", 1, 6).cast("long").alias("row"), F.substring("value", 8, 1 << 20).alias("line")))
