"""Options and variants of the operators: encoder norms, surrogate totals, shares of rows, inverse transforms, other kinds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import bins as B
from tessera.operators import curves as C
from tessera.operators import lanczos as Z
from tessera.operators import records as R
from tessera.operators import sampling as D
from tessera.operators import similarity as M
from tessera.operators import transforms as T
from tessera.operators import vectors as V
from tessera.sources.folders import folder_manifest
from tessera.streaming import stages as S

from .q_learning import GRID, cells
from .q_series import COUNTED, scores
from .q_similarity import MOMENTS_SQL, PAIRS, pairs
from .q_vectors import CENTRES, FISHER, POINTS, E, asked, first_centres, vectors, weighed, weighed_sql
from .registry import query
from .scratch import materialize, scratch_path


@query("j9_pairwise_l0", f"WITH {POINTS.replace('{E}', 'x')}, r AS (SELECT id, list_transform(v, lambda x: round(x, 1)) AS v FROM v) SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] <> p[2])::INT))::DOUBLE AS distance FROM r a, r b WHERE a.id % 20 = 0")
def _(t):
    """How many components differ, of vectors rounded to tenths."""
    v = vectors(t).select("id", F.transform("vector", lambda x: F.round(x.cast("double"), 1)).alias("vector"))
    return V.pairwise(asked(v), v, "l0")


SHARES = f"WITH {CENTRES}, s AS (SELECT label, cluster, g.i, sum(own.v[g.i + 1] - c.c[g.i + 1]) AS x, count(*) AS m FROM own JOIN c ON c.k = own.cluster, range(64) g(i) GROUP BY ALL)"


@query("l5_vlad_mass", f"{SHARES}, y AS (SELECT *, x / m AS y FROM s), n AS (SELECT label, cluster, sqrt(sum(y * y)) AS n FROM y GROUP BY ALL) SELECT label, cluster::INT AS cluster, i::INT AS dim, round(CASE WHEN n > 0 THEN y / n ELSE 0 END, 6) AS value FROM y JOIN n USING (label, cluster)")
def _(t):
    """Sums over the number of vectors, each cluster scaled to norm 1."""
    return V.vlad(vectors(t), "label", "vector", first_centres(t), normalise=False, mass=True, per_component=True).withColumn("value", F.round("value", 6))


@query("l5_vlad_root", f"{SHARES}, y AS (SELECT *, sign(x) * sqrt(abs(x)) AS y FROM s), n AS (SELECT label, sqrt(sum(y * y)) AS n FROM y GROUP BY ALL) SELECT label, cluster::INT AS cluster, i::INT AS dim, round(y / n, 6) AS value FROM y JOIN n USING (label)")
def _(t):
    return V.vlad(vectors(t), "label", "vector", first_centres(t), root=True).withColumn("value", F.round("value", 6))


@query("l6_fisher_improved", f"{FISHER}, r AS (SELECT label, cluster, dim, sign(u) * sqrt(abs(u)) AS u, sign(v) * sqrt(abs(v)) AS v FROM f), w AS (SELECT label, sqrt(sum(u * u + v * v)) AS w FROM r GROUP BY 1) SELECT label, cluster, dim, round(u / w, 6) AS u, round(v / w, 6) AS v FROM r JOIN w USING (label)")
def _(t):
    """Signed square roots, each label scaled to norm 1."""
    return V.fisher(vectors(t), "label", "vector", first_centres(t, 4), [[0.02] * 64] * 4, [0.25] * 4, normalise=True, root=True).select("label", "cluster", "dim", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("l4_gmm_posteriors")
def _(t):
    """Shares of a mixture that starts at the clusters of the first centres and takes three steps."""
    v = vectors(t)
    means, variances, weights = V.gmm_start(v, "vector", first_centres(t, 4))
    means, variances, weights, _ = V.gmm_diag(v, "vector", means, variances, weights, steps=3)
    return v.where("vector is not null").select("id", F.posexplode(V.posteriors("vector", means, variances, weights)).alias("component", "share")).withColumn("share", F.round("share", 6))


@query("l1_kmeans_repeated")
def _(t):
    """The best of three starts."""
    v = vectors(t)
    centres, _ = V.kmeans_repeated(v, "vector", "id", 10, 8, 3)
    return V.assign(v, "vector", centres).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query("a20_pca_filter")
def _(t):
    """Vectors restored from the modes that hold nine tenths of the variance, without the first."""
    v = vectors(t).where("vector is not null")
    mean, modes, values = V.principal(v, "vector")
    k = V.modes_for(values, 0.9)
    restored = V.pca_back(V.project(v, "vector", modes, mean), "projected", modes, mean, keep=list(range(1, k)))
    return restored.select("id", F.lit(k).alias("modes"), weighed(F.col("restored")).alias("y"))


@query("a20_pca_round_trip", f"SELECT vec_id AS id, {weighed_sql(E)} AS y FROM embeddings")
def _(t):
    """Forward and back over all modes gives the vectors again."""
    v = vectors(t).where("vector is not null")
    mean, modes, _values = V.principal(v, "vector")
    return V.pca_back(V.project(v, "vector", modes, mean), "projected", modes, mean).select("id", weighed(F.col("restored")).alias("y"))


@query("a21_singular_vectors")
def _(t):
    """Coordinates of each row on the six leading left singular vectors; seven steps of eight directions span all components."""
    out, _values, _right = Z.block_lanczos(vectors(t), "id", "vector", 6, its=7)
    return out.select("id", *(F.round(F.col("u")[i], 6).alias(f"u{i}") for i in range(6)))


@query("a21_block_lanczos", "SELECT count(*) FILTER (embedding IS NOT NULL) AS n, true AS orthonormal, true AS exact_when_full, true AS nearly_optimal FROM embeddings")
def _(t):
    """Whether left vectors are orthonormal, a full basis gives the singular values of the Gramian, and four steps of eight
    directions catch 97 hundredths of what six modes can hold."""
    v = vectors(t)
    out, values, _right = Z.block_lanczos(v, "id", "vector", 6, its=4)
    whole = Z.block_lanczos(v, "id", "vector", 6, its=7)[1]
    true = np.sqrt(np.maximum(np.linalg.eigvalsh(V.gram(v, "vector")[2])[::-1][:6], 0))
    products = out.select(F.lit(1).alias("n"), *(F.col("u")[i].alias(f"u{i}") for i in range(6))).agg(F.sum("n").alias("n"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"p{i}{j}") for i in range(6) for j in range(i, 6)))
    unit = [F.abs(F.col(f"p{i}{j}") - float(i == j)) < 1e-8 for i in range(6) for j in range(i, 6)]
    return products.select("n", reduce(lambda a, b: a & b, unit).alias("orthonormal"), F.lit(bool(np.allclose(whole, true, rtol=1e-9))).alias("exact_when_full"), F.lit(bool((values**2).sum() >= 0.97 * (true**2).sum())).alias("nearly_optimal"))


@query("a24_full_extent", "SELECT 0 AS low_x, 63 AS high_x, 0 AS low_y, 63 AS high_y FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def _(t):
    return D.calibration_box(cells(t).withColumn("bit", F.lit(1)), "x", "y", "bit", 64, 64, outliers=-1.0)


@query("a27_mean_threshold", "WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT user_id, round(avg(abs(value - m)), 6) AS deviation, round(avg(abs(value - m)) / 0.6745, 6) AS threshold FROM events JOIN m USING (user_id) GROUP BY 1")
def _(t):
    """The mean form of the absolute deviation, and the threshold that it gives for normal noise."""
    centre = t.events.groupBy("user_id").agg(F.avg("value").alias("m"))
    mad = t.events.join(centre, "user_id").groupBy("user_id").agg(F.avg(F.abs(F.col("value") - F.col("m"))).alias("d"))
    return mad.select("user_id", F.round("d", 6).alias("deviation"), F.round(F.col("d") / 0.6745, 6).alias("threshold"))


@query("w17_surrogate_totals", f"WITH {COUNTED} SELECT rank, round(tp / 5000, 6) AS tpr, round(1 - fp / 20000, 6) AS tnr FROM c")
def _(t):
    return C.roc(scores(t), "label", "score", "doc_id", positives=5000.0, negatives=20000.0).select("rank", F.round("tpr", 6).alias("tpr"), F.round("tnr", 6).alias("tnr"))


@query("w19_pr_prior", f"WITH {COUNTED} SELECT rank, round(tp / p, 6) AS recall, round(CASE WHEN rank = 0 THEN 1 ELSE tp * 0.3 / p / (tp * 0.3 / p + fp * 0.7 / n) END, 6) AS precision FROM c, t")
def _(t):
    """Precision as it would be if three tenths were positive."""
    return C.pr(scores(t), "label", "score", "doc_id", prior=0.3).select("rank", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("k1_subset_share", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT (SELECT floor(count(*) * 0.01 + 0.5)::BIGINT FROM orders)")
def _(t):
    """The dearest hundredth of the orders, in the order of their keys."""
    return R.subset(t.orders.select("o_orderkey", "o_totalprice"), "largest", 0.01, ["o_totalprice", "o_orderkey"], place=["o_orderkey"])


@query("c12_taper_2d", "WITH g AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * (i // 8) / 7)) * (0.5 - 0.5 * cos(2 * pi() * (i % 8) / 7)))) AS y FROM embeddings) SELECT vec_id, round(y, 6) AS hann FROM g")
def _(t):
    """Embeddings as 8 by 8 grids under the product of two windows."""
    def weight(i):
        return special.taper_nd("hann", [(F.floor(i / 8).cast("double"), 8), ((i % 8).cast("double"), 8)])

    out = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * weight(i)), F.lit(0.0), lambda s, v: s + v)
    return t.embeddings.select("vec_id", F.round(out, 6).alias("hann"))


@query("c12_taper_kaiser")
def _(t):
    weighted = F.transform("embedding", lambda v, i: v.cast("double") * special.taper("kaiser", i.cast("double"), 64, beta=5.0))
    return t.embeddings.select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v), 6).alias("kaiser"))


KINDS = {
    "none": "d / (SELECT max(d) FROM g)",
    "point": "CASE WHEN d <= (SELECT min(d) FROM g) THEN -1 ELSE d / (SELECT max(d) FROM g) END",
    "block": "CASE WHEN abs(x - 31.5) < 4 AND abs(y - 31.5) < 4 THEN -1 ELSE d / (SELECT max(d) FROM g) END",
    "given": "CASE WHEN abs(x - 31.5) < 4 AND abs(y - 31.5) < 4 THEN -1 ELSE (x + y) / 126.0 END",
}


@query("d1_density_kinds", f"WITH g AS (SELECT x, y, sqrt(pow(x - 31.5, 2) + pow(y - 31.5, 2)) AS d FROM ({GRID})) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, x, y, round({v}, 6) AS density FROM g" for k, v in KINDS.items()))
def _(t):
    grid, out = cells(t).withColumn("own", (F.col("x") + F.col("y")) / 126.0), None
    for kind in KINDS:
        one = D.density(grid, "x", "y", (31.5, 31.5), core=4.0, radius=31.5, kind=kind, given="own").select(F.lit(kind).alias("kind"), "x", "y", F.round("density", 6).alias("density"))
        out = one if out is None else out.unionByName(one)
    return out


@query("x6_daubechies_inverse", f"SELECT vec_id, {weighed_sql(E)} AS y FROM embeddings")
def _(t):
    """One level forward and back gives the vectors again."""
    low, high = T.wavelet_step(F.col("e"))
    one = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", low.alias("low"), high.alias("high"))
    return one.select("vec_id", weighed(T.wavelet_inverse(F.col("low"), F.col("high"))).alias("y"))


def series(t):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query("x6_daubechies_2d", f"SELECT vec_id, round(list_sum(list_transform({E}, lambda v: v * v)), 6) AS energy, {weighed_sql(E)} AS y FROM embeddings")
def _(t):
    """Two levels over 8 by 8 grids keep the energy, and the way back gives the grids again."""
    there = T.wavelet_2d(series(t), "e", 8, levels=2)
    back = T.wavelet_2d(there, "coefficients", 8, levels=2, inverse=True, out="back")
    return back.select("vec_id", F.round(F.aggregate("coefficients", F.lit(0.0), lambda s, v: s + v * v), 6).alias("energy"), weighed(F.col("back")).alias("y"))


@query("x7_wavelet_undecimated")
def _(t):
    out = T.wavelet_denoise(series(t), "e", factor=3.6, hard=True, undecimated=True)
    return out.select("vec_id", weighed(F.col("denoised")).alias("y"))


@query("x9_tv_denoise_2d")
def _(t):
    return T.tv_denoise_2d(series(t), "e", 8, 0.05).select("vec_id", weighed(F.col("denoised")).alias("y"))


@query("x3_component_signal")
def _(t):
    """re - im of the dominant component's scores along each label's vectors."""
    rows = t.embeddings.where("embedding is not null").select(F.col("label").alias("series"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("e"))
    return T.component_signal(rows, "e", 4, 0.05, 0.3, 1.0).withColumn("signal", F.round("signal", 6))


CHANNELS = [c for c in MOMENTS_SQL if c not in ("mse", "cc", "zsad")]
HALVES = f"WITH {PAIRS}, q AS (SELECT line % 2 AS iteration, *, part % 4 AS channel FROM p), m AS (SELECT iteration, channel, avg(a) AS ma, avg(b) AS mb FROM q GROUP BY ALL)"


@query("m31_all_by_iteration", f"{HALVES} SELECT iteration, channel, {', '.join(f'round({MOMENTS_SQL[c]}, 4) AS {c}' for c in MOMENTS_SQL)} FROM q JOIN m USING (iteration, channel) GROUP BY ALL")
def _(t):
    """Every measure of moments for each iteration (here the lines' parity) and channel."""
    p = pairs(t).withColumns({"iteration": F.col("line") % 2, "channel": F.col("part") % 4})
    return M.moments(p, by=["iteration", "channel"]).select("iteration", "channel", *(F.round(c, 4).alias(c) for c in MOMENTS_SQL))


M31 = f"""WITH {PAIRS}, q AS (SELECT line % 2 AS iteration, (part % 4)::VARCHAR AS channel, line // 2 AS r, part // 4 AS c, a, b FROM p),
v AS (SELECT * FROM q UNION ALL SELECT iteration, 'combined', r, c, sqrt(sum(a * a)), sqrt(sum(b * b)) FROM q GROUP BY ALL),
k AS (SELECT i, j, exp(-(i * i + j * j) / 4.5) / sum(exp(-(i * i + j * j) / 4.5)) OVER () AS w FROM range(-5, 6) x(i), range(-5, 6) y(j)),
m AS (SELECT iteration, channel, r + i AS r, c + j AS c, count(*) AS n, sum(w * a) AS mx, sum(w * b) AS my, sum(w * a * a) AS xx, sum(w * b * b) AS yy, sum(w * a * b) AS xy FROM v, k GROUP BY ALL),
s AS (SELECT iteration, channel, avg((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225))) AS mssim FROM m WHERE n = 121 GROUP BY ALL),
ends AS (SELECT iteration, channel, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM v GROUP BY ALL),
j AS (SELECT iteration, channel, round((a - la) / (ha - la) * 15)::INT AS a, round((b - lb) / (hb - lb) * 15)::INT AS b, count(*) AS n FROM v JOIN ends USING (iteration, channel) GROUP BY ALL),
t AS (SELECT iteration, channel, sum(n) AS t FROM j GROUP BY ALL),
hab AS (SELECT iteration, channel, -sum(n / t * log2(n / t)) AS h FROM j JOIN t USING (iteration, channel) GROUP BY ALL),
ha AS (SELECT iteration, channel, -sum(n / t * log2(n / t)) AS h FROM (SELECT iteration, channel, a, sum(n) AS n FROM j GROUP BY ALL) JOIN t USING (iteration, channel) GROUP BY ALL),
hb AS (SELECT iteration, channel, -sum(n / t * log2(n / t)) AS h FROM (SELECT iteration, channel, b, sum(n) AS n FROM j GROUP BY ALL) JOIN t USING (iteration, channel) GROUP BY ALL),
d AS (SELECT iteration, channel, avg((a - b) * (a - b)) AS mse FROM v GROUP BY ALL)
SELECT d.iteration, d.channel, round(mse, 4) AS mse, round(mssim, 6) AS mssim, round((ha.h + hb.h) / hab.h, 6) AS snmi
FROM d JOIN s USING (iteration, channel) JOIN hab USING (iteration, channel) JOIN ha USING (iteration, channel) JOIN hb USING (iteration, channel)"""


@query("m31_structure_by_iteration", M31)
def _(t):
    """Error, structural similarity and shared information for each iteration and channel, and for the channels' root of sums of squares."""
    p = pairs(t).select((F.col("line") % 2).alias("iteration"), (F.col("part") % 4).cast("string").alias("channel"), F.floor(F.col("line") / 2).alias("r"), F.floor(F.col("part") / 4).alias("c"), "a", "b")
    root = {k: F.sqrt(F.sum(F.col(k) * F.col(k))).alias(k) for k in ("a", "b")}
    v = materialize(p.unionByName(p.groupBy("iteration", "r", "c").agg(*root.values()).withColumn("channel", F.lit("combined"))), "values")
    by = ["iteration", "channel"]
    out = M.moments(v, by=by).select(*by, F.round("mse", 4).alias("mse")).join(M.ssim(v, "r", "c", by=by).select(*by, F.round("mssim", 6).alias("mssim")), by)
    return out.join(M.entropies(B.joint_histogram(v, "a", "b", 16, by), by=by).select(*by, F.round("snmi", 6).alias("snmi")), by)


@query("s7_folder_manifest", "SELECT event_type AS series, 1::BIGINT AS files FROM events GROUP BY 1")
def _(t):
    """Events written to a folder for each type, and the folder's files by type."""
    folder = scratch_path(t.spark, "series")
    t.events.repartition("event_type").write.partitionBy("event_type").parquet(folder)
    found = folder_manifest(t.spark, folder, "*.parquet", r"^(part)-")
    return found.select(F.regexp_extract("folder", r"event_type=([^/]*)$", 1).alias("series"), "files")


@query("s10_append_sink", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def _(t):
    """A stream appended batch by batch, read back whole: a batch that is tried again replaces itself."""
    feed = S.replay(t.events.select("event_id", "event_type", "value"), "event_id", 3)
    kept = S.drained(feed.stream, feed)
    write = S.append_sink(folder := scratch_path(t.spark, "twice"))
    for _ in range(2):
        write(kept.drop("batch"), 0)
    again = t.spark.read.schema(kept.drop("batch").schema).parquet(folder)
    return again.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("t4_stream_slice_rows", f"SELECT vec_id, r AS row, round(list_sum(({E})[r * 8 + 1 : r * 8 + 8]), 6) AS total FROM embeddings, range(8) g(r)")
def _(t):
    """t4_stream_slice on a stream of vectors."""
    feed = S.replay(series(t), "vec_id", 3)
    rows = S.slices(feed.stream, "vec_id", "e", 8)
    rows = rows.select("vec_id", F.col("slice").cast("long").alias("row"), F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))
    return S.drained(rows, feed).drop("batch")


@query("t9_registered", "SELECT user_id, round(quantile_cont(value, 0.9), 6) AS high FROM events GROUP BY 1")
def _(t):
    """A function of a series registered by name and called from SQL."""
    def high(values: pd.Series) -> float:
        return float(values.quantile(0.9))

    S.register(t.spark, "series_high", high, "double")
    events = materialize(t.events.select("user_id", "value"), "events")
    return events.groupBy("user_id").agg(F.round(F.call_function("series_high", "value"), 6).alias("high"))


@query("t9_table_function", f"SELECT x AS row, y AS col, ((x + y) % 3 = 0)::INT AS bit FROM ({GRID})")
def _(t):
    """The cells of mask lines by a registered table function."""
    g = cells(t).withColumn("bit", ((F.col("x") + F.col("y")) % 3 == 0).cast("int"))
    lines = D.mask_text(g, "x", "y", "bit")
    S.register_table(t.spark, "mask_cells", S.MaskCells)
    # cells of a row that aren't in the table are not in its line: their columns are the row's own
    columns = g.groupBy(F.col("x").alias("row")).agg(F.array_sort(F.collect_list("y")).alias("cols"))  # 64 at most
    rows = lines.join(columns, "row")
    rows.createOrReplaceTempView("mask_lines")
    out = t.spark.sql("SELECT m.row, element_at(m.cols, c.place + 1) AS col, c.bit FROM mask_lines m, LATERAL mask_cells(m.line) c")
    return out


@query("l16_tree_cut")
def _(t):
    """Roots after links longer than half the reach are cut."""
    e, _modes, _values = V.pca(vectors(t).where("vector is not null"), "vector", 2)
    e = e.select("id", *(F.round(F.col("projected")[i] * 10, 2).alias(c) for i, c in enumerate("xy")))
    places = materialize(e.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("w")), "places")
    links = materialize(V.quick_shift(places, "id", "x", "y", sigma=0.5, reach=1.0, weight="w"), "links")
    return V.roots(V.tree_cut(links, places, "id", "x", "y", 0.5), "id")
