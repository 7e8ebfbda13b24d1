"""Similarity measures of quantity against price, by grid cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bins as B
from tessera.operators import similarity as M
from tessera.operators import windows as X

from .registry import query

RAW = "SELECT l_orderkey % 64 AS line, l_suppkey % 64 AS part, sum(l_quantity) AS a, sum(l_extendedprice) AS b FROM lineitem GROUP BY ALL"
PAIRS = f"raw AS ({RAW}), e AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM raw), p AS (SELECT line, part, (a - la) / (ha - la) * 255 AS a, (b - lb) / (hb - lb) * 255 AS b FROM raw, e)"


def raw(t):
    return t.lineitem.groupBy((F.col("l_orderkey") % 64).alias("line"), (F.col("l_suppkey") % 64).alias("part")).agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_extendedprice"), 2).alias("b"))


def pairs(t):
    return M.rescaled(raw(t), "a", "b")


MOMENTS_SQL = {
    "mse": "avg((a - b) * (a - b))", "nmse": "sum((a - b) * (a - b)) / sum(b * b)", "rmse": "sqrt(avg((a - b) * (a - b)))", "nrmse": "sqrt(avg((a - b) * (a - b))) / (max(abs(a)) - min(abs(a)))",
    "psnr": "10 * log10(65536 / avg((a - b) * (a - b)))", "zcc": "sum(a * b) / sqrt(sum(a * a) * sum(b * b))", "cc": "corr(a, b)", "tam": "sum(a * b) / (sum((a - b) * (a - b)) + sum(a * b))", "mr": "avg(least(a, b))",
    "ssd": "sqrt(sum((a - b) * (a - b))) / count(*)", "sad": "avg(abs(a - b))", "zsad": "avg(abs(a - b - ma + mb))", "lsad": "avg(abs(a - ma / mb * b))", "agree": "avg((a = b)::INT)", "shd": "avg((a <> b)::INT)",
    "snr": "10 * log10(var_pop(b) / avg((a - b) * (a - b)))", "psnr3d": "20 * log10(max(abs(b)) / sqrt(avg((a - b) * (a - b))))",
}
MEANS = "m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM p)"


@query("m10_moments", f"WITH {PAIRS}, {MEANS} SELECT {', '.join(f'round({v}, 5) AS {k}' for k, v in MOMENTS_SQL.items())} FROM p, m")
def _(t):
    return M.moments(pairs(t)).select(*(F.round(c, 5).alias(c) for c in M.MOMENTS))


@query("m31_metrics_by_channel", f"WITH {PAIRS}, q AS (SELECT *, part % 4 AS channel FROM p), m AS (SELECT channel, avg(a) AS ma, avg(b) AS mb FROM q GROUP BY 1), r AS (SELECT line, part // 4 AS part, sqrt(sum(a * a)) AS a, sqrt(sum(b * b)) AS b FROM q GROUP BY ALL) SELECT channel::VARCHAR AS channel, round(avg((a - b) * (a - b)), 5) AS mse, round(corr(a, b), 5) AS cc, round(avg(abs(a - b - ma + mb)), 5) AS zsad FROM q JOIN m USING (channel) GROUP BY 1 UNION ALL SELECT 'combined', round(avg((a - b) * (a - b)), 5), round(corr(a, b), 5), round(avg(abs(a - b - (SELECT avg(a) - avg(b) FROM r))), 5) FROM r")
def _(t):
    p = pairs(t).withColumn("channel", (F.col("part") % 4).cast("string"))
    combined = p.groupBy("line", F.floor(F.col("part") / 4).alias("part")).agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in ("a", "b"))).withColumn("channel", F.lit("combined"))
    both = p.select("channel", "a", "b").unionByName(combined.select("channel", "a", "b"))
    return M.moments(both, by=["channel"]).select("channel", *(F.round(c, 5).alias(c) for c in ("mse", "cc", "zsad")))


@query("m21_medians", f"WITH {PAIRS}, {MEANS.replace('avg(b) AS mb', 'avg(b) AS mb, stddev(a) AS sa, stddev(b) AS sb')} SELECT round(median((a - b) * (a - b)) / count(*), 6) AS msd, round(median(a - b) / count(*), 8) AS mad, round(sqrt(sum(pow((a - ma) / sa - (b - mb) / sb, 2))) / count(*), 8) AS nssd FROM p, m")
def _(t):
    return M.medians(pairs(t)).select(F.round("msd", 6).alias("msd"), F.round("mad", 8).alias("mad"), F.round("nssd", 8).alias("nssd"))


JOINT = "e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_tax) AS y0, max(l_tax) AS y1 FROM lineitem), j AS (SELECT round((l_quantity - x0) / (x1 - x0) * 14)::INT AS a, round((l_tax - y0) / (y1 - y0) * 14)::INT AS b, count(*) AS n FROM lineitem, e GROUP BY 1, 2), s AS (SELECT sum(n) AS t FROM j), ja AS (SELECT a, sum(n) AS n FROM j GROUP BY a), jb AS (SELECT b, sum(n) AS n FROM j GROUP BY b)"


def joint(t):
    return B.joint_histogram(t.lineitem, "l_quantity", "l_tax", 15)


def entropy(name: str, table: str) -> str:
    return f"h{name} AS (SELECT -sum(n / t * log2(n / t)) AS h{name}, log2(sum(sqrt(n / t))) / 0.5 AS r{name}, (1 - sum(sqrt(n / t))) / -0.5 AS q{name}, sum(n / t * n / t) AS e{name} FROM {table}, s)"


@query("m1_entropy_measures", f"WITH {JOINT}, {entropy('ab', 'j')}, {entropy('a', 'ja')}, {entropy('b', 'jb')} SELECT round(ha + hb - hab, 8) AS smi, round((ha + hb) / hab, 6) AS snmi, round(2 * hab - ha - hb, 6) AS efinfo, round(ra + rb - rab, 8) AS rmi, round((ra + rb) / rab, 6) AS rnmi, round(qa + qb - qab, 6) AS tmi, round((qa + qb) / qab, 6) AS tnmi, round(eab, 8) AS ejp FROM hab, ha, hb")
def _(t):
    digits = {"smi": 8, "rmi": 8, "ejp": 8}
    return M.entropies(joint(t)).select(*(F.round(c, digits.get(c, 6)).alias(c) for c in M.ENTROPIES))


@query("m8_f_information", f"WITH {JOINT}, c AS (SELECT coalesce(j.n, 0) / t AS p, ja.n * jb.n / (t * t) AS m FROM ja CROSS JOIN jb CROSS JOIN s LEFT JOIN j ON j.a = ja.a AND j.b = jb.b) SELECT round((sum(sqrt(p) / pow(m, -0.5)) - 1) / -0.25, 8) AS i_alpha, round(sum(pow(abs(sqrt(p) - sqrt(m)), 2)), 8) AS m_alpha, round(sum(pow(abs(p - m), 2) / m), 8) AS chi_alpha FROM c")
def _(t):
    return M.f_information(joint(t)).select(*(F.round(c, 8).alias(c) for c in ("i_alpha", "m_alpha", "chi_alpha")))


@query("m12_spearman", "WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(ra, rb), 8) AS spr FROM r")
def _(t):
    return M.spearman(t.lineitem.select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))).select(F.round("spr", 8).alias("spr"))


@query("m13_kendall", f"WITH {JOINT}, p AS (SELECT sum(CASE WHEN sign(x.a - y.a) * sign(x.b - y.b) > 0 THEN x.n * y.n END)::DOUBLE / 2 AS c, sum(CASE WHEN sign(x.a - y.a) * sign(x.b - y.b) < 0 THEN x.n * y.n END)::DOUBLE / 2 AS d FROM j x, j y), k AS (SELECT (t * (t - 1) / 2)::DOUBLE AS n0, (SELECT sum(n * (n - 1) / 2) FROM ja) AS ta, (SELECT sum(n * (n - 1) / 2) FROM jb) AS tb FROM s) SELECT round((c - d) / sqrt((n0 - ta) * (n0 - tb)), 8) AS ket FROM p, k")
def _(t):
    return M.kendall(joint(t)).select(F.round("ket", 8).alias("ket"))


@query("m18_zero_crossings", f"WITH {PAIRS}, d AS (SELECT (a - b) * lag(a - b) OVER (ORDER BY line * 64 + part) AS s FROM p) SELECT count(*) FILTER (s < 0) AS zca, round(count(*) FILTER (s < 0) / count(*), 6) AS zcr FROM d")
def _(t):
    return M.zero_crossings(pairs(t).withColumn("key", F.col("line") * 64 + F.col("part")), "key").select("zca", F.round("zcr", 6).alias("zcr"))


@query("m9_ssim", f"WITH {PAIRS}, k AS (SELECT i, j, exp(-(i * i + j * j) / 4.5) / sum(exp(-(i * i + j * j) / 4.5)) OVER () AS w FROM range(-5, 6) x(i), range(-5, 6) y(j)), m AS (SELECT line + i AS r, part + j AS c, count(*) AS n, sum(w * a) AS mx, sum(w * b) AS my, sum(w * a * a) AS xx, sum(w * b * b) AS yy, sum(w * a * b) AS xy FROM p, k GROUP BY ALL) SELECT round(avg((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225))), 6) AS mssim, count(*) AS windows FROM m WHERE n = 121")
def _(t):
    return M.ssim(pairs(t), "line", "part").select(F.round("mssim", 6).alias("mssim"), "windows")


def edge_cells(name: str, v: str) -> str:
    """SQL of an image's edge cells: nine neighbours by clamped keys, gradient, threshold, peak along the steeper axis."""
    return f"""{name}_g AS (SELECT c.line, c.part, abs(sum(j * (2 - abs(i)) * {v.format('n.')}) / 8) AS gx, abs(sum(i * (2 - abs(j)) * {v.format('n.')}) / 8) AS gy
  FROM p c, range(-1, 2) y(i), range(-1, 2) x(j) JOIN p n ON n.line = greatest(0, least(63, c.line + i)) AND n.part = greatest(0, least(63, c.part + j)) GROUP BY ALL),
{name}_s AS (SELECT *, gx * gx + gy * gy AS g FROM {name}_g),
{name}_n AS (SELECT *, coalesce(lag(g) OVER l, g) AS w, coalesce(lead(g) OVER l, g) AS e, coalesce(lag(g) OVER u, g) AS n, coalesce(lead(g) OVER u, g) AS s FROM {name}_s
  WINDOW l AS (PARTITION BY line ORDER BY part), u AS (PARTITION BY part ORDER BY line)),
{name}_h AS (SELECT log2(count(*)) AS h FROM {name}_n WHERE g > 4 * (SELECT avg(g) FROM {name}_s) AND ((gx >= gy - 2.220446049250313e-14 AND w <= g AND g > e) OR (gy >= gx - 2.220446049250313e-14 AND n <= g AND g > s)))"""


@query("m7_gradient_entropy", f"WITH {PAIRS}, {edge_cells('a', '{}a')}, {edge_cells('b', '{}b')}, {edge_cells('d', 'abs({0}a - {0}b)')} SELECT round(0.5 * (a_h.h + b_h.h) / d_h.h, 6) AS gre FROM a_h, b_h, d_h")
def _(t):
    return M.gradient_entropy(pairs(t), "line", "part").select(F.round("gre", 6).alias("gre"))


@query("m29_cropped_psnr", f"WITH {PAIRS}, q AS (SELECT *, part % 3 AS channel FROM p), f AS (SELECT min(line) + 4 AS r0, max(line) - 4 AS r1, min(part) + 4 AS c0, max(part) - 4 AS c1 FROM p) SELECT channel, round(10 * log10(65025 / avg((a - b) * (a - b))), 5) AS csnr FROM q, f WHERE line BETWEEN r0 AND r1 AND part BETWEEN c0 AND c1 GROUP BY 1")
def _(t):
    return M.cropped_psnr(pairs(t).withColumn("channel", F.col("part") % 3), "line", "part", 4, by=["channel"]).withColumn("csnr", F.round("csnr", 5))


def haar_levels(levels: int) -> str:
    out = ["w0 AS (SELECT line AS r, part AS c, a AS v FROM p)"]
    for j in range(1, levels + 1):
        out.append(f"w{j}_ AS (SELECT r // 2 AS r, c // 2 AS c, " + ", ".join(f"sum(v * {s} / 2) AS {n}" for n, s in (("v", "1"), ("h", "(1 - 2 * (r % 2))"), ("x", "(1 - 2 * (c % 2))"), ("d", "(1 - 2 * (r % 2)) * (1 - 2 * (c % 2))")) ) + f" FROM w{j - 1} GROUP BY ALL)")
        out.append(f"w{j} AS (SELECT r, c, v FROM w{j}_)")
    return ", ".join(out)


WEIGHT = "pow(2, -{0} * (1 + 0.5 - 2.25))"
BESOV = " + ".join([f"pow({WEIGHT.format(j)} * (SELECT pow(sum(pow(abs(h), 4 / 9.0) + pow(abs(x), 4 / 9.0) + pow(abs(d), 4 / 9.0)), 2.25) FROM w{j}_), 4)" for j in (1, 2, 3)] + [f"pow({WEIGHT.format(4)} * (SELECT pow(sum(pow(abs(v), 4 / 9.0)), 2.25) FROM w3), 4)"])


@query("m27_besov", f"WITH {PAIRS}, {haar_levels(3)} SELECT round(log10(pow({BESOV}, 0.25)), 6) AS log_besov")
def _(t):
    """As a logarithm: the norm itself has ten digits before the point."""
    return M.besov(pairs(t), ["line", "part"], "a").select(F.round(F.log10("besov"), 6).alias("log_besov"))


CHANNELS = f"g AS ({RAW}), two AS (SELECT line AS r, part AS c, 0 AS ch, a AS v FROM g UNION ALL SELECT line, part, 1, b / 1000 FROM g)"


def two_channels(t):
    g = raw(t)
    return g.select(F.col("line").alias("r"), F.col("part").alias("c"), F.lit(0).alias("ch"), F.col("a").alias("v")).unionByName(g.select(F.col("line").alias("r"), F.col("part").alias("c"), F.lit(1).alias("ch"), (F.col("b") / 1000).alias("v")))


@query("x14_grid_windows", f"WITH {CHANNELS}, w AS (SELECT r - i AS r, c - j AS c, sum(v * pow(0.9, ch * 9 + i * 3 + j)) AS y FROM two, range(3) x(i), range(3) z(j) WHERE r - i BETWEEN 0 AND 61 AND c - j BETWEEN 0 AND 61 GROUP BY ALL) SELECT r, c, round(y, 3) AS y FROM w")
def _(t):
    """All 3 by 3 windows of two channels, each weighed to one number."""
    rows = X.window_rows(two_channels(t), "r", "c", "ch", "v", 3, 3)
    weighed = F.aggregate(F.transform("window", lambda v, i: v * F.pow(F.lit(0.9), i)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("r", "c", F.round(weighed, 3).alias("y"))


@query("x14_grid_gram", f"WITH {CHANNELS}, w AS (SELECT r - i AS r, c - j AS c, ch * 9 + i * 3 + j AS k, v FROM two, range(3) x(i), range(3) z(j) WHERE r - i BETWEEN 0 AND 61 AND c - j BETWEEN 0 AND 61) SELECT a.k AS i, b.k AS j, round(sum(a.v * b.v) / 1000, 3) AS g FROM w a JOIN w b USING (r, c) GROUP BY ALL")
def _(t):
    """The Gramian of all those windows, from lag products."""
    _names, gram = X.window_gram(two_channels(t), "r", "c", "ch", "v", 3, 3, tile=16)
    return t.spark.createDataFrame([(i, j, round(float(v) / 1000, 3)) for i, row in enumerate(gram) for j, v in enumerate(row)], "i long, j long, g double")  # a row a pair of components
