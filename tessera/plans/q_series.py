"""Windows, peaks, phases and curves over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import curves as C
from tessera.operators import grid as G
from tessera.operators import selection as Q
from tessera.operators import series as S

from .registry import query

W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
HOURS = "epoch(ts) / 3600.0"
NAV = f"SELECT user_id, event_id, value, row_number() {W} AS seq, count(*) OVER (PARTITION BY user_id) AS total FROM events"


def w():
    return S.along("user_id", "ts", "event_id")


def nav(t):
    return t.events.select("user_id", "event_id", "value", "ts", F.row_number().over(w()).alias("seq"), F.count("*").over(Window.partitionBy("user_id")).alias("total"))


def order():
    return S.along("user_id", "seq")


@query("w1_cumulative_max", f"SELECT event_id, max(value) {W} AS top FROM events")
def _(t):
    return t.events.select("event_id", F.max("value").over(w().rowsBetween(Window.unboundedPreceding, 0)).alias("top"))


@query("w2_local_max", f"SELECT event_id FROM (SELECT event_id, value, lag(value) {W} AS a, lead(value) {W} AS b FROM events) WHERE value > a AND value > b AND value >= 60")
def _(t):
    return t.events.withColumn("peak", S.local_max("value", w(), 60.0)).where("peak").select("event_id")


GRID = "SELECT l_orderkey % 64 AS line, l_suppkey % 64 AS part, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"


@query("w2_local_max_2d", f"WITH g AS ({GRID}), n AS (SELECT a.line, a.part, max(b.q) AS top, count(*) AS n FROM g a JOIN g b ON abs(a.line - b.line) <= 1 AND abs(a.part - b.part) <= 1 AND (a.line <> b.line OR a.part <> b.part) GROUP BY ALL) SELECT g.line, g.part FROM g JOIN n USING (line, part) WHERE n = 8 AND q > top")
def _(t):
    g = t.lineitem.groupBy((F.col("l_orderkey") % 64).alias("line"), (F.col("l_suppkey") % 64).alias("part")).agg(F.sum("l_quantity").alias("q"))
    around = G.neighbours_2d(g, "line", "part").groupBy("line", "part").agg(F.max("q").alias("top"), F.count("*").alias("n"))
    return g.join(around, ["line", "part"]).where("n = 8 and q > top").select("line", "part")


@query("w3_first_difference", f"SELECT event_id, round(coalesce(lead(value) {W} - value, 0), 6) AS d, round(value - coalesce(lag(value) {W}, 0), 6) AS back FROM events")
def _(t):
    return t.events.select("event_id", F.round(S.forward_difference("value", w()), 6).alias("d"), F.round(F.col("value") - F.coalesce(F.lag("value").over(w()), F.lit(0.0)), 6).alias("back"))


@query("w4_total_variation", f"SELECT user_id, round(sum(abs(d)), 4) AS tv FROM (SELECT user_id, coalesce(lead(value) {W} - value, 0) AS d FROM events) GROUP BY 1")
def _(t):
    return t.events.withColumn("d", S.forward_difference("value", w())).groupBy("user_id").agg(F.round(F.sum(F.abs("d")), 4).alias("tv"))


TAPS = S.gaussian_taps(7)
SMOOTH = " + ".join(f"{v!r} * " + ("value" if i == 0 else f"{'lead' if i > 0 else 'lag'}(value, {abs(i)}, 0) {W}") for i, v in TAPS.items())


@query("w5_gaussian_smooth", f"SELECT event_id, round({SMOOTH}, 6) AS y FROM events")
def _(t):
    return t.events.select("event_id", F.round(S.smooth("value", w(), TAPS), 6).alias("y"))


@query("w6_remove_bias", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS y FROM events")
def _(t):
    return t.events.select("event_id", F.round(S.remove_bias("value", "user_id"), 9).alias("y"))


CLIP = "SELECT event_id, user_id, CASE WHEN abs(y) > 2.0 * s THEN sign(y) * 2.0 * s ELSE y END AS y FROM (SELECT *, stddev(y) OVER (PARTITION BY user_id) AS s FROM ({}))"


@query("w7_clip_outliers", f"WITH b AS (SELECT event_id, user_id, value - avg(value) OVER (PARTITION BY user_id) AS y FROM events), c AS ({CLIP.format('SELECT * FROM b')}), d AS ({CLIP.format('SELECT * FROM c')}) SELECT event_id, round(y - avg(y) OVER (PARTITION BY user_id), 6) AS y FROM d")
def _(t):
    return S.clip_outliers(t.events.select("event_id", "user_id", "value"), "user_id", "value", sigmas=2.0).select("event_id", F.round("value", 6).alias("y"))


PEAKS = f"""n AS ({NAV}), p0 AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY seq) AS a, lead(value) OVER (PARTITION BY user_id ORDER BY seq) AS b FROM n),
p1 AS (SELECT *, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) - seq AS gap FROM p0 WHERE value > a AND value > b),
p2 AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS mean, avg(gap) OVER (PARTITION BY user_id) AS mean_gap FROM p1),
peaks AS (SELECT user_id, event_id, seq, value FROM p2 WHERE NOT coalesce(value < mean / 1.5 AND gap < mean_gap, FALSE))"""


@query("w8_find_peaks", f"WITH {PEAKS} SELECT user_id, event_id, seq FROM peaks")
def _(t):
    return S.find_peaks(nav(t), "user_id", "seq", "value").select("user_id", "event_id", "seq")


REFRACTORY = f"{PEAKS}, kept AS (SELECT * FROM (SELECT *, seq - lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS gap FROM peaks) WHERE gap IS NULL OR gap > 2)"


def kept_peaks(t):
    return S.refractory(S.find_peaks(nav(t), "user_id", "seq", "value"), "user_id", "seq", 2)


@query("w9_refractory", f"WITH {REFRACTORY} SELECT user_id, event_id FROM kept")
def _(t):
    return kept_peaks(t).select("user_id", "event_id")


@query("w10_event_rate", f"WITH {REFRACTORY} SELECT user_id, event_id, round(60.0 / (seq - lag(seq) OVER (PARTITION BY user_id ORDER BY seq))) AS rate FROM kept")
def _(t):
    return kept_peaks(t).select("user_id", "event_id", F.round(60.0 / (F.col("seq") - F.lag("seq").over(order()))).alias("rate"))


MARKS = f"{REFRACTORY}, m AS (SELECT n.user_id, n.event_id, n.seq, (SELECT max(k.seq) FROM kept k WHERE k.user_id = n.user_id AND k.seq <= n.seq) AS lo, (SELECT min(k.seq) FROM kept k WHERE k.user_id = n.user_id AND k.seq > n.seq) AS hi FROM n)"


@query("w11_phase_linear", f"WITH {MARKS} SELECT event_id, coalesce(least(floor((seq - lo) / (hi - lo)::DOUBLE * 4), 3), 0)::INT AS phase FROM m")
def _(t):
    return S.phase_of(nav(t).drop("ts"), kept_peaks(t), "user_id", "seq", 4).select("event_id", "phase")


RATE = "60.0 / (hi - lo)"
SPLIT = f"CASE WHEN {RATE} <= 10 THEN 0.33 WHEN {RATE} >= 20 THEN 0.5 ELSE 0.33 + 0.17 * ({RATE} - 10) / 10 END"


@query("w12_phase_two_part", f"WITH {MARKS}, s AS (SELECT *, (seq - lo) / (hi - lo)::DOUBLE AS share, {SPLIT} AS cut FROM m) SELECT event_id, coalesce(least(floor(CASE WHEN share < cut THEN share / cut / 2 ELSE 0.5 + (share - cut) / (1 - cut) / 2 END * 4), 3), 0)::INT AS phase FROM s")
def _(t):
    rate = 60.0 / F.col("interval")
    split = F.when(rate <= 10, 0.33).when(rate >= 20, 0.5).otherwise(0.33 + 0.17 * (rate - 10) / 10)
    return S.phase_of(nav(t).drop("ts"), kept_peaks(t), "user_id", "seq", 4, split).select("event_id", "phase")


@query("j14_phase_lookup", f"WITH {MARKS} SELECT event_id, lo, hi FROM m")
def _(t):
    marks = nav(t).select("user_id", "event_id", "seq").join(kept_peaks(t).select(F.col("event_id").alias("_e"), F.lit(True).alias("_k")), F.col("event_id") == F.col("_e"), "left")
    at = F.when(F.col("_k"), F.col("seq"))
    return marks.select("event_id", F.last(at, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)).alias("lo"), F.first(at, ignorenulls=True).over(order().rowsBetween(1, Window.unboundedFollowing)).alias("hi"))


@query("j7_asof_interpolate", f"""WITH n AS ({NAV}), k AS (SELECT user_id, seq AS x, value AS y, lead(seq) OVER v AS x1, lead(value) OVER v AS y1, lag(seq) OVER v AS x0, lag(value) OVER v AS y0 FROM n WHERE seq % 5 = 3 WINDOW v AS (PARTITION BY user_id ORDER BY seq)),
r AS (SELECT user_id, seq AS x FROM n WHERE seq % 5 <> 3), j AS (SELECT r.user_id, r.x AS pos, k.* EXCLUDE (user_id) FROM r ASOF LEFT JOIN k ON r.user_id = k.user_id AND r.x >= k.x),
f AS (SELECT user_id, min(x) AS first FROM k GROUP BY 1), z AS (SELECT j.user_id, j.pos, coalesce(j.x, k.x) AS x, coalesce(j.y, k.y) AS y, CASE WHEN j.x IS NULL THEN k.x1 ELSE j.x1 END AS x1, CASE WHEN j.x IS NULL THEN k.y1 ELSE j.y1 END AS y1, CASE WHEN j.x IS NULL THEN k.x0 ELSE j.x0 END AS x0, CASE WHEN j.x IS NULL THEN k.y0 ELSE j.y0 END AS y0 FROM j JOIN f USING (user_id) JOIN k ON k.user_id = f.user_id AND k.x = f.first)
SELECT user_id, pos::DOUBLE AS x, round(y + (pos - x) * CASE WHEN x1 IS NOT NULL THEN (y1 - y) / (x1 - x) WHEN x0 IS NOT NULL THEN (y - y0) / (x - x0) ELSE 0 END, 6) AS y FROM z""")
def _(t):
    n = nav(t).select("user_id", F.col("seq").cast("double").alias("x"), F.col("value").alias("y"))
    return S.interpolate(n.where("x % 5 = 3"), n.where("x % 5 <> 3"), "user_id", "x", "y").withColumn("y", F.round("y", 6))


@query("w13_robust_range", f"WITH n AS (SELECT *, seq / total::DOUBLE AS p FROM ({NAV})), m AS (SELECT *, min(CASE WHEN p > 0.1 AND p <= 0.8 THEN value END) OVER (PARTITION BY user_id) AS lo, max(CASE WHEN p > 0.1 AND p <= 0.8 THEN value END) OVER (PARTITION BY user_id) AS hi FROM n) SELECT event_id, round((value - lo) / (hi - lo), 6) AS y FROM m")
def _(t):
    return S.robust_normalise(t.events, "user_id", ["ts", "event_id"], "value").select("event_id", F.round("value", 6).alias("y"))


@query("w14_find_blocks", f"WITH n AS ({NAV}), r AS (SELECT *, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS island FROM n WHERE value > 40) SELECT user_id, min(seq) AS \"begin\", max(seq) AS \"end\" FROM r GROUP BY user_id, island")
def _(t):
    return S.runs(nav(t), "user_id", "seq", F.col("value") > 40)


@query("w15_zero_crossings", f"SELECT user_id, count(*) AS n FROM (SELECT user_id, (value - 50) * lag(value - 50) {W} AS p FROM events) WHERE p < 0 GROUP BY 1")
def _(t):
    d = F.col("value") - 50
    return t.events.withColumn("p", d * F.lag(d).over(w())).where("p < 0").groupBy("user_id").agg(F.count("*").alias("n"))


@query("w16_moving_median", f"WITH n AS ({NAV}), x AS (SELECT n.event_id, m.value FROM n, range(-2, 3) g(k) JOIN n m ON m.user_id = n.user_id AND m.seq = greatest(1, least(n.total, n.seq + k))) SELECT event_id, median(value) AS y FROM x GROUP BY 1")
def _(t):
    return nav(t).select("event_id", S.moving_median("value", order(), 5, F.col("total"), F.col("seq")).alias("y"))


SCORED = "s AS (SELECT doc_id, 2 * toxic - 1 AS label, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
COUNTED = f"{SCORED}, c AS (SELECT row_number() OVER o AS rank, sum((label > 0)::INT) OVER o AS tp, sum((label < 0)::INT) OVER o AS fp FROM s WINDOW o AS (ORDER BY score DESC, doc_id) UNION ALL SELECT 0, 0, 0), t AS (SELECT sum((label > 0)::INT) AS p, sum((label < 0)::INT) AS n FROM s)"


def scores(t):
    return t.labels.join(t.documents, "doc_id").select("doc_id", (2 * F.col("toxic") - 1).alias("label"), F.col("n_chars").cast("double").alias("score"))


@query("w17_tp_fp", f"WITH {COUNTED} SELECT rank, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c")
def _(t):
    return C.tp_fp(scores(t), "label", "score", "doc_id")


@query("w18_roc_curve", f"WITH {COUNTED} SELECT rank, round(tp / p, 6) AS tpr, round(1 - fp / n, 6) AS tnr FROM c, t")
def _(t):
    return C.roc(scores(t), "label", "score", "doc_id").select("rank", F.round("tpr", 6).alias("tpr"), F.round("tnr", 6).alias("tnr"))


@query("w18_roc_summary", f"WITH {COUNTED}, r AS (SELECT rank, tp / p AS tpr, 1 - fp / n AS tnr FROM c, t), d AS (SELECT *, tpr - lag(tpr) OVER (ORDER BY rank) AS step FROM r) SELECT round(sum(tnr * step), 6) AS auc, round(arg_min(CASE WHEN step > 0 THEN 1 - tnr ELSE 1 - tpr END, rank) FILTER (tpr >= tnr), 6) AS eer FROM d")
def _(t):
    return C.roc_summary(scores(t), "label", "score", "doc_id").select(F.round("auc", 6).alias("auc"), F.round("eer", 6).alias("eer"))


PREC = f"{COUNTED}, r AS (SELECT rank, tp / p AS recall, CASE WHEN rank = 0 THEN 1 ELSE tp / (tp + fp) END AS precision FROM c, t)"


@query("w19_pr_curve", f"WITH {PREC} SELECT rank, round(recall, 6) AS recall, round(precision, 6) AS precision, round(max(precision) OVER (ORDER BY rank DESC), 6) AS interpolated FROM r")
def _(t):
    rows = C.interpolated(C.pr(scores(t), "label", "score", "doc_id"))
    return rows.select("rank", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "interpolated")))


@query("w19_pr_summary", f"WITH {PREC}, d AS (SELECT *, recall - lag(recall) OVER o AS step, lag(precision) OVER o AS before FROM r WINDOW o AS (ORDER BY rank)), l AS (SELECT i, max(precision) AS top FROM r, range(11) g(i) WHERE recall >= i / 10.0 - 1e-12 GROUP BY 1) SELECT round(sum(step * (precision + before) / 2), 6) AS auc, round(sum(step * precision), 6) AS ap, round((SELECT sum(top) / 11 FROM l), 6) AS ap11 FROM d")
def _(t):
    return C.pr_summary(scores(t), "label", "score", "doc_id").select(*(F.round(c, 6).alias(c) for c in ("auc", "ap", "ap11")))


@query("w20_det_curve", f"WITH {COUNTED} SELECT rank, round(1 - tp / p, 6) AS miss, round(fp / n, 6) AS false_alarm FROM c, t")
def _(t):
    return C.det(scores(t), "label", "score", "doc_id").select("rank", F.round("miss", 6).alias("miss"), F.round("false_alarm", 6).alias("false_alarm"))


@query("a27_mad_threshold", "WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(median(abs(value - m)), 6) AS mad FROM events JOIN m USING (user_id) GROUP BY 1")
def _(t):
    centre = t.events.groupBy("user_id").agg(F.median("value").alias("m"))
    return t.events.join(centre, "user_id").groupBy("user_id").agg(F.round(F.median(F.abs(F.col("value") - F.col("m"))), 6).alias("mad"))


@query("x14_sliding_embedding", f"WITH n AS ({NAV}), p AS (SELECT a.user_id, k.i, l.j, sum(b.value * c.value) AS g FROM n a, range(4) k(i), range(4) l(j) JOIN n b ON b.user_id = a.user_id AND b.seq = a.seq + i JOIN n c ON c.user_id = a.user_id AND c.seq = a.seq + j WHERE a.seq + 3 <= a.total GROUP BY ALL) SELECT i, j, round(sum(g), 1) AS g FROM p GROUP BY ALL")
def _(t):
    rows = nav(t).select("user_id", S.sliding("value", order(), 4).alias("a")).where("a is not null")
    pairs = rows.select(F.posexplode("a").alias("i", "x"), "a").select("i", "x", F.posexplode("a").alias("j", "y"))
    return pairs.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.round(F.sum(F.col("x") * F.col("y")), 1).alias("g"))


@query("a27_selected_deviation", "WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(any_value(m), 6) AS median, round(median(abs(value - m)), 6) AS deviation FROM events JOIN m USING (user_id) GROUP BY 1")
def _(t):
    """Medians and median deviations of all users at once, by counting bits instead of sorting."""
    return Q.absolute_deviation(t.events.select("user_id", "value"), ["user_id"], "value").select("user_id", F.round("median", 6).alias("median"), F.round("deviation", 6).alias("deviation"))


@query("w13_selected_range", "SELECT share::DOUBLE AS share, round(q, 6) AS quantile FROM (SELECT unnest([0.1, 0.5, 0.9]) AS share, unnest(quantile_cont(l_extendedprice::DOUBLE, [0.1, 0.5, 0.9])) AS q FROM lineitem)")
def _(t):
    """Quantiles of a whole column: one group that holds all rows."""
    return Q.quantiles(t.lineitem, [], "l_extendedprice", [0.1, 0.5, 0.9]).select("share", F.round("quantile", 6).alias("quantile"))
