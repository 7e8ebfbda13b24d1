"""Grids, gates, combinations and histograms over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import shrink
from tessera.operators import bins as B
from tessera.operators import grid as G
from tessera.operators.records import discard_start

from .registry import query

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
CELLS = "SELECT l_orderkey % 64 AS line, l_linenumber AS part, l_suppkey % 8 AS channel, year(l_shipdate) AS rep, l_extendedprice AS re, l_discount * l_extendedprice AS im, l_quantity AS q, * FROM lineitem"


def cells(t):
    return t.lineitem.select((F.col("l_orderkey") % 64).alias("line"), F.col("l_linenumber").alias("part"), (F.col("l_suppkey") % 8).alias("channel"), F.year("l_shipdate").alias("rep"), F.col("l_extendedprice").alias("re"), (F.col("l_discount") * F.col("l_extendedprice")).alias("im"), F.col("l_quantity").alias("q"), "*")


for keep, pick in (("last", "arg_max"), ("first", "arg_min")):

    @query(f"j1_grid_{keep}_wins", f"SELECT line, part, channel, {pick}(re, ({', '.join(ORDER)})) AS re, {pick}(im, ({', '.join(ORDER)})) AS im FROM ({CELLS}) GROUP BY ALL")
    def _(t, keep=keep):
        return G.grid_cells(cells(t), ["line", "part", "channel"], ["re", "im"], ORDER, keep)


@query("j2_dense_zero_fill", f"WITH c AS (SELECT line, part, channel, round(sum(q), 2) AS q FROM ({CELLS}) GROUP BY ALL), g AS (SELECT l.line, p.part, h.channel FROM range(0, 64) l(line), range(0, 9) p(part), range(0, 8) h(channel)) SELECT g.line, g.part, g.channel, coalesce(c.q, 0) AS q FROM g LEFT JOIN c ON g.line = c.line AND g.part = c.part AND g.channel = c.channel")
def _(t):
    """All channels and lines; parts without records are the holes."""
    every = cells(t).groupBy("line", F.col("part").cast("long").alias("part"), "channel").agg(F.round(F.sum("q"), 2).alias("q"))
    return G.dense_grid(every, {"line": (0, 63), "part": (0, 8), "channel": (0, 7)})


GATES = "SELECT gate, 10.0 + 20 * gate AS centroid, 12.0 AS tolerance FROM range(5) g(gate)"


def fixed_gates(t):
    return t.spark.range(5).select(F.col("id").alias("gate"), (F.lit(10.0) + 20 * F.col("id")).alias("centroid"), F.lit(12.0).alias("tolerance"))


PAIRS = f"SELECT e.*, g.*, abs(value - centroid) AS distance FROM events e JOIN ({GATES}) g ON abs(value - centroid) < tolerance"


@query("j3_gate_range_join", f"SELECT event_id, gate, round(distance, 6) AS distance FROM ({PAIRS})")
def _(t):
    return G.in_gates(t.events, fixed_gates(t), "value").select("event_id", "gate", F.round("distance", 6).alias("distance"))


@query("j3_gate_bucket_join", f"SELECT event_id, gate, round(distance, 6) AS distance FROM ({PAIRS})")
def _(t):
    return G.in_gates(t.events, fixed_gates(t), "value", limit=2).select("event_id", "gate", F.round("distance", 6).alias("distance"))


@query("j4_populate_closest", f"SELECT user_id, gate, arg_min(value, (distance, ts, event_id)) AS value FROM ({PAIRS}) GROUP BY ALL")
def _(t):
    return G.populate(G.in_gates(t.events, fixed_gates(t), "value"), ["user_id", "gate"], "value", ["ts", "event_id"], "closest")


@query("j5_populate_average", f"SELECT user_id, gate, round(avg(value), 6) AS value FROM ({PAIRS}) GROUP BY ALL")
def _(t):
    return G.populate(G.in_gates(t.events, fixed_gates(t), "value"), ["user_id", "gate"], "value", ["ts", "event_id"], "average").withColumn("value", F.round("value", 6))


GAUSS = "round(sum(exp(-distance * distance / (2 * tolerance * tolerance)) * value) / sum(exp(-distance * distance / (2 * tolerance * tolerance))), 6) AS value"


@query("j6_populate_gauss", f"SELECT user_id, gate, {GAUSS} FROM ({PAIRS}) GROUP BY ALL")
def _(t):
    return G.populate(G.in_gates(t.events, fixed_gates(t), "value"), ["user_id", "gate"], "value", ["ts", "event_id"]).withColumn("value", F.round("value", 6))


MASK = "SELECT l_orderkey % 64 AS line, l_linenumber AS part FROM lineitem WHERE l_orderkey % 640 = l_orderkey % 64"


def mask(t):
    return t.lineitem.where("l_orderkey % 640 = l_orderkey % 64").select((F.col("l_orderkey") % 64).alias("line"), F.col("l_linenumber").alias("part"))


@query("j8_mask_semi", f"SELECT line, part, count(*) AS n FROM ({CELLS}) SEMI JOIN ({MASK}) USING (line, part) GROUP BY ALL")
def _(t):
    return G.keep_sampled(cells(t), mask(t), ["line", "part"]).groupBy("line", "part").agg(F.count("*").alias("n"))


@query("j8_mask_anti", f"SELECT line, channel, count(*) AS n FROM ({CELLS}) ANTI JOIN (SELECT line, part FROM ({MASK}) WHERE part < 4) USING (line, part) GROUP BY ALL")
def _(t):
    return G.drop_sampled(cells(t), mask(t).where("part < 4"), ["line", "part"]).groupBy("line", "channel").agg(F.count("*").alias("n"))


@query("j8_mask_zero", f"SELECT channel, round(sum(CASE WHEN part < 4 THEN re ELSE 0 END), 2) AS re FROM ({CELLS}) GROUP BY ALL")
def _(t):
    kept = mask(t).where("part < 4")
    every = G.zero_unsampled(cells(t).select("line", "part", "channel", "re"), kept.unionByName(t.spark.range(64).crossJoin(t.spark.range(1, 4).withColumnRenamed("id", "p")).select(F.col("id").alias("line"), F.col("p").cast("int").alias("part"))), ["line", "part"], ["re"])
    return every.groupBy("channel").agg(F.round(F.sum("re"), 2).alias("re"))


@query("a1_rss_combine", f"SELECT line, part, round(sqrt(sum(re * re + im * im)), 3) AS rss FROM ({CELLS}) GROUP BY ALL")
def _(t):
    return cells(t).groupBy("line", "part").agg(F.round(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))), 3).alias("rss"))


@query("a2_pnorm_combine", f"SELECT line, part, round(pow(sum(pow(sqrt(re * re + im * im) / 1000, 3)), 1 / 3.0), 6) AS norm FROM ({CELLS}) GROUP BY ALL")
def _(t):
    return cells(t).groupBy("line", "part").agg(F.round(F.pow(F.sum(F.pow(F.hypot("re", "im") / 1000, F.lit(3.0))), F.lit(1 / 3.0)), 6).alias("norm"))


@query("a3_phase_weighted", f"SELECT line, part, round(sqrt(sum(m)), 3) AS size, round(sum(m * phase) / sum(m), 6) AS phase FROM (SELECT *, re * re + im * im AS m, atan2(im, re) AS phase FROM ({CELLS})) GROUP BY ALL")
def _(t):
    m = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return cells(t).groupBy("line", "part").agg(F.round(F.sqrt(F.sum(m)), 3).alias("size"), F.round(F.sum(m * F.atan2("im", "re")) / F.sum(m), 6).alias("phase"))


@query("a4_repetition_average", f"SELECT line, part, channel, round(avg(re), 8) AS re, round(avg(im), 8) AS im FROM (SELECT line, part, channel, rep, avg(re) AS re, avg(im) AS im FROM ({CELLS}) GROUP BY ALL) GROUP BY line, part, channel")
def _(t):
    each = cells(t).groupBy("line", "part", "channel", "rep").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return each.groupBy("line", "part", "channel").agg(F.round(F.avg("re"), 8).alias("re"), F.round(F.avg("im"), 8).alias("im"))


@query("a5_channel_select", "WITH c AS (SELECT user_id, event_type, sum(abs(value)) AS power, max(CASE WHEN hour(ts) BETWEEN 6 AND 12 THEN abs(value) END) AS peak FROM events GROUP BY ALL), b AS (SELECT *, max(peak / power) OVER (PARTITION BY user_id) AS best FROM c) SELECT user_id, event_type, round(peak / power, 6) AS share FROM b WHERE peak / power > 0.2 * best")
def _(t):
    inside = F.when(F.hour("ts").between(6, 12), F.abs("value"))
    c = t.events.groupBy("user_id", "event_type").agg(F.sum(F.abs("value")).alias("power"), F.max(inside).alias("peak")).withColumn("share", F.col("peak") / F.col("power"))
    return c.withColumn("best", F.max("share").over(Window.partitionBy("user_id"))).where("share > 0.2 * best").select("user_id", "event_type", F.round("share", 6).alias("share"))


@query("a6_energy_normalise", f"WITH c AS ({CELLS}), e AS (SELECT channel, sum(re * re + im * im) AS energy FROM c GROUP BY channel) SELECT l_orderkey, l_linenumber, l_partkey, round(re / energy * 1e9, 6) AS re, round(im / energy * 1e9, 6) AS im FROM c JOIN e USING (channel)")
def _(t):
    c = cells(t)
    energy = c.groupBy("channel").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))
    return c.join(F.broadcast(energy), "channel").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("re") / F.col("energy") * 1e9, 6).alias("re"), F.round(F.col("im") / F.col("energy") * 1e9, 6).alias("im"))  # 8 channels


@query("a7_bin_sum", "WITH s AS (SELECT CAST(l_suppkey % 16 AS BIGINT) AS bin, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_suppkey % 16 > 0 GROUP BY 1) SELECT b.bin, coalesce(total, 0) AS total FROM range(1, 21) b(bin) LEFT JOIN s ON s.bin = b.bin")
def _(t):
    return B.bin_sum(t.lineitem.withColumn("bin", F.col("l_suppkey") % 16), "bin", "l_extendedprice", 20).withColumn("total", F.round("total", 2))


EDGES = [5.0, 10.0, 20.0, 30.0, 45.0]
BIN = "(l_quantity >= 5)::INT + (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 45)::INT"


@query("a8_bin_search", f"SELECT {BIN} AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(B.bin_of(F.col("l_quantity"), EDGES).alias("bin")).agg(F.count("*").alias("n"))


@query("a9_weighted_histogram", f"SELECT CASE WHEN l_quantity = 45 THEN 5 ELSE {BIN} END AS bin, round(sum(l_discount), 4) AS weight FROM lineitem WHERE l_quantity >= 5 AND l_quantity <= 45 GROUP BY 1")
def _(t):
    return B.weighted_histogram(t.lineitem, "l_quantity", "l_discount", EDGES).withColumn("weight", F.round("weight", 4))


JOINT = "SELECT round((a - lo_a) / (hi_a - lo_a) * 15)::INT AS a, round((b - lo_b) / (hi_b - lo_b) * 15)::INT AS b, count(*) AS n FROM (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), (SELECT min(l_quantity) AS lo_a, max(l_quantity) AS hi_a, min(l_extendedprice) AS lo_b, max(l_extendedprice) AS hi_b FROM lineitem) GROUP BY 1, 2"


@query("a10_joint_histogram", JOINT)
def _(t):
    return B.joint_histogram(t.lineitem.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "x", "y", 16)


@query("a11_hist_marginal", f"SELECT a, b, sum(n)::BIGINT AS n FROM ({JOINT}) GROUP BY GROUPING SETS ((a), (b))")
def _(t):
    joint = B.joint_histogram(t.lineitem.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "x", "y", 16)
    return joint.cube("a", "b").agg(F.sum("n").alias("n"), F.grouping_id("a", "b").alias("g")).where("g in (1, 2)").drop("g")


DENSE = "SELECT l_orderkey % 64 AS line, l_linenumber::BIGINT AS part, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"


def dense(t):
    return t.lineitem.groupBy((F.col("l_orderkey") % 64).alias("line"), F.col("l_linenumber").cast("long").alias("part")).agg(F.sum("l_quantity").alias("q"))


@query("a12_integral_image", f"SELECT line, part, sum(s) OVER (PARTITION BY part ORDER BY line) AS integral FROM (SELECT line, part, sum(q) OVER (PARTITION BY line ORDER BY part) AS s FROM ({DENSE}))")
def _(t):
    return G.integral(dense(t), "line", "part", "q").select("line", "part", "integral")


@query("a13_integral_boxes", "SELECT b.box, l.l_returnflag AS flag, count(*) AS n FROM lineitem l JOIN (SELECT k AS box, k * 9 AS l0, k * 9 + 20 AS l1, 1 + k AS p0, 4 + k AS p1 FROM range(4) g(k)) b ON l.l_orderkey % 64 BETWEEN l0 AND l1 AND l_linenumber BETWEEN p0 AND p1 GROUP BY ALL")
def _(t):
    counts = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % 64).alias("line"), F.col("l_linenumber").cast("long").alias("part")).agg(F.count("*").alias("n"))
    boxes = t.spark.range(4).select(F.col("id").alias("box"), (F.col("id") * 9).alias("l0"), (F.col("id") * 9 + 20).alias("l1"), (F.col("id") + 1).alias("p0"), (F.col("id") + 4).alias("p1"))
    return B.box_counts(counts, "flag", "line", "part", "n", boxes)


@query("a14_label_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    label = F.array("o_orderstatus", "o_orderpriority")
    return t.orders.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(F.col("label")[0].alias("o_orderstatus"), F.col("label")[1].alias("o_orderpriority"), "n")


@query("a15_path_histogram", "WITH p AS (SELECT [l_linenumber % 2, l_linenumber % 3, (l_suppkey % 4)::INT] AS path FROM lineitem), n AS (SELECT path[1:k] AS node FROM p, range(1, 4) g(k)) SELECT array_to_string(node, '/') AS node, count(*) AS n FROM n GROUP BY 1")
def _(t):
    path = F.array(F.col("l_linenumber") % 2, F.col("l_linenumber") % 3, (F.col("l_suppkey") % 4).cast("int"))
    return B.path_histogram(t.lineitem.select(path.alias("path")), "path")


@query("a16_cut_histogram", "SELECT lang, CASE WHEN substr(source, 4)::INT < 5 THEN 'low' WHEN substr(source, 4)::INT < 12 THEN 'middle' ELSE 'none' END AS label, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    sources = t.documents.select("source").distinct().withColumn("i", F.substring("source", 4, 9).cast("int"))
    mapping = sources.select("source", F.when(F.col("i") < 5, "low").when(F.col("i") < 12, "middle").alias("label"))
    return B.cut_histogram(t.documents, "source", mapping, "label", ["lang"], missing="none")


@query("a17_tree_histogram", "WITH leaf AS (SELECT substr(source, 4)::INT AS leaf, count(*) AS n FROM documents GROUP BY 1) SELECT node, sum(n)::BIGINT AS n FROM (SELECT leaf AS node, n FROM leaf UNION ALL SELECT 100 + leaf // 4, n FROM leaf UNION ALL SELECT 200, n FROM leaf) GROUP BY 1")
def _(t):
    leaves = t.documents.groupBy(F.substring("source", 4, 9).cast("int").alias("leaf")).agg(F.count("*").alias("n"))
    ids = leaves.select(F.col("leaf").alias("node"))
    edges = ids.select("node", (F.lit(100) + F.floor(F.col("node") / 4)).cast("int").alias("parent"))
    edges = edges.unionByName(edges.select(F.col("parent").alias("node"), F.lit(200).alias("parent")).distinct())
    return B.tree_histogram(leaves, edges, depth=3)


CENTROIDS = """ends AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(floor((value - lo) / ((hi - lo) / 256)), 255)::INT AS bin, count(*) AS n FROM events, ends GROUP BY 1),
h AS (SELECT i AS bin, coalesce(n, 0) AS n FROM range(256) r(i) LEFT JOIN b ON b.bin = i),
lim AS (SELECT lo + (hi - lo) / 256 * (SELECT max(u.bin) FROM h u WHERE (SELECT coalesce(sum(n), 0) FROM h x WHERE x.bin < u.bin) <= 0.9 * (SELECT sum(n) FROM h)) AS top,
  lo + (hi - lo) / 256 * (SELECT min(u.bin) FROM h u WHERE (SELECT sum(n) FROM h x WHERE x.bin >= u.bin) <= 0.9 * (SELECT sum(n) FROM h)) AS bottom FROM ends),
gates AS (SELECT gate, top - gate * (top - bottom) / 3 AS centroid, abs(top - bottom) / 3 / 2 AS tolerance FROM lim, range(4) g(gate))"""


@query("a18_gate_centroids", f"WITH {CENTROIDS} SELECT gate, round(centroid, 6) AS centroid, round(tolerance, 6) AS tolerance FROM gates")
def _(t):
    g = G.gate_centroids(t.events, "value", 4)
    return g.select(F.col("gate").cast("long").alias("gate"), F.round("centroid", 6).alias("centroid"), F.round("tolerance", 6).alias("tolerance"))


@query("a22_block_split_combine", "SELECT o_orderkey // 64 AS block, count(DISTINCT o_orderkey) AS parts, count(DISTINCT o_orderkey) = 64 AS complete FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.floor(F.col("o_orderkey") / 64).alias("block")).agg(F.count_distinct("o_orderkey").alias("parts")).withColumn("complete", F.col("parts") == 64)


@query("a23_complete_blocks", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT user_id, i // 8 AS block, max(CASE WHEN i % 8 = 4 THEN event_id END) AS middle FROM r GROUP BY ALL HAVING count(*) = 8")
def _(t):
    r = t.events.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return r.groupBy("user_id", F.floor(F.col("i") / 8).alias("block")).agg(F.count("*").alias("n"), F.max(F.when(F.col("i") % 8 == 4, F.col("event_id"))).alias("middle")).where("n = 8").drop("n")


A25 = "WITH g AS (SELECT DISTINCT l_orderkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem), c AS (SELECT a.x, b.y, g.x IS NOT NULL AS hit, pow((a.x - 31.5) / 32, 2) + pow((b.y - 31.5) / 32, 2) <= 1 AS disc, abs(a.x - 31.5) < 8 AND abs(b.y - 31.5) < 8 AS box FROM range(64) a(x) CROSS JOIN range(64) b(y) LEFT JOIN g ON g.x = a.x AND g.y = b.y), r AS (SELECT avg(CASE WHEN disc AND NOT box THEN hit::INT END) AS share FROM c) SELECT x, y, round(CASE WHEN box THEN 1 ELSE 1 / share END, 6) AS weight FROM c, r WHERE hit"


def sampled(rows):
    """The cells (x, y) that rows hit."""
    return rows.select((F.col("l_orderkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).distinct().withColumn("hit", F.lit(1))


def density_weights(hits):
    """(x, y, weight) of the cells hit: 1 in the inner box, else one over the sampled share of the disc around it."""
    g = G.dense_grid(hits, {"x": (0, 63), "y": (0, 63)})
    disc = F.pow((F.col("x") - 31.5) / 32, F.lit(2)) + F.pow((F.col("y") - 31.5) / 32, F.lit(2)) <= 1
    g = g.withColumn("box", (F.abs(F.col("x") - 31.5) < 8) & (F.abs(F.col("y") - 31.5) < 8)).withColumn("outer", disc & ~F.col("box"))
    share = g.agg(F.avg(F.when(F.col("outer"), F.col("hit"))).alias("share"))
    return g.where("hit = 1").crossJoin(F.broadcast(share)).select("x", "y", F.round(F.when(F.col("box"), 1.0).otherwise(1 / F.col("share")), 6).alias("weight"))  # one row


@query("a25_density_compensation", A25)
def _(t):
    return density_weights(sampled(t.lineitem))


@query("c4_group_threshold", f"WITH c AS (SELECT line, part, channel, sum(re) AS re FROM ({CELLS}) GROUP BY ALL), n AS (SELECT *, sqrt(sum(re * re) OVER (PARTITION BY line, part)) AS norm FROM c) SELECT line, part, channel, round(re * greatest(1 - 1e6 / norm, 0), 3) AS soft, round(CASE WHEN norm > 1e6 THEN re ELSE 0 END, 3) AS hard FROM n")
def _(t):
    c = cells(t).groupBy("line", "part", "channel").agg(F.sum("re").alias("re"))
    norm = F.sqrt(F.sum(F.col("re") * F.col("re")).over(Window.partitionBy("line", "part")))
    return c.withColumn("norm", norm).select("line", "part", "channel", F.round(shrink.group_soft(F.col("re"), F.col("norm"), 1e6), 3).alias("soft"), F.round(shrink.group_hard(F.col("re"), F.col("norm"), 1e6), 3).alias("hard"))


@query("c8_group_huber", f"SELECT line, round(sum(CASE WHEN norm <= 1e6 THEN norm * norm / 2e6 ELSE norm - 5e5 END), 2) AS huber FROM (SELECT line, part, sqrt(sum(re * re)) AS norm FROM ({CELLS}) GROUP BY ALL) GROUP BY line")
def _(t):
    norms = cells(t).groupBy("line", "part").agg(F.sqrt(F.sum(F.col("re") * F.col("re"))).alias("norm"))
    return norms.groupBy("line").agg(F.round(F.sum(shrink.huber(F.col("norm"), 1e6)), 2).alias("huber"))


def gated_population(t, discard: int = 5, gates: int = 4):
    """Discards, gates, averages per gate, fills the grid and combines over users."""
    steady = discard_start(t.events, "user_id", ["ts", "event_id"], discard)
    pairs = G.in_gates(steady, G.gate_centroids(steady, "value", gates, tolerance=2.0), "value")
    each = G.populate(pairs, ["user_id", "event_type", "gate"], "value", ["ts", "event_id"])
    combined = each.groupBy("event_type", "gate").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("rss"))
    kinds = t.events.select("event_type").distinct().crossJoin(t.spark.range(gates).select(F.col("id").cast("int").alias("gate")))
    return kinds.join(combined, ["event_type", "gate"], "left").select("event_type", "gate", F.round(F.coalesce("rss", F.lit(0.0)), 4).alias("rss"))


X13 = f"""WITH steady AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r > 5 OR n <= 5),
{CENTROIDS.replace('FROM events', 'FROM steady').replace('/ 3 / 2 AS tolerance', '/ 3 AS tolerance')},
p AS (SELECT e.*, g.*, abs(value - centroid) AS distance FROM steady e JOIN gates g ON abs(value - centroid) < tolerance),
u AS (SELECT user_id, event_type, gate, sum(exp(-distance * distance / (2 * tolerance * tolerance)) * value) / sum(exp(-distance * distance / (2 * tolerance * tolerance))) AS v FROM p GROUP BY ALL),
c AS (SELECT event_type, gate, sqrt(sum(v * v)) AS rss FROM u GROUP BY ALL)
SELECT k.event_type, k.gate::INT AS gate, round(coalesce(rss, 0), 4) AS rss FROM (SELECT DISTINCT event_type, gate FROM events, range(4) g(gate)) k LEFT JOIN c ON c.event_type = k.event_type AND c.gate = k.gate"""


@query("x13_gated_population", X13)
def _(t):
    return gated_population(t)
