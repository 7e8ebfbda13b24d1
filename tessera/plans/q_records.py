"""Scans, filters, sorts, sets and scalar functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bits, complexes, shrink, special
from tessera.operators import records as R

from .registry import query

LINE = "l_orderkey % 64"


@query("s1_counter_ranges", "SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem WHERE l_linenumber = 3 AND l_suppkey BETWEEN 10 AND 40")
def _(t):
    return R.in_counter_ranges(t.lineitem, {"l_linenumber": 3, "l_suppkey": (10, 40)}).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


@query("s2_counter_profile", "SELECT 'l_linenumber' AS counter, min(l_linenumber)::BIGINT AS low, max(l_linenumber)::BIGINT AS high FROM lineitem UNION ALL SELECT 'l_suppkey', min(l_suppkey), max(l_suppkey) FROM lineitem UNION ALL SELECT 'l_partkey', min(l_partkey), max(l_partkey) FROM lineitem")
def _(t):
    return R.counter_profile(t.lineitem, ["l_linenumber", "l_suppkey", "l_partkey"])


@query("s2_profile_long_records", "SELECT 'l_linenumber' AS counter, min(l_linenumber)::BIGINT AS low, max(l_linenumber)::BIGINT AS high FROM lineitem WHERE l_quantity > 20 UNION ALL SELECT 'l_suppkey', min(l_suppkey), max(l_suppkey) FROM lineitem WHERE l_quantity > 20")
def _(t):
    return R.counter_profile(t.lineitem.where("l_quantity > 20"), ["l_linenumber", "l_suppkey"])


@query("s3_protocol_dims", "SELECT *, CASE WHEN l_linenumber > 1 AND l_suppkey > 1 THEN '3D' ELSE '2D' END AS rank_class FROM (SELECT (max(l_linenumber) - min(l_linenumber) + 1)::BIGINT AS l_linenumber, max(l_suppkey) - min(l_suppkey) + 1 AS l_suppkey FROM lineitem)")
def _(t):
    dims = R.extents(t.lineitem, ["l_linenumber", "l_suppkey"])
    return dims.withColumn("rank_class", F.when((F.col("l_linenumber") > 1) & (F.col("l_suppkey") > 1), "3D").otherwise("2D"))


@query("s3_distinct_dims", "SELECT count(DISTINCT l_linenumber) AS l_linenumber, count(DISTINCT l_suppkey) AS l_suppkey FROM lineitem")
def _(t):
    return R.extents(t.lineitem, ["l_linenumber", "l_suppkey"], distinct=True)


@query("s4_modal_length", "WITH d AS (SELECT doc_id, n_chars // 100 AS len FROM documents), m AS (SELECT len FROM d GROUP BY len ORDER BY count(*) DESC, len LIMIT 1) SELECT d.* FROM d JOIN m USING (len)")
def _(t):
    return R.modal_only(t.documents.select("doc_id", F.floor(F.col("n_chars") / 100).alias("len")), "len")


@query("s7_series_manifest", "SELECT split_part(url, '/', 3) AS folder, split_part(url, '/', 4) AS series, count(*) AS files, min(url) AS first_file, max(url) AS last_file FROM pages GROUP BY 1, 2")
def _(t):
    parts = F.split("url", "/")
    return t.pages.groupBy(F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("folder"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("series")).agg(F.count("*").alias("files"), F.min("url").alias("first_file"), F.max("url").alias("last_file"))


@query("s8_series_names", "SELECT DISTINCT regexp_replace(replace(source || ' ' || lang, ' ', '_'), '[*<>/&%$=+]', '', 'g') || '_' || lpad(substr(source, 4), 4, '0') AS name FROM documents")
def _(t):
    return t.documents.select(R.path_safe(F.concat_ws(" ", "source", "lang"), F.substring("source", 4, 9)).alias("name")).distinct()


@query("s9_djb2", "SELECT DISTINCT source, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(source, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 33 + c) % 4294967295)::BIGINT AS hash FROM documents")
def _(t):
    return t.documents.select("source").distinct().withColumn("hash", R.djb2(F.col("source")))


@query("s11_acquisition_time", "SELECT event_id, hour(ts) * 3600.0 + minute(ts) * 60.0 + second(ts) AS seconds, round((value - 10.0) * 2.0, 6) AS rescaled FROM events")
def _(t):
    seconds = R.time_of_day(F.date_format("ts", "HHmmss"))
    return t.events.select("event_id", seconds.alias("seconds"), F.round((F.col("value") - 10.0) * 2.0, 6).alias("rescaled")).orderBy("seconds", "event_id")


CLASSIFY = "CASE WHEN l_quantity > 20 THEN 'image' WHEN (l_suppkey & 1) > 0 THEN 'navigator' WHEN (l_suppkey & 2) > 0 THEN 'belt' WHEN (l_suppkey & 4) > 0 THEN 'ecg' ELSE 'none' END"


def classify(size, flags):
    return F.when(size > 20, "image").when(bits.bit(flags, 0), "navigator").when(bits.bit(flags, 1), "belt").when(bits.bit(flags, 2), "ecg").otherwise("none")


@query("f1_bit_classify", f"SELECT {CLASSIFY} AS class, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(classify(F.col("l_quantity"), F.col("l_suppkey")).alias("class")).agg(F.count("*").alias("n"))


@query("f2_reject_route", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'image' ELSE 'navigator' END AS route FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def _(t):
    route = F.when(F.col("event_type").isin("view", "click"), "image").when(F.col("event_type") == "purchase", "navigator")
    return t.events.select("event_id", route.alias("route")).where("route is not null")


@query("f3_evalmask", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE ((l_partkey * 4099) >> 21) & 1 = 0")
def _(t):
    return t.lineitem.where(~bits.bit(F.col("l_partkey") * 4099, 21)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f4_steady_state", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r > 10 OR n <= 10")
def _(t):
    return R.discard_start(t.events, "user_id", ["ts", "event_id"], 10).select("event_id", "user_id")


@query("f5_packed_gates", "SELECT o_orderkey, (o_custkey >> 8) & 255 AS high_field, (o_custkey & ~255::BIGINT) | (o_orderkey & 255) AS replaced FROM orders")
def _(t):
    return t.orders.select("o_orderkey", bits.field(F.col("o_custkey"), 1).alias("high_field"), bits.with_field(F.col("o_custkey"), 0, F.col("o_orderkey")).alias("replaced"))


@query("f6_enum_decode", "SELECT p_partkey, CASE p_size WHEN 10 THEN 0.5 WHEN 20 THEN 0.625 WHEN 30 THEN 0.75 WHEN 40 THEN 0.875 ELSE 1.0 END::DOUBLE AS fraction FROM part")
def _(t):
    codes = F.create_map(*(F.lit(x) for pair in ((10, 0.5), (20, 0.625), (30, 0.75), (40, 0.875)) for x in pair))
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(codes, F.col("p_size")), F.lit(1.0)).alias("fraction"))


@query("f7_ellipse_mask", f"SELECT {LINE} AS line, l_linenumber, count(*) AS n FROM lineitem WHERE pow((l_orderkey % 64 - 31.5) / 32, 2) + pow((l_linenumber - 4.0) / 3.5, 2) <= 1 GROUP BY 1, 2")
def _(t):
    inside = F.pow((F.col("l_orderkey") % 64 - 31.5) / 32, F.lit(2)) + F.pow((F.col("l_linenumber") - 4.0) / 3.5, F.lit(2)) <= 1
    return t.lineitem.where(inside).groupBy((F.col("l_orderkey") % 64).alias("line"), "l_linenumber").agg(F.count("*").alias("n"))


@query("f8_trailing_zeros", "WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS v FROM events) SELECT e.user_id, e.event_id, e.v FROM e JOIN (SELECT user_id, max(event_id) AS last FROM e WHERE v <> 0 GROUP BY user_id) USING (user_id) WHERE event_id <= last")
def _(t):
    e = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0).alias("v"))
    return R.trim_trailing_zeros(e, "user_id", "event_id", "v")


@query("u1_unique_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("u2_first_seen", "SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return R.first_seen(t.events, "user_id", ["ts", "event_id"]).orderBy("ts", "event_id")


@query("u3_set_difference", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 12")
def _(t):
    return t.nation.select("n_nationkey").subtract(t.supplier.where("s_suppkey < 12").select("s_nationkey"))


@query("u4_concat_records", "SELECT event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, value FROM events WHERE event_type = 'click'")
def _(t):
    e = t.events.select("event_id", "event_type", "value")
    return e.where("event_type = 'view'").unionByName(e.where("event_type = 'click'")).select("event_id", "value")


for how, text in (("first", "ORDER BY o_orderkey LIMIT 40"), ("last", "ORDER BY o_orderkey DESC LIMIT 40")):

    @query(f"k1_subset_{how}", f"SELECT o_orderkey, o_custkey FROM orders {text}")
    def _(t, how=how):
        return R.subset(t.orders.select("o_orderkey", "o_custkey"), how, 40, ["o_orderkey"])


for how, text in (("smallest", ""), ("largest", "DESC")):

    @query(f"k1_subset_{how}", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice {text}, o_orderkey {text} LIMIT 25")
    def _(t, how=how):
        return R.subset(t.orders.select("o_orderkey", "o_totalprice"), how, 25, ["o_totalprice", "o_orderkey"])


@query("k1_subset_uniform", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE i IN (SELECT floor(1 + k * (n - 1) / 24.0 + 0.5)::BIGINT FROM range(25) g(k), (SELECT max(n) AS n FROM r))")
def _(t):
    return R.subset(t.orders.select("o_orderkey"), "uniform", 25, ["o_orderkey"])


@query("k2_random_subset")
def _(t):
    return R.random_subset(t.orders.select("o_orderkey", "o_custkey"), 100, ["o_orderkey"], seed=5)


@query("k3_natural_sort", "SELECT c_name, array_to_string(list_transform(regexp_extract_all(c_name, '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), '') AS sort_key FROM customer")
def _(t):
    return t.customer.select("c_name", R.natural_key(F.col("c_name")).alias("sort_key")).orderBy("sort_key")


@query("k4_arg_extreme", "SELECT l_returnflag, arg_max(l_orderkey * 8 + l_linenumber, (l_quantity * l_extendedprice, -(l_orderkey * 8 + l_linenumber))) AS at_max, arg_min(l_orderkey * 8 + l_linenumber, (l_quantity * l_extendedprice, l_orderkey * 8 + l_linenumber)) AS at_min FROM lineitem GROUP BY 1")
def _(t):
    place, value = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_quantity") * F.col("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag").agg(F.max_by(place, F.struct(value, -place)).alias("at_max"), F.min_by(place, F.struct(value, place)).alias("at_min"))


X = "(value - 50)"
SOFT = f"sign({X}) * greatest(abs({X}) - 20, 0)"


@query("c1_soft_threshold", f"SELECT event_id, round({SOFT}, 6) AS y FROM events")
def _(t):
    return t.events.select("event_id", F.round(shrink.soft(F.col("value") - 50, 20.0), 6).alias("y"))


COMPLEX = "l_extendedprice AS re, l_discount * l_extendedprice AS im"


@query("c2_soft_complex", f"SELECT l_orderkey, l_linenumber, l_partkey, round(re * f, 4) AS re, round(im * f, 4) AS im FROM (SELECT *, greatest(1 - 20000 / sqrt(re * re + im * im), 0) AS f FROM (SELECT *, {COMPLEX} FROM lineitem))")
def _(t):
    re, im = shrink.soft_complex(F.col("l_extendedprice"), F.col("l_discount") * F.col("l_extendedprice"), 20000.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(re, 4).alias("re"), F.round(im, 4).alias("im"))


@query("c3_hard_threshold", f"SELECT event_id, CASE WHEN abs({X}) > 20 THEN {X} ELSE 0 END AS y FROM events")
def _(t):
    return t.events.select("event_id", shrink.hard(F.col("value") - 50, 20.0).alias("y"))


@query("c5_lp_threshold", f"WITH e AS (SELECT event_id, {X} AS x, abs({X}) AS a FROM events), s AS (SELECT *, a - 5 * pow(a, -0.5) AS b FROM e WHERE a > 0), s2 AS (SELECT *, a - 5 * pow(b, -0.5) AS c FROM s WHERE a > pow(10, 1 / 1.5) + 5 * pow(10, -0.5 / 1.5)) SELECT e.event_id, round(coalesce(sign(e.x) * (s2.a - 5 * pow(s2.c, -0.5)), 0), 6) AS y FROM e LEFT JOIN s2 USING (event_id)")
def _(t):
    return t.events.select("event_id", F.round(shrink.lp_soft(F.col("value") - 50, 10.0, 0.5), 6).alias("y"))


@query("c6_penalty_value", f"""SELECT round(sum(2 * least(a, 30)), 3) AS capped, round(sum(2 * ln(1 + a / 30)), 3) AS log,
 round(sum(CASE WHEN a <= 2 THEN 2 * a WHEN a <= 60 THEN (-a * a + 120 * a - 4) / 58 ELSE 62 END), 3) AS scad,
 round(sum(CASE WHEN a <= 60 THEN 2 * a - a * a / 60 ELSE 60 END), 3) AS mcp FROM (SELECT abs({X}) AS a FROM events)""")
def _(t):
    return t.events.agg(*(F.round(F.sum(shrink.penalty(k, F.col("value") - 50, 2.0, 30.0)), 3).alias(k) for k in ("capped", "log", "scad", "mcp")))


@query("c7_penalty_prox", f"""WITH e AS (SELECT event_id, {X} AS x, abs({X}) AS a FROM events),
c AS (SELECT *, greatest(a, 30) AS z1, least(30, greatest(a - 2, 0)) AS z2 FROM e)
SELECT event_id, round(sign(x) * CASE WHEN (z1 - a) * (z1 - a) / 2 + 2 * least(z1, 30) < (z2 - a) * (z2 - a) / 2 + 2 * least(z2, 30) THEN z1
 WHEN (z1 - a) * (z1 - a) / 2 + 2 * least(z1, 30) = (z2 - a) * (z2 - a) / 2 + 2 * least(z2, 30) THEN least(z1, z2) ELSE z2 END, 6) AS capped,
 round(CASE WHEN a > 60 THEN x WHEN a <= 2 THEN 0 ELSE sign(x) * 30 * (a - 2) / 29 END, 6) AS mcp FROM c""")
def _(t):
    x = F.col("value") - 50
    return t.events.select("event_id", F.round(shrink.penalty_prox("capped", x, 2.0, 30.0), 6).alias("capped"), F.round(shrink.penalty_prox("mcp", x, 2.0, 30.0), 6).alias("mcp"))


@query("c7_prox_others")
def _(t):
    x = F.col("value") - 50
    return t.events.select("event_id", F.round(shrink.penalty_prox("log", x, 2.0, 30.0), 6).alias("log"), F.round(shrink.penalty_prox("scad", x, 2.0, 30.0), 6).alias("scad"))


@query("c9_sigmoid_family", """SELECT event_id, round(1 / (1 + exp(-x)), 6) AS s, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS ds, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) AS g,
 round(-x * exp(-x * x / 2) / sqrt(2 * pi()), 6) AS dg, round((x * x - 1) * exp(-x * x / 2) / sqrt(2 * pi()), 6) AS ddg, round(CASE WHEN abs(x) < 1 THEN (1 + cos(pi() * x)) / 2 ELSE 0 END, 6) AS rc FROM (SELECT event_id, (value - 50) / 25 AS x FROM events)""")
def _(t):
    x = (F.col("value") - 50) / 25
    parts = {"s": special.sigmoid(x), "ds": special.sigmoid_slope(x), "g": special.gaussian(x), "dg": special.gaussian(x, order=1), "ddg": special.gaussian(x, order=2), "rc": special.raised_cosine(x)}
    return t.events.select("event_id", *(F.round(v, 6).alias(k) for k, v in parts.items()))


@query("c10_complex_ops", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000 AS a, l_discount * l_extendedprice / 1000 AS b, l_quantity AS c, l_tax * 100 + 1 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(a * c - b * d, 9) AS mul_re, round(a * d + b * c, 9) AS mul_im, floor((a * c + b * d) / (c * c + d * d) * 1e9 + 0.5) / 1e9 AS div_re, floor((b * c - a * d) / (c * c + d * d) * 1e9 + 0.5) / 1e9 AS div_im, round(pow(sqrt(a * a + b * b), 1.5), 6) AS size FROM c""")
def _(t):
    x = (F.col("l_extendedprice") / 1000, F.col("l_discount") * F.col("l_extendedprice") / 1000)
    y = (F.col("l_quantity"), F.col("l_tax") * 100 + 1)
    mul, div = complexes.multiply(x, y), complexes.divide(x, y)

    def nearest(value):  # half up in doubles, which both engines compute alike
        return F.floor(value * 1e9 + 0.5) / F.lit(1e9)

    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(mul[0], 9).alias("mul_re"), F.round(mul[1], 9).alias("mul_im"), nearest(div[0]).alias("div_re"), nearest(div[1]).alias("div_im"), F.round(complexes.magnitude(x, 1.5), 6).alias("size"))


@query("c10_complex_dot", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity + l_discount * l_extendedprice * l_tax), 2) AS re, round(sum(l_discount * l_extendedprice * l_quantity - l_extendedprice * l_tax), 2) AS im FROM lineitem GROUP BY 1")
def _(t):
    re, im = complexes.multiply((F.col("l_extendedprice"), F.col("l_discount") * F.col("l_extendedprice")), complexes.conjugate((F.col("l_quantity"), F.col("l_tax"))))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(re), 2).alias("re"), F.round(F.sum(im), 2).alias("im"))


@query("c12_taper", """SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * i / 63)))), 6) AS hann, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (0.54 - 0.46 * cos(2 * pi() * i / 63)))), 6) AS hamming,
 round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (1 - pow(2 * i / 63.0 - 1, 2)))), 6) AS welch, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * sin(pi() * i / 63))), 6) AS cosine FROM embeddings""")
def _(t):
    def tapered(kind):
        weighted = F.transform("embedding", lambda v, i: v.cast("double") * special.taper(kind, i.cast("double"), 64))
        return F.round(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v), 6).alias(kind)

    return t.embeddings.select("vec_id", *map(tapered, ("hann", "hamming", "welch", "cosine")))
