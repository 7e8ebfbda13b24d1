"""Streams over events and orders; each result equals its batch twin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.streaming import stages as S

from .q_grid import fixed_gates
from .registry import query


@query("t1_stream_accumulate", "SELECT event_id // 100 AS key, event_id % 10 AS cell, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(t):
    e = t.events.select("event_id", "value", F.floor(F.col("event_id") / 100).alias("m"), (F.col("event_id") % 10).alias("cell"), (F.col("event_id") % 100 == 99).alias("last"))
    feed = S.replay(e, "event_id", 3, clock=True)
    return S.drained(S.accumulate(feed.stream, "m", "cell", "value", "event_id", "last"), feed).where("cell is not null").drop("batch")


@query("t2_stream_reject_route", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'navigator' ELSE 'image' END AS route FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def _(t):
    feed = S.replay(t.events, "event_id", 3)
    routed = S.reject_route(feed.stream, "event_type", {"view": "image", "click": "image", "purchase": "navigator"})
    return S.drained(routed.select("event_id", "route"), feed).drop("batch")


@query("t3_stream_stack", "SELECT event_id // 8 AS key, count(*) AS slots, round(sum(value), 6) AS total FROM events GROUP BY 1 HAVING count(*) = 8")
def _(t):
    e = t.events.select(F.floor(F.col("event_id") / 8).alias("k"), (F.col("event_id") % 8).alias("slot"), "value", "event_id")
    feed = S.replay(e, "event_id", 3)
    return S.drained(S.stack(feed.stream, "k", "slot", "value", 8), feed).select("key", "slots", F.round("total", 6).alias("total"))


@query("t5_stream_split_combine", "SELECT o_orderkey // 64 AS key, count(*) AS slots, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) = 64")
def _(t):
    o = t.orders.select(F.floor(F.col("o_orderkey") / 64).alias("block"), F.col("o_orderkey").alias("part"), "o_totalprice")
    feed = S.replay(o, "part", 3)
    return S.drained(S.stack(feed.stream, "block", "part", "o_totalprice", 64), feed).select("key", "slots", F.round("total", 2).alias("total"))


GATES = "SELECT gate, 10.0 + 20 * gate AS centroid, 12.0 AS tolerance FROM range(5) g(gate)"


@query("t6_stream_gate_population", f"SELECT event_type, gate, round(sum(exp(-pow(value - centroid, 2) / 288) * value) / sum(exp(-pow(value - centroid, 2) / 288)), 6) AS value, count(*) AS n FROM events JOIN ({GATES}) g ON abs(value - centroid) < tolerance GROUP BY ALL")
def _(t):
    feed = S.replay(t.events, "event_id", 3)
    out = S.gate_population(feed.stream, fixed_gates(t), "value", ["event_type"])
    return S.latest(S.drained(out, feed, "update"), ["event_type", "gate"]).select("event_type", "gate", F.round("value", 6).alias("value"), "n")


@query("t7_windowed_counter", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def _(t):
    feed = S.replay(t.events, "event_id", 3)
    return S.drained(S.windowed_counts(feed.stream, "ts", "event_type", "1 day", "2 hours"), feed).drop("batch")


@query("t8_chain_config", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id BETWEEN 10 AND 90) WHERE r > 5 OR n <= 5")
def _(t):
    stages = [(R.in_counter_ranges, {"ranges": {"user_id": (10, 90)}}), (R.discard_start, {"series": "user_id", "order": ["ts", "event_id"], "n": 5})]
    return S.chain(t.events, stages).select("event_id", "user_id")


@query("t9_grouped_udf", "SELECT user_id, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS spread FROM events GROUP BY 1")
def _(t):
    @F.pandas_udf("double")
    def spread(values: pd.Series) -> float:
        return float(values.quantile(0.75) - values.quantile(0.25))

    return t.events.groupBy("user_id").agg(spread("value").alias("s")).select("user_id", F.round("s", 6).alias("spread"))


@query("x12_motion_signal")
def _(t):
    """Means per user and six hours, smoothed, least value removed, interpolated to the middle of each six hours."""
    from tessera.operators import series as Q

    at = F.floor(F.unix_timestamp("ts") / 21600).cast("double")
    knots = t.events.groupBy("user_id", at.alias("x")).agg(F.avg("value").alias("y"))
    w = Q.along("user_id", "x")
    smooth = knots.withColumn("y", Q.smooth("y", w, Q.gaussian_taps(5)))
    least = smooth.groupBy("user_id").agg(F.min("y").alias("low"))
    smooth = smooth.join(least, "user_id").select("user_id", "x", (F.col("y") - F.col("low")).alias("y"))
    raster = smooth.select("user_id", (F.col("x") + 0.5).alias("x"))
    return Q.interpolate(smooth, raster, "user_id", "x", "y").withColumn("y", F.round("y", 6))
