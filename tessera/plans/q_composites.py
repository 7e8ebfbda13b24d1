"""Composites in full: a motion signal from blocks of a record stream, and a gated population of classified records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators import grid as G
from tessera.operators import transforms as T
from tessera.operators.records import discard_start
from tessera.operators.series import gaussian_taps

from .q_grid import CENTROIDS
from .registry import query
from .scratch import materialize

TAPS = gaussian_taps(5)
BINS = (2, 3, 4)  # of 16 values: frequencies 0.125 to 0.25
POWER = " + ".join(f"pow(list_sum(list_transform(e, lambda v, i: v * {f}(2 * pi() * {k} * (i - 1) / 16))), 2)" for k in BINS for f in ("cos", "sin"))
MOTION = f"""WITH b AS (SELECT event_id // 64 AS block, event_id % 4 AS channel, list(value ORDER BY event_id) AS e FROM events GROUP BY ALL HAVING count(*) = 16),
c AS (SELECT channel FROM b GROUP BY 1 ORDER BY round(sum({POWER}), 3) DESC, channel LIMIT 1),
own AS (SELECT block, e FROM b JOIN c USING (channel)), r AS (SELECT arg_max(e, block) AS r FROM own),
cost AS (SELECT block, s, round(list_sum(list_transform(range(16), lambda i: pow(e[(i + s + 16) % 16 + 1] - r[i + 1], 2))), 9) AS cost FROM own, r, range(-4, 5) g(s)),
shift AS (SELECT block, arg_min(s, (cost, abs(s), s)) AS s FROM cost GROUP BY 1),
tap AS (SELECT * FROM (VALUES {", ".join(f"({i}, {w!r})" for i, w in TAPS.items())}) v(i, w)),
smooth AS (SELECT a.block, sum(w * coalesce(n.s, 0)) AS y FROM shift a CROSS JOIN tap LEFT JOIN shift n ON n.block = a.block + tap.i GROUP BY 1),
moved AS (SELECT block, y - (SELECT min(y) FROM smooth) AS y FROM smooth)
SELECT a.block, round((a.y + n.y) / 2, 6) AS y FROM moved a JOIN moved n ON n.block = a.block + 1"""


@query("x12_motion_from_blocks", MOTION)
def _(t):
    """Complete blocks, their band power, the channel that holds most of it, each block's shift to the last block, smoothed, with the least taken away, between the blocks.

    Blocks are one long series, so smoothing and interpolation join blocks with their neighbours rather than sorting them in a window.
    """
    e = t.events.select(F.floor(F.col("event_id") / 64).alias("block"), (F.col("event_id") % 4).alias("channel"), "event_id", "value")
    e = e.groupBy("block", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda r: r["value"]).alias("e"))  # 16 at most
    whole = materialize(e.where(F.size("e") == 16), "blocks")
    power = T.band_power(whole, "e", 0.1, 0.3, 1.0).groupBy("channel").agg(F.round(F.sum("power"), 3).alias("power"))
    best = power.orderBy(F.desc("power"), "channel").limit(1).select("channel")
    own = materialize(whole.join(F.broadcast(best), "channel").select("block", "e"), "channel")  # one row
    shifts = T.best_shift(own, "block", "e", own.orderBy(F.desc("block")).limit(1), 4).select("block", "shift")
    # a shift goes to the blocks whose taps reach it
    taps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in TAPS.items()))
    sent = materialize(shifts, "shifts").withColumn("t", F.explode(taps))
    smooth = sent.groupBy((F.col("block") - F.col("t.i")).alias("block")).agg(F.sum(F.col("t.w") * F.col("shift")).alias("y"), F.max(F.col("t.i") == 0).alias("there")).where("there")
    smooth = materialize(smooth.select("block", "y"), "smooth")
    moved = smooth.crossJoin(F.broadcast(smooth.agg(F.min("y").alias("low")))).select("block", (F.col("y") - F.col("low")).alias("y"))  # one row
    after = moved.select((F.col("block") - 1).alias("block"), F.col("y").alias("after"))
    return moved.join(after, "block").select("block", F.round((F.col("y") + F.col("after")) / 2, 6).alias("y"))


GATED = f"""WITH kept AS (SELECT * FROM events WHERE value > 20 AND event_id & 1 = 0),
steady AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM kept) WHERE r > 5 OR n <= 5),
{CENTROIDS.replace("FROM events", "FROM steady").replace("/ 3 / 2 AS tolerance", "/ 3 AS tolerance")},
p AS (SELECT e.*, g.*, abs(value - centroid) AS distance FROM steady e JOIN gates g ON abs(value - centroid) < tolerance),
each AS (SELECT user_id, event_type, gate, sum(exp(-distance * distance / (2 * tolerance * tolerance)) * value) / sum(exp(-distance * distance / (2 * tolerance * tolerance))) AS gauss, avg(value) AS average, arg_min(value, (distance, ts, event_id)) AS closest FROM p GROUP BY ALL),
c AS (SELECT event_type, gate, sqrt(sum(gauss * gauss)) AS gauss, sqrt(sum(average * average)) AS average, sqrt(sum(closest * closest)) AS closest FROM each GROUP BY ALL)
SELECT k.event_type, k.gate::INT AS gate, round(coalesce(gauss, 0), 4) AS gauss, round(coalesce(average, 0), 4) AS average, round(coalesce(closest, 0), 4) AS closest FROM (SELECT DISTINCT event_type, gate FROM events, range(4) g(gate)) k LEFT JOIN c ON c.event_type = k.event_type AND c.gate = k.gate"""


@query("x13_classified_population", GATED)
def _(t):
    """Image records only (large ones without the navigator bit), steady state, gates, each way to populate them, filled and combined over users."""
    image = t.events.where((F.col("value") > 20) & ~bits.bit(F.col("event_id"), 0))
    steady = materialize(discard_start(image, "user_id", ["ts", "event_id"], 5), "steady")
    pairs = G.in_gates(steady, G.gate_centroids(steady, "value", 4, tolerance=2.0), "value")
    w = F.exp(-F.col("distance") * F.col("distance") / (2 * F.col("tolerance") * F.col("tolerance")))
    each = pairs.groupBy("user_id", "event_type", "gate").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("gauss"), F.avg("value").alias("average"), F.min_by("value", F.struct("distance", "ts", "event_id")).alias("closest"))
    combined = each.groupBy("event_type", "gate").agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in ("gauss", "average", "closest")))
    kinds = t.events.select("event_type").distinct().crossJoin(t.spark.range(4).select(F.col("id").cast("int").alias("gate")))
    return kinds.join(combined, ["event_type", "gate"], "left").select("event_type", "gate", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("gauss", "average", "closest")))
