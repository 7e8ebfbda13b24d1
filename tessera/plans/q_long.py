"""All events as one series: windows, filters and interpolation without a task that holds it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import long_series as B
from tessera.operators.series import gaussian_taps

from .registry import query

ALL = "n AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS total FROM events)"


def one_series(t):
    e = t.events.select(F.lit("all").alias("series"), "ts", "event_id", "value")
    return B.placed(e, "series", ["ts", "event_id"])


TAPS = gaussian_taps(15)
SMOOTH = " + ".join(f"{v!r} * " + ("value" if i == 0 else f"{'lead' if i > 0 else 'lag'}(value, {abs(i)}, 0) OVER (ORDER BY i)") for i, v in TAPS.items())


@query("w5_long_series", f"WITH {ALL} SELECT event_id, round({SMOOTH}, 6) AS y FROM n")
def _(t):
    return B.smooth(one_series(t), "series", ["event_id"], "value", TAPS).withColumn("y", F.round("y", 6))


@query("w16_long_series", f"WITH {ALL} SELECT n.event_id, median(m.value) AS y FROM n, range(-3, 4) g(k) JOIN n m ON m.i = greatest(1, least(n.total, n.i + k)) GROUP BY 1")
def _(t):
    return B.moving_median(one_series(t), "series", ["event_id"], "value", 7)


@query("w8_long_series", f"WITH {ALL}, a AS (SELECT *, lag(value) OVER (ORDER BY i) AS b, lead(value) OVER (ORDER BY i) AS c FROM n), p AS (SELECT *, lead(i) OVER (ORDER BY i) - i AS gap FROM a WHERE value > b AND value > c), m AS (SELECT avg(value) AS mean, avg(gap) AS mean_gap FROM p) SELECT event_id, i FROM p, m WHERE NOT coalesce(value < mean / 1.5 AND gap < mean_gap, false)")
def _(t):
    numbered = one_series(t).withColumn("i", F.col("place") + 1)
    return B.find_peaks(numbered, "series", "i", "value", ["event_id", "i"])


@query("j7_long_series", f"""WITH {ALL}, k AS (SELECT i AS x, value AS y, lead(i) OVER v AS x1, lead(value) OVER v AS y1, lag(i) OVER v AS x0, lag(value) OVER v AS y0 FROM n WHERE i % 90 = 7 WINDOW v AS (ORDER BY i)),
j AS (SELECT n.i AS pos, k.* FROM n ASOF JOIN k ON n.i >= k.x WHERE n.i % 90 <> 7 UNION ALL SELECT n.i, k.* FROM n, k WHERE n.i < 7 AND k.x = 7)
SELECT pos::DOUBLE AS x, round(y + (pos - x) * CASE WHEN x1 IS NOT NULL THEN (y1 - y) / (x1 - x) WHEN x0 IS NOT NULL THEN (y - y0) / (x - x0) ELSE 0 END, 6) AS y FROM j""")
def _(t):
    n = one_series(t).select("series", (F.col("place") + 1).cast("double").alias("x"), F.col("value").alias("y"))
    return B.interpolate(n.where("x % 90 = 7"), n.where("x % 90 <> 7"), "series", "x", "y").select("x", F.round("y", 6).alias("y"))


LOW, HIGH = 0.05, 0.2


def impulse_response(low: float, high: float) -> list[float]:
    """Of the band-pass, until it has died away."""
    b, a = B.butterworth(low, high)
    y: list[float] = []
    while len(y) < 3 or max(map(abs, y[-8:])) > 1e-18:
        k = len(y)
        y.append((b[k] if k < 3 else 0.0) - (a[1] * y[k - 1] if k else 0.0) - (a[2] * y[k - 2] if k > 1 else 0.0))
    return [float(v) for v in y]


RESPONSE = ", ".join(f"({j}, {v!r}::DOUBLE)" for j, v in enumerate(impulse_response(LOW, HIGH)))


@query("x4_long_series", f"WITH {ALL}, h AS (SELECT * FROM (VALUES {RESPONSE}) v(j, w)), f AS (SELECT m.i + j AS i, sum(w * value) AS v FROM n m, h GROUP BY 1), g AS (SELECT m.i - j AS i, sum(w * v) AS v FROM (SELECT * FROM f WHERE i <= (SELECT max(i) FROM n)) m, h GROUP BY 1) SELECT event_id, round(v, 6) AS filtered FROM n JOIN g USING (i)")
def _(t):
    at = one_series(t)
    out = B.bandpass(at, "series", "value", LOW, HIGH)
    return at.select("event_id", "place").join(out, "place").select("event_id", F.round("filtered", 6).alias("filtered"))
