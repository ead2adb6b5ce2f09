"""Queries over what feedback and messages leave behind from period to period (WIN-22, SCL-22)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from threadlake.operators import adaptive, prefetch
from threadlake.plans.registry import query
from threadlake.session import shared_dir
from threadlake.sources.tables import EV, event_messages
from threadlake.streaming.messages import drain, event_stream

RULE = adaptive.Rule(least=30)
HOURS = 48


def feedback(events):
    """Events as feedback to suggestions: the kind says what was done, the value how similar it was."""
    action = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "click", "edited").when(F.col("event_type") == "error", "dismissed")
    return events.select(F.lit("all").alias("key"), F.col("date").alias("ts"), (F.col("value") / (F.col("value") + 50)).alias("similarity"), action.alias("action"))


def _walk(target: float, least: int, base: float) -> str:
    return f"coalesce((SELECT min(start) FILTER (run = 1) FROM (SELECT start, min((good / n >= {target})::INT) OVER (ORDER BY start DESC ROWS UNBOUNDED PRECEDING) AS run FROM b WHERE b.period = p.period AND n >= {least})), {base})"


_OPTIMAL = f"""
f AS (SELECT CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'click' THEN 'edited' WHEN 'error' THEN 'dismissed' END AS action, floor(epoch(date::TIMESTAMP) // 1 / {3600 * HOURS})::BIGINT AS period, least(greatest(floor(round(value / (value + 50) / 0.05, 9)), 0), 19)::INT AS bucket FROM {EV}),
b AS (SELECT period, round(bucket * 0.05, 2) AS start, count(*) AS n, count(*) FILTER (action IN ('sent', 'edited')) AS good FROM f WHERE action IS NOT NULL AND bucket IS NOT NULL GROUP BY 1, bucket),
s AS (SELECT period, sum(n)::BIGINT AS n FROM b GROUP BY 1),
w AS (SELECT period, n, {_walk(0.70, 5, 0.95)} AS q, {_walk(0.70 * 0.85, 3, 0.65)} AS c0, {_walk(0.70 * 0.70, 3, 0.45)} AS g0 FROM s p),
o AS (SELECT *, row_number() OVER (ORDER BY period) AS k, CASE WHEN c0 >= q THEN q - 0.1 ELSE c0 END AS c FROM w),
x AS (SELECT *, CASE WHEN g0 >= c THEN c - 0.1 ELSE g0 END AS g FROM o),
r(k, q, c, g) AS (SELECT 0::BIGINT, 0.95::DOUBLE, 0.65::DOUBLE, 0.45::DOUBLE UNION ALL
  SELECT x.k, CASE WHEN x.n < 30 THEN r.q ELSE greatest(0.80, least(0.99, r.q + 0.2 * (x.q - r.q))) END, CASE WHEN x.n < 30 THEN r.c ELSE greatest(0.50, least(0.85, r.c + 0.2 * (x.c - r.c))) END, CASE WHEN x.n < 30 THEN r.g ELSE greatest(0.30, least(0.65, r.g + 0.2 * (x.g - r.g))) END FROM r JOIN x ON x.k = r.k + 1),
rows AS (SELECT 'all' AS key, period, n, round(CASE WHEN n < 30 THEN 0.95 ELSE r.q END, 6) AS quick, round(CASE WHEN n < 30 THEN 0.65 ELSE r.c END, 6) AS context, round(CASE WHEN n < 30 THEN 0.45 ELSE r.g END, 6) AS generate, n < 30 AS fallback FROM x JOIN r USING (k))"""


def _shown(df):
    return df.select("key", "period", "n", *[F.round(c, 6).alias(c) for c in adaptive.NAMES], "fallback")


@query("win22_adaptive_thresholds", f"WITH RECURSIVE {_OPTIMAL} SELECT * FROM rows")
def adaptive_thresholds(spark, sf_dir):
    return _shown(adaptive.adapted(feedback(event_messages(spark, sf_dir)), HOURS, RULE))


@query("win22_threshold_stream", f"WITH RECURSIVE {_OPTIMAL} SELECT * FROM rows WHERE period < (SELECT max(period) FROM rows)")
def threshold_stream(spark, sf_dir):
    """The same from the stream's state: the last period is still open."""
    return _shown(drain(adaptive.adapted_stream(feedback(event_stream(spark, f"{sf_dir}/events.parquet")), HOURS, RULE), "append"))


_HOURS = f"hours AS (SELECT chat_id, hour(date::TIMESTAMP)::INT AS hour, count(*)::DOUBLE AS weight FROM {EV} WHERE NOT is_from_me GROUP BY 1, 2)"


@query("scl22_time_of_day", f"""
WITH {_HOURS}, s AS (SELECT ((hour + d + 24) % 24)::INT AS hour, chat_id, round(sum(weight * CASE d WHEN 0 THEN 1 ELSE 0.5 END), 6) AS score FROM hours, (VALUES (0), (1), (-1)) t(d) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY score DESC, chat_id) AS r FROM s) SELECT hour, chat_id, score, round(least(score / 20, 0.9), 6) AS confidence FROM r WHERE r <= 3 AND score >= 2""")
def time_of_day(spark, sf_dir):
    return prefetch.time_of_day(prefetch.hour_weights(event_messages(spark, sf_dir)))


@query("scl22_access_state", f"WITH a AS (SELECT chat_id, hour(date::TIMESTAMP)::INT AS hour, sum(power(2, (epoch_us(date::TIMESTAMP) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 / 7)) AS w FROM {EV} WHERE NOT is_from_me GROUP BY 1, 2) SELECT chat_id, hour, round(w * power(2, -30 / 7.0), 6) AS weight FROM a")
def access_state(spark, sf_dir):
    """Decayed hour weights as a stream leaves them after its batches, as of the thirtieth day; half-life of a week."""
    base = f"{shared_dir(spark)}/access-{uuid4().hex}"
    prefetch.follow(event_stream(spark, f"{sf_dir}/events.parquet"), base, 7.0)
    hours = prefetch.latest(spark, base, "hours", "chat_id long, hour int, weight double")
    return prefetch.decayed(hours, "2024-01-31", 7.0).withColumn("weight", F.round("weight", 6))


@query("scl22_continuation", f"""
WITH m AS (SELECT chat_id, epoch_us(date::TIMESTAMP) / 1000000.0 AS s FROM {EV}), a AS (SELECT chat_id, s, (ceil(s / 3600) + k) * 3600 AS mark FROM m, range(7) r(k)),
g AS (SELECT mark, chat_id, count(*) AS n, mark - max(s) AS since FROM a WHERE mark - s < 21600 GROUP BY 1, 2), c AS (SELECT *, round((1 - since / 21600) * 0.7 + least(n / 10, 1) * 0.3, 6) AS confidence FROM g)
SELECT make_timestamp((mark * 1000000)::BIGINT) AS "at", chat_id, n, confidence, CASE WHEN since < 300 THEN 'high' WHEN since < 900 THEN 'medium' ELSE 'low' END AS priority FROM c WHERE confidence >= 0.5""")
def continuation(spark, sf_dir):
    return prefetch.continuation(event_messages(spark, sf_dir), 3600, 21600, 0.5)
