"""Window and sequential queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlake.operators import aggregates as agg
from threadlake.operators import messages as ops
from threadlake.operators import sequences as seq
from threadlake.plans.aggregates import ACTIONS, actions
from threadlake.plans.registry import query
from threadlake.sources.tables import CV, EV, chat_messages, event_messages

REPLIES = f"""(SELECT id, chat_id, is_from_me AS mine, date_diff('microsecond', prev, date) / 60000000.0 AS minutes, hour(prev)::INT AS hour, (dayofweek(prev) + 6) % 7 AS weekday
  FROM (SELECT *, lag(date) OVER w AS prev, lag(is_from_me) OVER w AS prev_mine FROM {EV} WINDOW w AS (PARTITION BY chat_id ORDER BY date, id))
  WHERE prev_mine <> is_from_me AND date_diff('microsecond', prev, date) > 0 AND date_diff('microsecond', prev, date) < 86400000000)"""
STATS = "count(*) AS n, round(avg(minutes), 4) AS avg_minutes, round(median(minutes), 4) AS median_minutes, round(min(minutes), 4) AS min_minutes, round(max(minutes), 4) AS max_minutes"
DAILY = f"(SELECT date::DATE AS day, count(*) AS n FROM {EV} GROUP BY 1)"
CHAT_DAILY = f"(SELECT chat_id, date::DATE AS day, count(*) AS n FROM {EV} GROUP BY 1, 2)"


def daily(spark, sf_dir, *keys):
    return event_messages(spark, sf_dir).groupBy(*keys, F.to_date("date").alias("day")).agg(F.count("*").alias("n"))


@query("win01_latest_per_chat", f"SELECT id, chat_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY date DESC, id DESC) AS rn FROM {EV}) WHERE rn <= 3")
def latest_per_chat(spark, sf_dir):
    return ops.latest_per_chat(event_messages(spark, sf_dir), 3).select("id", "chat_id", "rn")


@query("win02_around", f"SELECT id, date FROM (SELECT id, date FROM {EV} ORDER BY abs(id - 500), id LIMIT 11) ORDER BY date, id")
def around(spark, sf_dir):
    return ops.around(event_messages(spark, sf_dir).select("id", "date"), 500, 5)


@query("win03_response_times", f"SELECT chat_id, mine, {STATS} FROM {REPLIES} GROUP BY 1, 2")
def response_times(spark, sf_dir):
    return seq.response_stats(seq.response_times(event_messages(spark, sf_dir)), ["chat_id", "mine"])


@query("win03_response_by_hour", f"SELECT hour, {STATS} FROM {REPLIES} GROUP BY 1")
def response_by_hour(spark, sf_dir):
    return seq.response_stats(seq.response_times(event_messages(spark, sf_dir)), ["hour"])


@query("win03_response_by_weekday", f"SELECT weekday::INT AS weekday, {STATS} FROM {REPLIES} GROUP BY 1")
def response_by_weekday(spark, sf_dir):
    return seq.response_stats(seq.response_times(event_messages(spark, sf_dir)), ["weekday"])


@query("win04_message_trend", f"""
WITH r AS (SELECT chat_id, epoch_us(date) AS t, row_number() OVER (PARTITION BY chat_id ORDER BY date, id) AS rn, count(*) OVER (PARTITION BY chat_id) AS k FROM {EV}),
g AS (SELECT chat_id, k, count(*) FILTER (rn <= k // 2) / greatest((max(t) FILTER (rn <= k // 2) - min(t) FILTER (rn <= k // 2)) / 86400000000.0, 1.0) AS a, count(*) FILTER (rn > k // 2) / greatest((max(t) FILTER (rn > k // 2) - min(t) FILTER (rn > k // 2)) / 86400000000.0, 1.0) AS b FROM r GROUP BY 1, 2 HAVING k >= 4)
SELECT chat_id, round(a, 4) AS first_rate, round(b, 4) AS second_rate, CASE WHEN (b - a) / a * 100 > 15 THEN 'increasing' WHEN (b - a) / a * 100 < -15 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""")
def message_trend(spark, sf_dir):
    w = Window.partitionBy("chat_id")
    m = event_messages(spark, sf_dir).select("chat_id", F.unix_micros("date").alias("t"), F.row_number().over(w.orderBy("date", "id")).alias("rn"), F.count("*").over(w).alias("k"))
    early = F.col("rn") <= F.floor(F.col("k") / 2)
    rate = lambda c: F.count_if(c) / F.greatest((F.max(F.when(c, F.col("t"))) - F.min(F.when(c, F.col("t")))) / 86400000000.0, F.lit(1.0))
    g = m.groupBy("chat_id", "k").agg(rate(early).alias("a"), rate(~early).alias("b")).where("k >= 4")
    return g.select("chat_id", F.round("a", 4).alias("first_rate"), F.round("b", 4).alias("second_rate"), seq.trend_label((F.col("b") - F.col("a")) / F.col("a") * 100, 15.0).alias("direction"))


HALVES = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY day) AS rn, count(*) OVER (PARTITION BY {key}) AS k FROM {daily}),
g AS (SELECT {key}, k, avg(n) FILTER (rn <= k // 2) AS a, avg(n) FILTER (rn > k // 2) AS b FROM r GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN k < 2 THEN 0 WHEN a = 0 THEN CASE WHEN b > 0 THEN 100 ELSE 0 END ELSE (b - a) / a * 100 END AS ch FROM g)
SELECT {out} round(a, 4) AS first_avg, round(b, 4) AS second_avg, round(ch, 4) AS change, CASE WHEN ch > 10 THEN 'increasing' WHEN ch < -10 THEN 'decreasing' ELSE 'stable' END AS direction FROM c"""


@query("win05_frequency_trend", HALVES.format(key="one", daily=f"(SELECT 1 AS one, * FROM {DAILY})", out=""))
def frequency_trend(spark, sf_dir):
    return seq.half_split_trend(daily(spark, sf_dir))


@query("win05_frequency_trend_by_chat", HALVES.format(key="chat_id", daily=CHAT_DAILY, out="chat_id,"))
def frequency_trend_by_chat(spark, sf_dir):
    return seq.half_split_trend(daily(spark, sf_dir, "chat_id"), "chat_id")


ENDS = f"""WITH r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY chat_id) AS days, n - lag(n) OVER w AS step FROM {CHAT_DAILY} WINDOW w AS (PARTITION BY chat_id ORDER BY day)),
g AS (SELECT chat_id, days, avg(n) FILTER (rn <= 3) AS a, avg(n) FILTER (rn > days - 3) AS b, count(*) FILTER (step > 0) AS up, count(*) FILTER (step < 0) AS down FROM r GROUP BY 1, 2 HAVING days >= 4),
c AS (SELECT *, CASE WHEN a = 0 THEN CASE WHEN b > 0 THEN 100 ELSE 0 END ELSE (b - a) / a * 100 END AS ch FROM g),
t AS (SELECT chat_id, days, round(ch, 4) AS change, CASE WHEN ch > 10 THEN 'increasing' WHEN ch < -10 THEN 'decreasing' ELSE 'stable' END AS direction,
  round(CASE WHEN ch > 10 THEN up / (days - 1) WHEN ch < -10 THEN down / (days - 1) ELSE greatest(0.5, 1 - abs(ch) / 100) END, 4) AS confidence FROM c) """


@query("win06_trend", ENDS + "SELECT * FROM t")
def trend(spark, sf_dir):
    return seq.ends_trend(daily(spark, sf_dir, "chat_id"), "chat_id")


@query("win07_anomalies", f"WITH s AS (SELECT avg(n) AS m, stddev_pop(n) AS sd, count(*) AS k FROM {DAILY}) SELECT day::VARCHAR AS day, n, round((n - m) / sd, 4) AS z, CASE WHEN n > m THEN 'spike' ELSE 'drop' END AS kind FROM {DAILY} d, s WHERE k >= 5 AND sd > 0 AND abs((n - m) / sd) >= 1.5")
def anomalies(spark, sf_dir):
    return seq.anomalies(daily(spark, sf_dir), limit=1.5).withColumn("day", F.col("day").cast("string"))


@query("win08_peak_periods", f"SELECT hour(date)::INT AS hour, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {EV}), 4) AS share FROM {EV} GROUP BY 1 ORDER BY n DESC, hour LIMIT 3")
def peaks(spark, sf_dir):
    h = event_messages(spark, sf_dir).groupBy(F.hour("date").alias("hour")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # 24 rows
    return h.withColumn("share", F.round(100.0 * F.col("n") / total, 4)).orderBy(F.desc("n"), "hour").limit(3)


@query("win09_seasonality", f"""
WITH b AS (SELECT dayname(day) AS weekday, avg(n) AS mean, count(*) AS days FROM {DAILY} GROUP BY 1), o AS (SELECT sum(days) AS k, avg(mean) AS overall FROM b)
SELECT weekday, round(mean, 4) AS mean, round(mean / overall, 4) AS share, CASE WHEN mean / overall > 1.3 THEN 'high' WHEN mean / overall < 0.7 THEN 'low' ELSE 'normal' END AS kind FROM b, o WHERE k >= 28""")
def seasonality(spark, sf_dir):
    return seq.weekday_pattern(daily(spark, sf_dir))


@query("win10_trending_contacts", ENDS + "SELECT * FROM t WHERE abs(change) > 15 AND confidence > 0.5 ORDER BY abs(change) DESC, chat_id LIMIT 5")
def trending(spark, sf_dir):
    t = seq.ends_trend(daily(spark, sf_dir, "chat_id"), "chat_id")
    return t.where("abs(change) > 15 AND confidence > 0.5").orderBy(F.desc(F.abs("change")), "chat_id").limit(5)


@query("win11_compare_periods", f"""
WITH m AS (SELECT date, (SELECT max(ts) FROM events) AS now FROM {EV}), g AS (SELECT count(*) FILTER (date >= now - INTERVAL 7 DAY) AS current, count(*) FILTER (date < now - INTERVAL 7 DAY AND date >= now - INTERVAL 14 DAY) AS previous FROM m)
SELECT current, previous, round(CASE WHEN previous = 0 THEN CASE WHEN current > 0 THEN 100 ELSE 0 END ELSE (current - previous) / previous * 100 END, 4) AS change FROM g""")
def compare_periods(spark, sf_dir):
    return seq.compare_periods(event_messages(spark, sf_dir), 7)


@query("win12_trend_bundle", ENDS + "SELECT direction, count(*) AS chats, round(avg(change), 4) AS mean_change, round(avg(confidence), 4) AS mean_confidence FROM t GROUP BY 1")
def bundle(spark, sf_dir):
    return seq.ends_trend(daily(spark, sf_dir, "chat_id"), "chat_id").groupBy("direction").agg(F.count("*").alias("chats"), F.round(F.avg("change"), 4).alias("mean_change"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query("win14_health", f"""
WITH c AS (SELECT chat_id, count(*) AS total, count(*) FILTER (is_from_me) AS sent, count(DISTINCT date::DATE) AS days, date_diff('day', min(date::DATE), max(date::DATE)) + 1 AS span FROM {EV} GROUP BY 1),
r AS (SELECT chat_id, avg(minutes) AS m FROM {REPLIES} GROUP BY 1),
s AS (SELECT c.chat_id, least(sent, total - sent) / greatest(sent, total - sent, 1) * 100 * 0.6 + least(round(total / days, 2) * 10, 100) * 0.4 AS engagement,
  CASE WHEN m IS NULL THEN 50 WHEN m <= 5 THEN 100 WHEN m <= 30 THEN 80 WHEN m <= 120 THEN 60 WHEN m <= 480 THEN 40 ELSE 20 END AS responsiveness, CASE WHEN days > 1 THEN days / span * 100 ELSE 50 END AS consistency FROM c LEFT JOIN r USING (chat_id)),
h AS (SELECT *, 0.3 * engagement + 0.25 * 50 + 0.25 * responsiveness + 0.2 * consistency AS overall FROM s)
SELECT chat_id, round(engagement, 4) AS engagement, responsiveness::DOUBLE AS responsiveness, round(consistency, 4) AS consistency, round(overall, 4) AS overall,
  CASE WHEN overall >= 80 THEN 'excellent' WHEN overall >= 60 THEN 'good' WHEN overall >= 40 THEN 'fair' WHEN overall >= 20 THEN 'needs_attention' ELSE 'concerning' END AS label FROM h""")
def health(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    c = m.groupBy("chat_id").agg(F.count("*").alias("total"), F.count_if("is_from_me").alias("sent"), F.countDistinct(F.to_date("date")).alias("days"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("span"))
    r = seq.response_times(m).groupBy("chat_id").agg(F.avg("minutes").alias("m"))
    x = c.join(r, "chat_id", "left")
    other = F.col("total") - F.col("sent")
    balance = F.least("sent", other) / F.greatest(F.col("sent"), other, F.lit(1)) * 100
    engagement = balance * 0.6 + F.least(F.round(F.col("total") / F.col("days"), 2) * 10, F.lit(100.0)) * 0.4
    quick = F.when(F.col("m").isNull(), 50.0).when(F.col("m") <= 5, 100.0).when(F.col("m") <= 30, 80.0).when(F.col("m") <= 120, 60.0).when(F.col("m") <= 480, 40.0).otherwise(20.0)
    steady = F.when(F.col("days") > 1, F.col("days") / F.col("span") * 100).otherwise(50.0)
    overall = 0.3 * engagement + 0.25 * 50 + 0.25 * quick + 0.2 * steady
    label = F.when(overall >= 80, "excellent").when(overall >= 60, "good").when(overall >= 40, "fair").when(overall >= 20, "needs_attention").otherwise("concerning")
    return x.select("chat_id", F.round(engagement, 4).alias("engagement"), quick.alias("responsiveness"), F.round(steady, 4).alias("consistency"), F.round(overall, 4).alias("overall"), label.alias("label"))


@query("win15_leaderboard", f"SELECT chat_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, chat_id) AS rank FROM {EV} GROUP BY 1 ORDER BY rank LIMIT 10")
def leaderboard(spark, sf_dir):
    top = event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chat_id").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "chat_id")))  # 10 rows


GAPS = f"(SELECT *, sum(CASE WHEN prev IS NULL OR date_diff('microsecond', prev, date) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY date, id) AS island FROM (SELECT *, lag(date) OVER (PARTITION BY chat_id ORDER BY date, id) AS prev FROM {EV}))"


@query("win16_threads", f"SELECT chat_id, island::BIGINT AS island, count(*) AS n, min(date) AS first_date, max(date) AS last_date, substr(sha256(chat_id || ':' || arg_min(id, (date, id))), 1, 16) AS thread_id FROM {GAPS} GROUP BY 1, 2")
def threads(spark, sf_dir):
    return seq.gap_threads(event_messages(spark, sf_dir)).groupBy("chat_id", "island", "thread_id").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("win16_bounded_threads", f"""
WITH RECURSIVE r AS (SELECT id, chat_id, date, row_number() OVER (PARTITION BY chat_id ORDER BY date, id) AS rn FROM {EV}),
t(id, chat_id, date, rn, began, thread) AS (SELECT id, chat_id, date, rn, date, 1 FROM r WHERE rn = 1
  UNION ALL SELECT r.id, r.chat_id, r.date, r.rn, CASE WHEN cut THEN r.date ELSE began END, thread + cut::INT
  FROM (SELECT r.*, t.began, t.thread, r.date > t.date + INTERVAL 720 MINUTE OR r.date > t.began + INTERVAL 1440 MINUTE AS cut FROM t JOIN r ON r.chat_id = t.chat_id AND r.rn = t.rn + 1) r)
SELECT id, chat_id, thread FROM t""")
def bounded_threads(spark, sf_dir):
    from threadlake.session import ship

    ship(spark)
    return seq.bounded_threads(event_messages(spark, sf_dir), gap_minutes=720, longest_minutes=1440)


@query("win20_turns", f"""
WITH f AS (SELECT *, CASE WHEN lag(sender) OVER w IS NULL OR lag(sender) OVER w <> sender THEN 1 ELSE 0 END AS new FROM {CV} WINDOW w AS (PARTITION BY chat_id ORDER BY date, id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY chat_id ORDER BY date, id) AS island FROM f),
g AS (SELECT chat_id, island, sender, count(*) AS n, string_agg(coalesce(text, ''), chr(10) ORDER BY date, id) AS text FROM i WHERE NOT is_system GROUP BY 1, 2, 3)
SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY island) AS turn, sender, n, md5(text) AS digest FROM g""")
def turns(spark, sf_dir):
    return seq.turns(chat_messages(spark, sf_dir)).select("chat_id", "turn", "sender", "n", F.md5("text").alias("digest"))


@query("win21_since_watermark", f"""
WITH k AS (SELECT chat_id, max(date) AS end_time FROM {EV} WHERE date < '2024-01-15' GROUP BY 1),
m AS (SELECT id, chat_id, date, end_time IS NULL OR date > end_time AS fresh FROM {EV} LEFT JOIN k USING (chat_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, fresh ORDER BY date DESC, id DESC) AS rn FROM m) SELECT id, chat_id, fresh FROM r WHERE fresh OR rn <= 5""")
def watermark(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    marks = m.where("date < TIMESTAMP '2024-01-15'").groupBy("chat_id").agg(F.max("date").alias("end_time"))
    return seq.since_watermark(m, marks).select("id", "chat_id", "fresh")


@query("win22_threshold_search", f"""
WITH b AS (SELECT floor(value / 50)::INT AS bucket, count(*) AS n, count(*) FILTER (action <> 'rejected') / count(*) AS rate FROM {ACTIONS} GROUP BY 1),
r AS (SELECT bucket, min((rate >= 0.6)::INT) OVER (ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING) AS run FROM b WHERE n >= 5) SELECT min(bucket) AS bucket, count(*) AS n FROM r WHERE run = 1""")
def threshold(spark, sf_dir):
    b = actions(spark, sf_dir).groupBy(F.floor(F.col("value") / 50).cast("int").alias("bucket")).agg(F.count("*").alias("n"), (F.count_if(F.col("action") != "rejected") / F.count("*")).alias("rate"))
    return seq.threshold_for_rate(b, 0.6, 5)


@query("win23_evolution", f"""
WITH c AS (SELECT unnest(range(min(date::DATE)::TIMESTAMP, max(date::DATE)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 7 DAY))::DATE AS cutoff FROM {EV})
SELECT cutoff::VARCHAR AS cutoff, count(DISTINCT chat_id) AS chats, count(*) AS messages FROM c JOIN {EV} e ON e.date::DATE <= cutoff GROUP BY 1""")
def evolution(spark, sf_dir):
    return seq.evolution(event_messages(spark, sf_dir), 7, 52).withColumn("cutoff", F.col("cutoff").cast("string"))
