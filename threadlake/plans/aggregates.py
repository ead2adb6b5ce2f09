"""Aggregate queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import aggregates as agg
from threadlake.plans.registry import query
from threadlake.sources.tables import CV, EV, chat_messages, event_messages, table

ACTION = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'edited' END"
ACTIONS = f"(SELECT event_id, user_id, ts, value, {ACTION} AS action FROM events WHERE {ACTION} IS NOT NULL)"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as feedback: purchases accepted, errors rejected, clicks edited."""
    return table(spark, sf_dir, "events").withColumn("action", F.expr(ACTION)).where("action IS NOT NULL")


@query("agg01_hourly", f"""
SELECT h::INT AS hour, coalesce(n, 0) AS n, coalesce(sent, 0) AS sent, round(coalesce(v, 0), 4) AS avg_value
FROM range(24) r(h) LEFT JOIN (SELECT hour(date) AS h, count(*) AS n, count(*) FILTER (is_from_me) AS sent, avg(value) AS v FROM {EV} GROUP BY 1) USING (h)""")
def hourly(spark, sf_dir):
    return agg.by_hour(event_messages(spark, sf_dir))


@query("agg02_daily", f"""
SELECT date::DATE::VARCHAR AS period, count(*) AS total, count(*) FILTER (is_from_me) AS sent, count(*) FILTER (NOT is_from_me) AS received,
  count(DISTINCT chat_id) FILTER (NOT is_from_me) AS contacts, round(avg(value), 4) AS avg_value FROM {EV} GROUP BY 1""")
def daily(spark, sf_dir):
    return agg.by_period(event_messages(spark, sf_dir), F.to_date("date"), {"avg_value": F.round(F.avg("value"), 4)}).drop("active_days", "first_day", "last_day").withColumn("period", F.col("period").cast("string"))


@query("agg02_hourly_map", f"""
SELECT period, to_json(list({{'h': h, 'n': n}} ORDER BY h)) AS hours FROM (SELECT date::DATE::VARCHAR AS period, hour(date)::INT AS h, count(*) AS n FROM {EV} GROUP BY 1, 2) GROUP BY 1""")
def hourly_map(spark, sf_dir):
    g = event_messages(spark, sf_dir).groupBy(F.to_date("date").cast("string").alias("period"), F.hour("date").alias("h")).agg(F.count("*").alias("n"))
    return g.groupBy("period").agg(F.to_json(F.sort_array(F.collect_list(F.struct("h", "n")))).alias("hours"))


@query("agg03_weekly", f"""
SELECT strftime(date, '%Y-W%W') AS period, count(*) AS total, count(*) FILTER (is_from_me) AS sent, count(*) FILTER (NOT is_from_me) AS received,
  count(DISTINCT chat_id) FILTER (NOT is_from_me) AS contacts, count(DISTINCT date::DATE) AS active_days, min(date::DATE)::VARCHAR AS first_day, max(date::DATE)::VARCHAR AS last_day FROM {EV} GROUP BY 1""")
def weekly(spark, sf_dir):
    return agg.by_period(event_messages(spark, sf_dir), agg.week_key("date")).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("agg04_monthly", f"""
SELECT strftime(date, '%Y-%m') AS period, count(*) AS total, count(*) FILTER (is_from_me) AS sent, count(*) FILTER (NOT is_from_me) AS received,
  count(DISTINCT chat_id) FILTER (NOT is_from_me) AS contacts, round(count(*) / count(DISTINCT date::DATE), 4) AS per_active_day FROM {EV} GROUP BY 1""")
def monthly(spark, sf_dir):
    m = agg.by_period(event_messages(spark, sf_dir), F.date_format("date", "yyyy-MM"))
    return m.withColumn("per_active_day", F.round(F.col("total") / F.col("active_days"), 4)).drop("active_days", "first_day", "last_day")


@query("agg05_rollup_weeks", f"""
SELECT strftime(date, '%Y-W%W') AS period, count(*) AS n, count(*) FILTER (is_from_me) AS sent, count(DISTINCT date::DATE) AS days
FROM {EV} WHERE date::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-24' GROUP BY 1""")
def rollup_weeks(spark, sf_dir):
    days = event_messages(spark, sf_dir).groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("n"), F.count_if("is_from_me").alias("sent"))
    return agg.rollup_days(days.where("day BETWEEN DATE '2024-01-03' AND DATE '2024-01-24'"), agg.week_key("day"))


@query("agg06_heatmap", f"""
SELECT date::DATE::VARCHAR AS day, count(*) AS n, CASE WHEN count(*) = 0 THEN 0 WHEN count(*) <= 5 THEN 1 WHEN count(*) <= 15 THEN 2 WHEN count(*) <= 30 THEN 3 ELSE 4 END AS level
FROM {EV} GROUP BY 1""")
def heatmap(spark, sf_dir):
    return agg.activity_levels(event_messages(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("agg07_overview", f"""
WITH m AS (SELECT * FROM {EV}), g AS (SELECT count(*) AS total, count(*) FILTER (is_from_me) AS sent, count(DISTINCT chat_id) AS chats, min(date) AS first_date, max(date) AS last_date FROM m)
SELECT total, sent, total - sent AS received, chats, first_date, last_date, round(total / greatest(date_diff('day', first_date::DATE, last_date::DATE), 1), 4) AS per_day,
  (SELECT hour(date)::INT FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour, (SELECT dayname(date) FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_day FROM g""")
def overview(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    # one pass by day and hour; what follows works on at most 24 rows a day
    cells = m.groupBy(F.to_date("date").alias("day"), F.hour("date").alias("hour"), "chat_id").agg(F.count("*").alias("n"), F.count_if("is_from_me").alias("sent"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    g = cells.agg(F.sum("n").alias("total"), F.sum("sent").alias("sent"), F.countDistinct("chat_id").alias("chats"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    hour = cells.groupBy("hour").agg(F.sum("n").alias("n")).agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"))
    day = cells.groupBy(F.date_format("day", "EEEE").alias("name")).agg(F.sum("n").alias("n")).agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("peak_day"))
    per_day = F.round(F.col("total") / F.greatest(F.datediff("last_date", "first_date"), F.lit(1)), 4)
    one = F.lit(1).alias("one")
    rows = g.withColumn("one", one).join(hour.withColumn("one", one), "one").join(day.withColumn("one", one), "one")
    return rows.select("total", "sent", (F.col("total") - F.col("sent")).alias("received"), "chats", "first_date", "last_date", per_day.alias("per_day"), "peak_hour", "peak_day")


CONTACTS = f"""
SELECT chat_id, count(*) AS total, count(*) FILTER (is_from_me) AS sent, count(*) FILTER (NOT is_from_me) AS received, count(DISTINCT date::DATE) AS days, min(date) AS first_date, max(date) AS last_date,
  round(0.6 * (least(sent, received) / greatest(sent, received, 1) * 100) + 0.4 * least(total / greatest(days, 1) * 10, 100), 4) AS engagement FROM {EV} GROUP BY chat_id"""


@query("agg08_contacts", CONTACTS)
def contacts(spark, sf_dir):
    return agg.contact_table(event_messages(spark, sf_dir))


@query("agg09_engagement", f"SELECT chat_id, engagement FROM ({CONTACTS}) WHERE total >= 5")
def engagement(spark, sf_dir):
    return agg.contact_table(event_messages(spark, sf_dir)).where("total >= 5").select("chat_id", "engagement")


@query("agg12_lengths", f"""
SELECT sender, round(avg(length(text)), 4) AS avg_len, median(length(text)) AS median_len, min(length(text)) AS min_len, max(length(text)) AS max_len,
  count(*) FILTER (length(text) <= 20) AS short, count(*) FILTER (length(text) BETWEEN 21 AND 100) AS medium, count(*) FILTER (length(text) BETWEEN 101 AND 300) AS long, count(*) FILTER (length(text) > 300) AS very_long
FROM {CV} WHERE text IS NOT NULL AND text <> '' GROUP BY sender""")
def lengths(spark, sf_dir):
    return agg.length_stats(chat_messages(spark, sf_dir), ["sender"])


@query("agg13_distributions", f"""
SELECT grain, slot, count(*) AS n FROM (SELECT unnest(['hour', 'weekday', 'week', 'month']) AS grain, unnest([hour(date)::VARCHAR, dayname(date), strftime(date, '%Y-W%W'), strftime(date, '%Y-%m')]) AS slot FROM {EV}) GROUP BY 1, 2""")
def distributions(spark, sf_dir):
    m = event_messages(spark, sf_dir).select(F.hour("date").cast("string").alias("hour"), F.date_format("date", "EEEE").alias("weekday"), agg.week_key("date").alias("week"), F.date_format("date", "yyyy-MM").alias("month"))
    sets = m.groupingSets([["hour"], ["weekday"], ["week"], ["month"]], "hour", "weekday", "week", "month").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.expr("CASE g WHEN 7 THEN 'hour' WHEN 11 THEN 'weekday' WHEN 13 THEN 'week' ELSE 'month' END").alias("grain"), F.coalesce("hour", "weekday", "week", "month").alias("slot"), "n")


@query("agg15_attachment_stats", """
SELECT CASE WHEN p_type LIKE '%STEEL%' THEN 'image' WHEN p_type LIKE '%COPPER%' THEN 'video' WHEN p_type LIKE '%BRASS%' THEN 'audio' ELSE 'other' END AS category, count(*) AS n, round(sum(l_quantity), 4) AS bytes
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def attachment_stats(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    # partial sums by part first: the join then sees one row a part
    per_part = li.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("bytes"))
    category = F.when(F.col("p_type").contains("STEEL"), "image").when(F.col("p_type").contains("COPPER"), "video").when(F.col("p_type").contains("BRASS"), "audio").otherwise("other")
    return per_part.join(p.select("p_partkey", category.alias("category")), per_part.l_partkey == F.col("p_partkey")).groupBy("category").agg(F.sum("n").alias("n"), F.round(F.sum("bytes"), 4).alias("bytes"))


@query("agg16_storage_by_chat", """
SELECT o_custkey, count(DISTINCT l_partkey) AS attachments, round(sum(l_quantity), 4) AS bytes FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY bytes DESC, o_custkey LIMIT 50""")
def storage_by_chat(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    g = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("attachments"), F.round(F.sum("l_quantity"), 4).alias("bytes"))
    return g.orderBy(F.desc("bytes"), "o_custkey").limit(50)


@query("agg17_conversations", f"""
SELECT chat_id, max(date) AS last_date, count(*) AS n, string_agg(DISTINCT sender, ', ' ORDER BY sender) AS participants FROM {CV} GROUP BY 1 ORDER BY last_date DESC, chat_id LIMIT 100""")
def conversations(spark, sf_dir):
    g = chat_messages(spark, sf_dir).groupBy("chat_id").agg(F.max("date").alias("last_date"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("sender")), ", ").alias("participants"))
    return g.orderBy(F.desc("last_date"), "chat_id").limit(100)


@query("agg18_group_concat", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_concat(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))


RATES = "count(*) AS total, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'rejected') AS rejected, count(*) FILTER (action = 'edited') AS edited, round((count(*) FILTER (action IN ('accepted', 'edited'))) / count(*), 4) AS acceptance"


@query("agg19_feedback_totals", f"SELECT {RATES} FROM {ACTIONS}")
def feedback_totals(spark, sf_dir):
    return agg.action_counts(actions(spark, sf_dir), [])


@query("agg20_feedback_by_day", f"SELECT ts::DATE::VARCHAR AS day, {RATES} FROM {ACTIONS} GROUP BY 1")
def feedback_by_day(spark, sf_dir):
    return agg.action_counts(actions(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string")), ["day"])


@query("agg21_feedback_by_contact", f"SELECT user_id, {RATES} FROM {ACTIONS} WHERE user_id IS NOT NULL GROUP BY 1")
def feedback_by_contact(spark, sf_dir):
    return agg.action_counts(actions(spark, sf_dir).where("user_id IS NOT NULL"), ["user_id"])


@query("agg22_suggestion_stats", f"""
SELECT action, count(*) AS n, round(avg(value), 4) AS mean_value, round(avg(json_extract_string(props, '$.k')::DOUBLE), 4) AS mean_k FROM (SELECT a.*, e.props FROM {ACTIONS} a JOIN events e USING (event_id)) GROUP BY 1""")
def suggestion_stats(spark, sf_dir):
    return actions(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 4).alias("mean_k"))


@query("agg23_experiment", f"""
WITH v AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, count(*) AS n, count(*) FILTER (action = 'accepted') AS won FROM {ACTIONS} GROUP BY 1),
p AS (SELECT sum(CASE variant WHEN 'a' THEN n END) AS na, sum(CASE variant WHEN 'b' THEN n END) AS nb, sum(CASE variant WHEN 'a' THEN won END) AS a, sum(CASE variant WHEN 'b' THEN won END) AS b FROM v)
SELECT na::BIGINT AS n_a, nb::BIGINT AS n_b, a::BIGINT AS won_a, b::BIGINT AS won_b, round(100.0 * a / na, 4) AS rate_a, round(100.0 * b / nb, 4) AS rate_b, CASE WHEN a / na >= b / nb THEN 'a' ELSE 'b' END AS winner,
  round((na + nb) * power(a * (nb - b) - b * (na - a), 2) / (na::DOUBLE * nb * (a + b) * (na + nb - a - b)), 4) AS chi2 FROM p""")
def experiment(spark, sf_dir):
    v = actions(spark, sf_dir).withColumn("variant", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    one = lambda name, won: F.count_if((F.col("variant") == name) & ((F.col("action") == "accepted") if won else F.lit(True)))
    p = v.agg(one("a", False).alias("n_a"), one("b", False).alias("n_b"), one("a", True).alias("won_a"), one("b", True).alias("won_b"))
    d = {k: F.col(k).cast("double") for k in ("n_a", "n_b", "won_a", "won_b")}
    na, nb, a, b = d["n_a"], d["n_b"], d["won_a"], d["won_b"]
    chi2 = (na + nb) * F.pow(a * (nb - b) - b * (na - a), F.lit(2)) / (na * nb * (a + b) * (na + nb - a - b))
    return p.select("*", F.round(100 * a / na, 4).alias("rate_a"), F.round(100 * b / nb, 4).alias("rate_b"), F.when(a / na >= b / nb, "a").otherwise("b").alias("winner"), F.round(chi2, 4).alias("chi2"))


@query("agg24_similarity_buckets", f"""
SELECT floor(value / 50)::INT AS bucket, count(*) AS n, round(avg(value), 4) AS mean_score, count(*) FILTER (action <> 'rejected') AS accepted, round(count(*) FILTER (action <> 'rejected') / count(*), 4) AS rate FROM {ACTIONS} GROUP BY 1""")
def similarity_buckets(spark, sf_dir):
    return agg.bucket_rates(actions(spark, sf_dir), "value", 50.0)


@query("agg25_histogram", "SELECT count(*) FILTER (value <= 10) AS c0, count(*) FILTER (value <= 50) AS c1, count(*) FILTER (value <= 100) AS c2, count(*) FILTER (value <= 500) AS c3, count(value) AS n, round(sum(value), 4) AS total FROM events")
def histogram(spark, sf_dir):
    return agg.histogram(table(spark, sf_dir, "events"), "value", [10.0, 50.0, 100.0, 500.0])


@query("agg26_latency_summary", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) FILTER (rn = least(n // 2, n - 1)) AS p50, max(value) FILTER (rn = least(floor(n * 0.95)::BIGINT, n - 1)) AS p95 FROM r GROUP BY 1""")
def latency_summary(spark, sf_dir):
    return agg.rank_percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95})


@query("agg27_request_counts", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT date_diff('second', min(ts), max(ts)) FROM events), 9) AS per_second FROM events GROUP BY 1")
def request_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    span = g.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select((F.unix_seconds("hi") - F.unix_seconds("lo")).alias("span"), F.lit(1).alias("one"))
    return g.withColumn("one", F.lit(1)).join(span, "one").select("event_type", "n", F.round(F.col("n") / F.col("span"), 9).alias("per_second"))


@query("agg28_template_stats", "SELECT event_type AS template, count(*) AS n, round(100.0 * count(*) FILTER (value >= 100) / count(*), 4) AS hit_rate, round(avg(value), 4) AS mean_similarity FROM events GROUP BY 1 ORDER BY n DESC, template LIMIT 3")
def template_stats(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("template")).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("value") >= 100) / F.count("*"), 4).alias("hit_rate"), F.round(F.avg("value"), 4).alias("mean_similarity"))
    return g.orderBy(F.desc("n"), "template").limit(3)


@query("agg29_sample_stats", "SELECT arg_max(value, (ts, event_id)) AS current, max(value) AS peak, round(avg(value), 4) AS mean, min(value) AS low FROM events")
def sample_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max_by("value", F.struct("ts", "event_id")).alias("current"), F.max("value").alias("peak"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"))


@query("agg30_confidence_histogram", "SELECT least(floor(l_discount * 100)::INT, 9) AS bucket, count(*) AS n, round(100.0 * count(*) FILTER (l_tax > 0.04) / count(*), 4) AS gate_rate FROM lineitem GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.floor(F.col("l_discount") * 100).cast("int"), F.lit(9)).alias("bucket")).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("l_tax") > 0.04) / F.count("*"), 4).alias("gate_rate"))


@query("agg31_task_stats", "SELECT o_orderstatus AS status, o_orderpriority AS task_type, count(*) AS n FROM orders GROUP BY 1, 2")
def task_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("task_type")).agg(F.count("*").alias("n"))


@query("agg32_progress", f"SELECT chat_id, count(*) AS windows, round(sum(value), 4) AS facts, max(date) AS last_date FROM {EV} GROUP BY 1")
def progress(spark, sf_dir):
    return event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("windows"), F.round(F.sum("value"), 4).alias("facts"), F.max("date").alias("last_date"))


@query("agg35_index_stats", "SELECT count(*) AS n, count(DISTINCT label) AS groups, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings")
def index_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.countDistinct("label").alias("groups"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("agg36_relationship_features", rf"""
SELECT chat_id, round(avg(length(text)), 4) AS mean_len, round(avg(hour(date)), 4) AS mean_hour, round(var_pop(hour(date)), 4) AS var_hour, round(count(*) / greatest(count(DISTINCT date::DATE), 1), 4) AS per_day,
  round(avg((lower(text) = text)::INT), 4) AS lower_rate, sum(len(regexp_extract_all(lower(text), '\bthe\b'))) AS keyword_hits FROM {CV} WHERE text <> '' GROUP BY 1""")
def relationship_features(spark, sf_dir):
    m = chat_messages(spark, sf_dir).where("text <> ''")
    return m.groupBy("chat_id").agg(
        F.round(F.avg(F.length("text")), 4).alias("mean_len"), F.round(F.avg(F.hour("date")), 4).alias("mean_hour"), F.round(F.var_pop(F.hour("date")), 4).alias("var_hour"),
        F.round(F.count("*") / F.greatest(F.countDistinct(F.to_date("date")), F.lit(1)), 4).alias("per_day"), F.round(F.avg((F.lower("text") == F.col("text")).cast("int")), 4).alias("lower_rate"),
        F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\bthe\b"), F.lit(0)))).alias("keyword_hits"))


@query("agg39_time_preferences", f"""
WITH h AS (SELECT chat_id, hour(date)::INT AS hour, count(*) AS n FROM {EV} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, hour) AS rn FROM h)
SELECT chat_id, hour, n, rn FROM r WHERE rn <= 5""")
def time_preferences(spark, sf_dir):
    from pyspark.sql import Window

    h = event_messages(spark, sf_dir).groupBy("chat_id", F.hour("date").alias("hour")).agg(F.count("*").alias("n"))
    return h.withColumn("rn", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("n"), "hour"))).where("rn <= 5")


@query("agg42_scalar_counts", "SELECT (SELECT count(*) FROM customer) AS contacts, (SELECT count(*) FROM orders) AS segments, (SELECT count(*) FROM lineitem) AS facts")
def scalar_counts(spark, sf_dir):
    one = F.lit(1).alias("one")
    c, o, li = (table(spark, sf_dir, t).agg(F.count("*").alias(n), F.max(one).alias("one")) for t, n in (("customer", "contacts"), ("orders", "segments"), ("lineitem", "facts")))
    return c.join(o, "one").join(li, "one").drop("one")


@query("agg43_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS grain, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("grain"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("agg44_mined_replies", """
WITH p AS (SELECT e.event_type AS incoming, f.event_type AS reply, e.user_id AS chat_id FROM events e JOIN events f ON f.event_id = e.event_id + 1),
each AS (SELECT incoming, reply, count(*) AS k FROM p GROUP BY 1, 2), best AS (SELECT incoming, arg_max(reply, (k, reply)) AS reply, max(k) AS k FROM each GROUP BY 1),
g AS (SELECT incoming, count(*) AS n, count(DISTINCT chat_id) AS chats FROM p GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT chat_id) >= 2)
SELECT incoming, n, chats, reply, round(k / n, 4) AS share FROM g JOIN best USING (incoming) WHERE round(k / n, 4) >= 0.2 ORDER BY n DESC, incoming LIMIT 50""")
def mined_replies(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    p = e.join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("reply")), "event_id").select(F.col("event_type").alias("incoming"), "reply", F.col("user_id").alias("chat_id"))
    return agg.mined_replies(p, 5, 2, 0.2, 50)


@query("agg45_confusion", """
WITH x AS (SELECT o_orderstatus AS t, CASE WHEN o_totalprice > 150000 THEN 'O' ELSE 'F' END AS p FROM orders), l AS (SELECT t AS label FROM x UNION SELECT p FROM x),
g AS (SELECT label, (SELECT count(*) FROM x WHERE t = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS named, (SELECT count(*) FROM x WHERE t = label AND p = label) AS hit FROM l),
r AS (SELECT *, coalesce(hit / nullif(named, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS rc FROM g)
SELECT label, support, named, hit, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1 FROM r""")
def confusion(spark, sf_dir):
    return agg.confusion(table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_totalprice") > 150000, "O").otherwise("F")), "o_orderstatus", "p")


@query("agg46_kappa", """
WITH g AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), k AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM g)
SELECT n, round(po, 6) AS agreement, round(pe, 6) AS expected, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM k""")
def kappa(spark, sf_dir):
    return agg.cohens_kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("agg47_paired_t", "SELECT count(*) AS n, round(avg(d), 4) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def paired_t(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_discount") - F.col("l_tax")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*"))), 4).alias("t"))


@query("agg48_latency_percentiles", "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"), *[F.round(F.percentile("value", p), 4).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("agg49_regressions", """
WITH h AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS before, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS after FROM events GROUP BY 1)
SELECT event_type, round(before, 4) AS before, round(after, 4) AS after, CASE WHEN after > before * 1.02 THEN 'regressed' WHEN after < before * 0.98 THEN 'improved' ELSE 'same' END AS verdict FROM h""")
def regressions(spark, sf_dir):
    early = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16'")
    h = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("b"), F.avg(F.when(~early, F.col("value"))).alias("a"))
    return h.select("event_type", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"), F.when(F.col("a") > F.col("b") * 1.02, "regressed").when(F.col("a") < F.col("b") * 0.98, "improved").otherwise("same").alias("verdict"))


@query("agg50_funnel", "SELECT o_orderpriority AS stage, o_orderstatus AS chat, count(*) AS raw, count(*) FILTER (o_totalprice < 50000) AS rejected, count(*) FILTER (o_totalprice >= 50000) AS saved FROM orders GROUP BY 1, 2")
def funnel(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("chat")).agg(F.count("*").alias("raw"), F.count_if(F.col("o_totalprice") < 50000).alias("rejected"), F.count_if(F.col("o_totalprice") >= 50000).alias("saved"))


@query("agg51_throughput", "SELECT l_returnflag AS stage, count(*) AS n, round(sum(l_quantity), 2) AS amount, round(sum(l_quantity) / count(DISTINCT l_shipdate::DATE), 4) AS per_day FROM lineitem GROUP BY 1")
def throughput(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("amount"), F.round(F.sum("l_quantity") / F.countDistinct(F.to_date("l_shipdate")), 4).alias("per_day"))
