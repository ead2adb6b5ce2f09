"""Filters, joins, top-k and set queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlake.operators import messages as ops
from threadlake.plans.registry import query
from threadlake.sources.tables import CV, EV, MESSAGE, chat_messages, event_messages, schema_version, table, with_columns

CUT1, CUT2 = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp")


@query("src01_scan", f"SELECT id, chat_id, date, is_from_me FROM {EV}")
def scan(spark, sf_dir):
    return event_messages(spark, sf_dir).select("id", "chat_id", "date", "is_from_me")


@query("src02_schema_version", "SELECT 'v14' AS version, 'unknown' AS other")
def version(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return spark.range(1).select(F.lit(schema_version(m)).alias("version"), F.lit(schema_version(table(spark, sf_dir, "nation"))).alias("other"))


@query("src03_missing_columns", f"SELECT id, chat_id, NULL::VARCHAR AS sender, NULL::BIGINT AS reply_to_id FROM {EV} WHERE id < 500")
def missing_columns(spark, sf_dir):
    return with_columns(event_messages(spark, sf_dir), MESSAGE).where("id < 500").select("id", "chat_id", "sender", "reply_to_id")


@query("src05_contact_dimension", "SELECT 'c' || c_custkey AS identifier, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier")
def contact_dimension(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    both = c.select(F.concat(F.lit("c"), "c_custkey").alias("identifier"), F.col("c_name").alias("name")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("identifier"), F.col("s_name").alias("name")))
    return ops.first_row(both, ["identifier"], ["name"])


@query("src10_id_relation", f"SELECT id, chat_id FROM {EV} WHERE id IN (SELECT unnest([3, 14, 159, 265, 358, 979]))")
def id_relation(spark, sf_dir):
    ids = spark.createDataFrame([("[3,14,159,265,358,979]",)], "ids string").select(F.explode(F.from_json("ids", "array<bigint>")).alias("id"))
    return event_messages(spark, sf_dir).join(F.broadcast(ids), "id", "left_semi").select("id", "chat_id")


@query("src12_suffix_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00042' ")
def suffix_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").endswith("00042")).select("c_custkey", "c_name")


@query("src13_index_versions", "SELECT r_regionkey AS version, r_name AS model, r_regionkey = 2 AS is_active FROM region")
def index_versions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("version"), F.col("r_name").alias("model"), (F.col("r_regionkey") == 2).alias("is_active"))


@query("flt01_sender", f"SELECT id, coalesce(nullif(sender, 'assistant'), 'me') AS sender, nullif(text, '') AS text FROM {CV}")
def sender(spark, sf_dir):
    return chat_messages(spark, sf_dir).select("id", F.coalesce(F.nullif("sender", F.lit("assistant")), F.lit("me")).alias("sender"), F.nullif("text", F.lit("")).alias("text"))


@query("flt02_date_range", f"SELECT id, chat_id FROM {EV} WHERE date > '{CUT1}' AND date < '{CUT2}'")
def date_range(spark, sf_dir):
    return event_messages(spark, sf_dir).where(ops.between("date", ts(CUT1), ts(CUT2))).select("id", "chat_id")


@query("flt03_search", f"SELECT id, chat_id, date FROM {CV} WHERE contains(lower(text), 'than') ORDER BY date DESC, id DESC LIMIT 50")
def search(spark, sf_dir):
    return ops.search(chat_messages(spark, sf_dir), "THAN").select("id", "chat_id", "date")


@query("flt04_sender_predicate", f"SELECT id FROM {CV} WHERE sender = 'me' OR is_from_me")
def sender_predicate(spark, sf_dir):
    return chat_messages(spark, sf_dir).where(ops.sent_by("sender", "me")).select("id")


@query("flt05_has_attachment", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def has_attachment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ops.having(table(spark, sf_dir, "orders").select("o_orderkey"), li, "o_orderkey")


@query("flt05_no_attachment", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def no_attachment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ops.having(table(spark, sf_dir, "orders").select("o_orderkey"), li, "o_orderkey", present=False)


@query("flt06_mime_category", """
SELECT p_partkey, CASE WHEN m LIKE 'image/%' THEN 'images' WHEN m LIKE 'video/%' THEN 'videos' WHEN m LIKE 'audio/%' THEN 'audio' WHEN m IN ('application/pdf', 'text/plain') THEN 'documents' ELSE 'other' END AS category
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'audio/aac' ELSE p_type END AS m FROM part)""")
def mime(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_size % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'audio/aac' ELSE p_type END").alias("m"))
    return p.select("p_partkey", ops.mime_category("m").alias("category"))


@query("flt07_time_range", f"SELECT id FROM {EV} WHERE date >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def time_range(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    newest = m.agg(F.max("date").alias("now"))
    return m.join(F.broadcast(newest), F.col("date") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).select("id")


@query("flt08_filter_after_knn", "WITH t AS (SELECT event_id, value, event_type FROM events ORDER BY value DESC, event_id LIMIT 100) SELECT event_id, value FROM t WHERE event_type = 'click'")
def filter_after(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "value", "event_type").orderBy(F.desc("value"), "event_id").limit(100)
    return t.where("event_type = 'click'").select("event_id", "value")


@query("flt09_name_lookup", "SELECT c_custkey, CASE WHEN lower(c_name) = '00077' THEN 1 ELSE 2 END AS pass FROM customer WHERE contains(lower(c_name), '00077') ORDER BY 2, c_custkey DESC LIMIT 1")
def name_lookup(spark, sf_dir):
    return ops.name_lookup(table(spark, sf_dir, "customer"), "c_name", "00077", recency="c_custkey").select("c_custkey", "pass")


@query("flt10_contact_lookup", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '0000000') ORDER BY s_suppkey LIMIT 1")
def contact_lookup(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(ops.contains_text("s_name", "0000000")).orderBy("s_suppkey").limit(1).select("s_suppkey", "s_name")


@query("flt13_feedback_page", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def feedback_page(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").offset(50).limit(25).select("event_id", "user_id", "value")


@query("flt14_pending_tasks", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def pending(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("flt15_rules", "SELECT p_partkey FROM part WHERE p_size > 25 AND contains(lower(p_type), 'steel') AND p_brand = 'Brand#12'")
def rules(spark, sf_dir):
    return table(spark, sf_dir, "part").where(ops.rules([("p_size", "greater_than", 25), ("p_type", "contains", "Steel"), ("p_brand", "equals", "Brand#12")])).select("p_partkey")


@query("flt16_prefix_delete", "SELECT p_partkey, p_type FROM part WHERE NOT starts_with(p_type, 'STANDARD')")
def prefix_delete(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~F.col("p_type").startswith("STANDARD")).select("p_partkey", "p_type")


@query("flt17_inbox", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY date DESC, id DESC) AS rn FROM {EV}), c AS (SELECT chat_id FROM {EV} GROUP BY 1 ORDER BY max(date) DESC, chat_id LIMIT 15)
SELECT id, chat_id, value FROM r JOIN c USING (chat_id) WHERE rn <= 10 AND NOT is_from_me AND value >= 60""")
def inbox(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    chats = m.groupBy("chat_id").agg(F.max("date").alias("newest")).orderBy(F.desc("newest"), "chat_id").limit(15).select("chat_id")
    return ops.latest_per_chat(m.join(F.broadcast(chats), "chat_id", "left_semi"), 10).where("NOT is_from_me AND value >= 60").select("id", "chat_id", "value")


@query("flt18_noise_profile", f"SELECT chat_id, (id % 1000) // 10 AS win, count(*) AS total, count(*) FILTER (text <> '') AS filled, count(*) FILTER (length(text) >= 20) AS useful FROM {CV} GROUP BY 1, 2")
def noise(spark, sf_dir):
    return chat_messages(spark, sf_dir).groupBy("chat_id", F.floor(F.col("id") % 1000 / 10).alias("win")).agg(F.count("*").alias("total"), F.count_if(F.col("text") != "").alias("filled"), F.count_if(F.length("text") >= 20).alias("useful"))


@query("jon01_message_fact", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000""")
def message_fact(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")  # fixed 25 and 5 rows: Spark sends them by size
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("jon02_attachment_star", """
SELECT o_orderkey, l_linenumber, c_name, p_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49""")
def attachment_star(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    o, c, p, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "part", "supplier"))
    j = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey).join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return j.join(p.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", "l_linenumber", "c_name", "p_name", "s_name")


@query("jon03_recent_chats", f"WITH c AS (SELECT chat_id FROM {EV} GROUP BY 1 ORDER BY max(date) DESC, chat_id LIMIT 10) SELECT id, chat_id FROM {EV} WHERE chat_id IN (SELECT chat_id FROM c)")
def recent_chats(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    c = m.groupBy("chat_id").agg(F.max("date").alias("d")).orderBy(F.desc("d"), "chat_id").limit(10)
    return m.join(F.broadcast(c), "chat_id", "left_semi").select("id", "chat_id")


@query("jon04_batch_lookup", "SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01' GROUP BY 1")
def batch_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return o.join(li, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("jon05_reply_parent", f"SELECT m.id, p.id AS parent_id, p.is_from_me AS parent_mine FROM {CV} m JOIN {CV} p ON p.chat_id = m.chat_id AND p.id = m.id - 2")
def reply_parent(spark, sf_dir):
    m = chat_messages(spark, sf_dir).select("id", "chat_id", "is_from_me")
    p = m.select((F.col("id") + 2).alias("id"), "chat_id", F.col("id").alias("parent_id"), F.col("is_from_me").alias("parent_mine"))
    return m.select("id", "chat_id").join(p, ["chat_id", "id"]).select("id", "parent_id", "parent_mine")


@query("jon06_last_message", f"SELECT chat_id, arg_max(id, (date, id)) AS id, max(date) AS date FROM {EV} GROUP BY 1")
def last_message(spark, sf_dir):
    return event_messages(spark, sf_dir).groupBy("chat_id").agg(F.max_by("id", F.struct("date", "id")).alias("id"), F.max("date").alias("date"))


@query("jon07_conversation", f"SELECT chat_id, count(*) AS n, max(date) AS last_date, count(DISTINCT sender) AS participants, arg_max(text, (date, id)) AS last_text FROM {CV} GROUP BY 1")
def conversation(spark, sf_dir):
    return chat_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n"), F.max("date").alias("last_date"), F.countDistinct("sender").alias("participants"), F.max_by("text", F.struct("date", "id")).alias("last_text"))


@query("jon08_five_keys", "SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, max(l_linenumber) AS last_line FROM lineitem WHERE l_discount = 0.1 GROUP BY ALL")
def five_keys(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    li = table(spark, sf_dir, "lineitem")
    wanted = li.where("l_discount = 0.1").select(*keys, "l_linenumber")
    return wanted.groupBy(*keys).agg(F.max("l_linenumber").alias("last_line"))


@query("jon09_enriched_hits", "WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) SELECT o_orderkey, rank, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM h LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def enriched(spark, sf_dir):
    top = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    h = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))  # 20 rows
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    own = li.join(F.broadcast(h.select("o_orderkey")), "o_orderkey").groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return h.join(own, "o_orderkey", "left").select("o_orderkey", "rank", F.coalesce(F.array_join(F.transform("s", lambda x: x["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"))


@query("jon10_left_counts", "SELECT c_custkey, count(o_orderkey) AS segments FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY segments DESC, c_custkey LIMIT 10")
def left_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("segments")).orderBy(F.desc("segments"), "c_custkey").limit(10)


@query("jon11_vector_stats", "SELECT c_custkey, count(DISTINCT o_orderkey) AS segments, count(l_orderkey) AS chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def vector_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(li, "o_orderkey", "left")
    g = o.groupBy("c_custkey").agg(F.count("*").alias("segments"), F.sum(F.coalesce("k", F.lit(0))).alias("chunks"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("jon12_partial_progress", "SELECT c_custkey, count(*) AS open FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL GROUP BY 1 HAVING count(*) >= 5")
def partial_progress(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("open")).where("open >= 5")


@query("jon13_shared", "SELECT DISTINCT a.l_suppkey AS x, b.l_suppkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE a.l_quantity = 50 AND b.l_quantity = 50")
def shared(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_orderkey", "l_suppkey")
    return li.withColumnRenamed("l_suppkey", "x").join(li.withColumnRenamed("l_suppkey", "y"), "l_orderkey").where("x < y").select("x", "y").distinct()


@query("jon14_two_keys", "WITH c AS (SELECT c_custkey AS k, c_name AS name, 0 AS p FROM customer UNION ALL SELECT c_nationkey, c_name, 1 FROM customer), o AS (SELECT DISTINCT o_custkey FROM orders) SELECT o_custkey, arg_max(name, (p, name)) AS name FROM o JOIN c ON k = o_custkey GROUP BY 1")
def two_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    keys = c.select("c_name", F.posexplode(F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long"))).alias("p", "o_custkey"))
    best = keys.groupBy("o_custkey").agg(F.max_by("c_name", F.struct("p", "c_name")).alias("name"))
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().join(best, "o_custkey")


@query("jon15_fuzzy_names", """
WITH p AS (SELECT DISTINCT p_partkey AS id, p_name AS person, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM part WHERE p_partkey <= 200),
c AS (SELECT s_suppkey AS contact_id, list_distinct(list_filter(regexp_split_to_array(lower(s_name), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM supplier),
s AS (SELECT 'x ' || contact_id AS person, contact_id FROM c),
pp AS (SELECT contact_id AS id, 'supplier#' || lpad(contact_id::VARCHAR, 9, '0') AS person, list_distinct(list_filter(regexp_split_to_array('supplier#' || lpad(contact_id::VARCHAR, 9, '0'), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM c),
j AS (SELECT a.person, b.contact_id, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS score FROM pp a JOIN c b ON len(list_intersect(a.t, b.t)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, contact_id) AS rn, lead(score) OVER (PARTITION BY person ORDER BY score DESC, contact_id) AS nxt FROM j)
SELECT person, contact_id, round(score, 6) AS score FROM r WHERE rn = 1 AND score >= 0.7 AND score - coalesce(nxt, 0) >= 0.2""")
def fuzzy(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    people = s.select(F.concat(F.lit("supplier#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("person"))
    return ops.fuzzy_names(people, s.select(F.col("s_suppkey").alias("contact_id"), F.col("s_name").alias("name")))


@query("jon16_single_handle", f"WITH h AS (SELECT chat_id FROM {CV} GROUP BY 1 HAVING count(DISTINCT sender) = 2) SELECT h.chat_id, coalesce(n, 0) AS n FROM h LEFT JOIN (SELECT chat_id, count(*) AS n FROM {CV} WHERE is_from_me GROUP BY 1) USING (chat_id)")
def single_handle(spark, sf_dir):
    g = chat_messages(spark, sf_dir).groupBy("chat_id").agg(F.countDistinct("sender").alias("handles"), F.count_if("is_from_me").alias("n"))
    return g.where("handles = 2").select("chat_id", "n")


@query("jon17_previous_row", f"SELECT id, lag(id) OVER (PARTITION BY chat_id ORDER BY date, id) AS prev_id FROM {EV}")
def previous_row(spark, sf_dir):
    return event_messages(spark, sf_dir).select("id", F.lag("id").over(Window.partitionBy("chat_id").orderBy("date", "id")).alias("prev_id"))


@query("jon20_offset_pairs", f"SELECT a.id, a.chat_id, b.id AS next_id FROM {EV} a JOIN {EV} b ON b.id = a.id + 1 WHERE NOT a.is_from_me AND b.is_from_me")
def offset_pairs(spark, sf_dir):
    m = event_messages(spark, sf_dir).select("id", "chat_id", "is_from_me")
    nxt = m.where("is_from_me").select((F.col("id") - 1).alias("id"), F.col("id").alias("next_id"))
    return m.where("NOT is_from_me").select("id", "chat_id").join(nxt, "id")


@query("top01_latest", f"SELECT id, chat_id, date FROM {EV} ORDER BY date DESC, id DESC LIMIT 20")
def latest(spark, sf_dir):
    return event_messages(spark, sf_dir).select("id", "chat_id", "date").orderBy(F.desc("date"), F.desc("id")).limit(20)


@query("top02_most_common", f"SELECT hour(date)::INT AS hour, count(*) AS n FROM {EV} GROUP BY 1 ORDER BY n DESC, hour LIMIT 5")
def most_common(spark, sf_dir):
    return event_messages(spark, sf_dir).groupBy(F.hour("date").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(5)


@query("top03_largest", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 500")
def largest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(500)


@query("top04_nulls_first", "SELECT c_custkey, last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY last NULLS FIRST, c_custkey LIMIT 30")
def nulls_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").orderBy(F.asc_nulls_first("last"), "c_custkey").limit(30)


@query("top05_after_id", f"SELECT id, date FROM {EV} WHERE chat_id = 7 AND id > 100 ORDER BY date, id LIMIT 20")
def after_id(spark, sf_dir):
    return event_messages(spark, sf_dir).where("chat_id = 7 AND id > 100").select("id", "date").orderBy("date", "id").limit(20)


@query("top06_two_keys", "SELECT event_id, value, event_type FROM events ORDER BY event_type DESC, value DESC, event_id LIMIT 40")
def two_key_sort(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value", "event_type").orderBy(F.desc("event_type"), F.desc("value"), "event_id").limit(40)


@query("top07_capped_stream", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY date DESC, id DESC) AS rn FROM {EV}), k AS (SELECT * FROM r WHERE rn <= 20),
c AS (SELECT chat_id, coalesce(sum(count(*)) OVER (ORDER BY max(date) DESC, chat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k GROUP BY 1)
SELECT id, chat_id FROM k JOIN c USING (chat_id) WHERE before < 500""")
def capped(spark, sf_dir):
    return ops.capped_stream(event_messages(spark, sf_dir), 20, 500).select("id", "chat_id")


@query("top08_segments", f"WITH s AS (SELECT chat_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, max(date) AS last_date FROM {CV} GROUP BY 1) SELECT chat_id, ids FROM s ORDER BY last_date DESC, chat_id LIMIT 15")
def segments(spark, sf_dir):
    s = chat_messages(spark, sf_dir).groupBy("chat_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"), F.max("date").alias("last_date"))
    return s.orderBy(F.desc("last_date"), "chat_id").limit(15).select("chat_id", "ids")


@query("set01_distinct", f"SELECT DISTINCT chat_id FROM {EV}")
def distinct(spark, sf_dir):
    return event_messages(spark, sf_dir).select("chat_id").distinct()


@query("set02_normalised_dedup", "SELECT min(p_partkey) AS p_partkey, lower(trim(p_brand)) AS brand, lower(trim(p_type)) AS type FROM part GROUP BY 2, 3")
def normalised_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.trim("p_brand")).alias("brand"), F.lower(F.trim("p_type")).alias("type"))
    return p.groupBy("brand", "type").agg(F.min("p_partkey").alias("p_partkey"))


@query("set04_keep_last", "SELECT l_orderkey, l_suppkey, arg_max(l_quantity, (l_linenumber, l_quantity)) AS l_quantity FROM lineitem GROUP BY 1, 2")
def keep_last(spark, sf_dir):
    return ops.last_row(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_suppkey"], [F.col("l_linenumber"), F.col("l_quantity")]).select("l_orderkey", "l_suppkey", "l_quantity")


@query("set05_first_wins", "SELECT p_brand, lower(p_type) AS subject, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1, 2")
def first_wins(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.lower("p_type").alias("subject"), "p_partkey", "p_name")
    return ops.first_row(p, ["p_brand", "subject"], ["p_partkey"]).select("p_brand", "subject", F.col("p_name").alias("name"))


@query("set06_unseen", "SELECT DISTINCT md5(text) AS fingerprint FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def unseen(spark, sf_dir):
    """Known are the texts of documents that have labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("fingerprint"))
    return ops.insert_or_ignore(d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), d.select("fingerprint"), ["fingerprint"])


@query("set07_postings", r"SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^\p{L}]+'), ['the', 'than', 'with'])")
def postings(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))
    return words.where(F.array_contains("w", "the") & F.array_contains("w", "than") & F.array_contains("w", "with")).select("doc_id")


@query("set08_best_prediction", "SELECT user_id, arg_max(event_type, (value, event_id)) AS kind, max(value) AS score FROM events GROUP BY 1")
def best_prediction(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("kind"), F.max("value").alias("score"))


@query("set09_missing", "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def missing(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey").subtract(table(spark, sf_dir, "customer").where("c_acctbal > 9900").select("c_nationkey"))


@query("set10_rank_union", "WITH a AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events ORDER BY value DESC, event_id LIMIT 20), b AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS r FROM events ORDER BY ts DESC, event_id LIMIT 20) SELECT event_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def rank_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", "ts")
    parts = []
    for col in ("value", "ts"):
        top = e.orderBy(F.desc(col), "event_id").limit(20)
        parts.append(top.select("event_id", F.row_number().over(Window.orderBy(F.desc(col), "event_id")).alias("r")))  # 20 rows
    return parts[0].unionByName(parts[1]).groupBy("event_id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("score"))


@query("set11_schema_diff", "SELECT 'removed' AS change, unnest(['o_custkey', 'o_orderstatus', 'o_totalprice']) AS name UNION ALL SELECT 'added', unnest(['l_partkey'])")
def schema_diff(spark, sf_dir):
    old = spark.createDataFrame([(c,) for c in ("key", "o_custkey", "o_orderstatus", "o_totalprice")], "name string")
    new = spark.createDataFrame([("key",), ("l_partkey",)], "name string")
    return old.exceptAll(new).select(F.lit("removed").alias("change"), "name").unionByName(new.exceptAll(old).select(F.lit("added").alias("change"), "name"))


@query("snk10_upsert", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def upsert(spark, sf_dir):
    return ops.last_row(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "value")


@query("snk11_insert_or_ignore", "SELECT count(DISTINCT user_id) AS inserted FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)")
def insert_or_ignore(spark, sf_dir):
    """Users of events into a table that has the numbers of conversations."""
    known = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"))
    return ops.insert_or_ignore(known, table(spark, sf_dir, "events").select("user_id"), ["user_id"]).agg(F.count("*").alias("inserted"))


@query("snk13_partition_delete", f"SELECT id, chat_id FROM {EV} WHERE chat_id NOT IN (1, 2, 3)")
def partition_delete(spark, sf_dir):
    gone = spark.createDataFrame([(1,), (2,), (3,)], "chat_id long")
    return event_messages(spark, sf_dir).join(F.broadcast(gone), "chat_id", "left_anti").select("id", "chat_id")
