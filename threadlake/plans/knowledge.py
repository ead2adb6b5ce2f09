"""Fact, segment, classifier and catalog queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlake.functions import pressure
from threadlake.operators import facts as of
from threadlake.operators import sequences as seq
from threadlake.plans.registry import query
from threadlake.session import dealt, ship
from threadlake.sources import catalog
from threadlake.sources.tables import CV, EV, chat_messages, event_messages, table

#: Sentences that hold facts, made from customers: there are none in the conversations.
SENTENCES = """(SELECT c_custkey AS id, c_nationkey::BIGINT AS chat_id, CASE c_custkey % 5 WHEN 0 THEN 'I live in ' || v || ' and work at ' || w WHEN 1 THEN 'we are moving to ' || v WHEN 2 THEN 'My sister ' || w || ' grew up in ' || v WHEN 3 THEN 'can you call me?' ELSE 'ok' END AS text
  FROM (SELECT *, 'N' || substr('abcdefghijklmnopqrstuvwxyz', (c_nationkey % 20)::INT + 1, 4) AS v, 'C' || substr('qwertyuiopasdfghjklzxcvbnm', (c_custkey % 20)::INT + 1, 5) AS w FROM customer))"""


def sentences(spark, sf_dir):
    c = dealt(table(spark, sf_dir, "customer"), "c_custkey")
    v = F.concat(F.lit("N"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.col("c_nationkey") % 20 + 1).cast("int"), F.lit(4)))
    w = F.concat(F.lit("C"), F.substr(F.lit("qwertyuiopasdfghjklzxcvbnm"), (F.col("c_custkey") % 20 + 1).cast("int"), F.lit(5)))
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat(F.lit("I live in "), v, F.lit(" and work at "), w)).when(k == 1, F.concat(F.lit("we are moving to "), v)).when(k == 2, F.concat(F.lit("My sister "), w, F.lit(" grew up in "), v)).when(k == 3, "can you call me?").otherwise("ok")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("chat_id"), text.alias("text"))


@query("scl13_pressure", pressure.sql(CV))
def pressure_cv(spark, sf_dir):
    return chat_messages(spark, sf_dir).select("id", pressure.response_pressure("text").alias("p")).select("id", "p.pressure", "p.kind", "p.confidence")


@query("scl13_pressure_sentences", pressure.sql(SENTENCES))
def pressure_sentences(spark, sf_dir):
    return sentences(spark, sf_dir).select("id", pressure.response_pressure("text").alias("p")).select("id", "p.pressure", "p.kind", "p.confidence")


@query("scl14_cascade", f"SELECT pressure, kind, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM ({pressure.sql(SENTENCES)}) GROUP BY 1, 2")
def cascade(spark, sf_dir):
    p = sentences(spark, sf_dir).select(pressure.response_pressure("text").alias("p")).select("p.*")
    return p.groupBy("pressure", "kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


_FOUND = " UNION ALL ".join(f"SELECT id, chat_id, '{c}' AS category, '{p}' AS predicate, unnest(regexp_extract_all(text, '{r}', 1)) AS subject, '' AS value, {k} AS base FROM s" for c, p, k, r in of.PATTERNS)
FACTS = f"""WITH s AS (SELECT * FROM {SENTENCES}),
f AS ({_FOUND} UNION ALL SELECT id, chat_id, 'relationship', 'is_family_of', unnest(regexp_extract_all(text, '{of.RELATIONS}', 2)), lower(unnest(regexp_extract_all(text, '{of.RELATIONS}', 1))), 0.8 FROM s),
c AS (SELECT * EXCLUDE (base), round(least(base * CASE WHEN length(subject) < 3 THEN 0.7 WHEN len(regexp_split_to_array(subject, '\\s+')) >= 4 THEN 1.1 ELSE 1 END, 1), 4)::DOUBLE AS confidence FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY chat_id, category, lower(subject), predicate ORDER BY id, subject, value) AS rn FROM c WHERE confidence >= 0.5), facts AS (SELECT * EXCLUDE (rn) FROM d WHERE rn = 1) """


@query("scl17_facts", FACTS + "SELECT * FROM facts")
def facts(spark, sf_dir):
    return of.extract(sentences(spark, sf_dir))


@query("scl29_hypotheses", FACTS + "SELECT id, predicate, CASE category WHEN 'relationship' THEN CASE WHEN value <> '' THEN subject || ' is my ' || value ELSE subject || ' and I are related' END WHEN 'location' THEN 'I ' || replace(lower(predicate), '_', ' ') || ' in ' || subject WHEN 'work' THEN 'I work at ' || subject ELSE subject || ' ' || predicate END AS sentence FROM facts")
def hypotheses(spark, sf_dir):
    return of.extract(sentences(spark, sf_dir)).select("id", "predicate", of.hypothesis("category", "subject", "predicate", "value").alias("sentence"))


@query("udf01_extractors", FACTS + "SELECT category, count(*) AS n FROM facts GROUP BY 1")
def extractors(spark, sf_dir):
    return of.extract(sentences(spark, sf_dir), "patterns").groupBy("category").agg(F.count("*").alias("n"))


@query("udf02_handlers", f"SELECT chat_id, count(*) AS n FROM {EV} GROUP BY 1")
def handlers(spark, sf_dir):
    h = catalog.Handlers()
    h.register("count", lambda m: m.groupBy("chat_id").agg(F.count("*").alias("n")))
    return h.run("count", event_messages(spark, sf_dir))


@query("src04_catalog", f"SELECT chat_id, max(date) AS last_date, count(*) AS n FROM {EV} WHERE date > '2024-01-10' GROUP BY 1 ORDER BY last_date DESC, chat_id LIMIT 50")
def named(spark, sf_dir):
    return catalog.get_query("conversations", event_messages(spark, sf_dir), since=F.lit("2024-01-10").cast("timestamp"))


@query("snk04_backup", f"SELECT chat_id, count(*) AS n, md5(string_agg(sender || ':' || coalesce(text, ''), '|' ORDER BY date, id)) AS digest FROM {CV} GROUP BY 1")
def backup(spark, sf_dir):
    b = catalog.backup(chat_messages(spark, sf_dir))
    rows = F.from_json("messages", "array<struct<date:string,id:long,sender:string,text:string>>")
    return b.select("chat_id", "n", F.md5(F.array_join(F.transform(rows, lambda x: F.concat(x["sender"], F.lit(":"), F.coalesce(x["text"], F.lit("")))), "|")).alias("digest"))


@query("snk05_csv_pack", f"SELECT date::DATE::VARCHAR AS day, count(*) AS n FROM {EV} GROUP BY 1")
def csv_pack(spark, sf_dir):
    """Written as CSV and read back."""
    import uuid

    from threadlake.session import shared_dir

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    catalog.write_csv(event_messages(spark, sf_dir).groupBy(F.to_date("date").cast("string").alias("day")).agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("day string, n long").csv(path)


@query("snk06_json_dump", f"SELECT chat_id, count(*) AS n FROM {EV} GROUP BY 1")
def json_dump(spark, sf_dir):
    """Written as JSON and read back."""
    import uuid

    from threadlake.session import shared_dir

    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    catalog.write_json(event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n")), path)
    return spark.read.schema("chat_id long, n long").json(path)


@query("snk07_graphml", """SELECT 1 AS part, '<node id="' || n_nationkey || '"/>' AS line FROM nation UNION ALL SELECT 2, '<edge source="' || n_nationkey || '" target="' || n_regionkey || '"/>' FROM nation""")
def graphml(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return catalog.graphml(n.select(F.col("n_nationkey").alias("id")), n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")))


VEC = "(SELECT vec_id, label, embedding, make_timestamp((1704067200 + vec_id * 240) * 1000000) AS date FROM embeddings)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def timed_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("date", F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 240))


@query("jon18_passive_feedback", f"""
WITH m AS (SELECT * FROM {VEC} WHERE vec_id % 2 = 0), s AS (SELECT * FROM {VEC} WHERE vec_id % 2 = 1),
j AS (SELECT m.vec_id AS id, s.vec_id AS suggestion_id, {DOT.format(a='m.embedding', b='s.embedding')} AS sim FROM m JOIN s ON m.label = s.label AND s.date <= m.date AND date_diff('second', s.date, m.date) <= 3600),
b AS (SELECT id, arg_max(suggestion_id, (sim, -suggestion_id)) AS suggestion_id, max(sim) AS sim FROM j GROUP BY 1) SELECT id, suggestion_id, CASE WHEN sim > 0.5 THEN 'sent' ELSE 'edited' END AS action FROM b WHERE sim > 0.2""")
def passive(spark, sf_dir):
    v = timed_vectors(spark, sf_dir).withColumn("chat_id", F.col("label"))
    return of.passive_feedback(v.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "id"), v.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "suggestion_id"), 60, 0.5, 0.2)


@query("jon21_boundaries", """
WITH RECURSIVE d AS (SELECT conv_id, list(turn ORDER BY turn) AS d FROM conversations WHERE turn % 3 = 0 GROUP BY 1), g AS (SELECT conv_id, list(turn ORDER BY turn) AS g FROM conversations WHERE turn % 4 = 0 GROUP BY 1),
s(conv_id, d, g, i, j, tp) AS (SELECT conv_id, coalesce(d, []), coalesce(g, []), 1, 1, 0 FROM d FULL JOIN g USING (conv_id)
  UNION ALL SELECT conv_id, d, g, CASE WHEN abs(d[i] - g[j]) <= 1 OR d[i] < g[j] THEN i + 1 ELSE i END, CASE WHEN abs(d[i] - g[j]) <= 1 OR d[i] > g[j] THEN j + 1 ELSE j END, tp + (abs(d[i] - g[j]) <= 1)::INT FROM s WHERE i <= len(d) AND j <= len(g))
SELECT conv_id, max(tp)::BIGINT AS tp, max(len(d)) AS n_detected, max(len(g)) AS n_gold FROM s GROUP BY 1""")
def boundaries(spark, sf_dir):
    ship(spark)
    c = table(spark, sf_dir, "conversations")
    return of.match_boundaries(c.where("turn % 3 = 0").select("conv_id", F.col("turn").alias("pos")), c.where("turn % 4 = 0").select("conv_id", F.col("turn").alias("pos")))


@query("jon22_fact_match", "WITH p AS (SELECT l_orderkey AS a, l_returnflag AS b, count(*) AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), g AS (SELECT l_orderkey AS a, l_returnflag AS b, count(*) AS g FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2) SELECT sum(least(coalesce(p, 0), coalesce(g, 0)))::BIGINT AS tp, sum(coalesce(p, 0) - least(coalesce(p, 0), coalesce(g, 0)))::BIGINT AS fp, sum(coalesce(g, 0) - least(coalesce(p, 0), coalesce(g, 0)))::BIGINT AS fn FROM p FULL JOIN g USING (a, b)")
def fact_match(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return of.match_facts(li.where("l_linenumber <= 3"), li.where("l_quantity > 10"), ["l_orderkey", "l_returnflag"])


@query("set03_semantic_dedup")
def semantic_dedup(spark, sf_dir):
    ship(spark)
    return of.semantic_dedup(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", 0.5).select("vec_id", "label")


@query("vec15_conflicts", f"SELECT a.vec_id AS older, b.vec_id AS newer FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 40 = b.vec_id % 40 AND a.vec_id < b.vec_id AND (a.vec_id % 7 = b.vec_id % 7 OR {DOT.format(a='a.embedding', b='b.embedding')} >= 0.3)")
def conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    f = e.select(F.col("vec_id").alias("fact_id"), F.col("label").alias("contact_id"), (F.col("vec_id") % 7).alias("subject"), (F.col("vec_id") % 40).alias("predicate"), F.col("vec_id").alias("value"), "embedding")
    return of.conflicts(f, 0.3)


@query("win18_topic_segments")
def topic_segments(spark, sf_dir):
    ship(spark)
    return of.topic_segments(chat_messages(spark, sf_dir).withColumn("embedding", of.hash_embedding("text")))


@query("udf04_hash_embedder", f"SELECT id, length(coalesce(text, '')) > 0 AS filled FROM {CV}")
def embedder(spark, sf_dir):
    e = chat_messages(spark, sf_dir).select("id", of.hash_embedding("text").alias("embedding"))
    return e.select("id", F.exists("embedding", lambda x: x != 0).alias("filled"))


@query("win21_last_segment", f"SELECT chat_id, max(date) AS end_time, count(*) FILTER (date > TIMESTAMP '2024-01-20') AS fresh FROM {EV} GROUP BY 1")
def last_segment(spark, sf_dir):
    return event_messages(spark, sf_dir).groupBy("chat_id").agg(F.max("date").alias("end_time"), F.count_if(F.col("date") > F.lit("2024-01-20").cast("timestamp")).alias("fresh"))


@query("scl22_contact_scores", f"""
WITH g AS (SELECT chat_id, count(*) AS n, max(date) AS last FROM {EV} GROUP BY 1), m AS (SELECT max(n) AS most FROM g)
SELECT chat_id, round(0.3 * n / most + 0.7 * exp(-date_diff('day', last::DATE, DATE '2024-02-01') / 7.0), 6) AS score FROM g, m""")
def contact_scores(spark, sf_dir):
    g = event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n"), F.max("date").alias("last")).withColumn("one", F.lit(1))
    m = g.agg(F.max("n").alias("most")).withColumn("one", F.lit(1))
    age = F.datediff(F.lit("2024-02-01").cast("date"), "last")
    return g.join(F.broadcast(m), "one").select("chat_id", F.round(0.3 * F.col("n") / F.col("most") + 0.7 * F.exp(-age / 7.0), 6).alias("score"))


@query("win16_thread_roles", f"""
WITH f AS (SELECT *, CASE WHEN lag(date) OVER w IS NULL OR date_diff('second', lag(date) OVER w, date) > 1800 THEN 1 ELSE 0 END AS s FROM {CV} WINDOW w AS (PARTITION BY chat_id ORDER BY date, id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY chat_id ORDER BY date, id) AS k FROM f)
SELECT chat_id, k::BIGINT AS island, count(*) AS n, count(*) FILTER (is_from_me) AS mine, CASE WHEN arg_min(is_from_me, (date, id)) THEN 'initiator' ELSE 'responder' END AS role, count(*) FILTER (ends_with(trim(text), '?')) AS questions FROM i GROUP BY 1, 2""")
def thread_roles(spark, sf_dir):
    g = seq.gap_threads(chat_messages(spark, sf_dir)).groupBy("chat_id", "island")
    return g.agg(F.count("*").alias("n"), F.count_if("is_from_me").alias("mine"), F.when(F.min_by("is_from_me", F.struct("date", "id")), "initiator").otherwise("responder").alias("role"), F.count_if(F.trim("text").endswith("?")).alias("questions"))


@query("vec08_index_segments", f"SELECT chat_id, count(*) FILTER (length(text) >= 3) AS indexed, md5(substr(string_agg(coalesce(text, ''), ' ' ORDER BY date, id), 1, 1000)) AS digest FROM {CV} GROUP BY 1")
def index_segments(spark, sf_dir):
    g = chat_messages(spark, sf_dir).groupBy("chat_id").agg(F.count_if(F.length("text") >= 3).alias("indexed"), F.sort_array(F.collect_list(F.struct("date", "id", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    return g.select("chat_id", "indexed", F.md5(F.substring(F.array_join(F.transform("m", lambda x: x["text"]), " "), 1, 1000)).alias("digest"))


@query("vec12_index_staleness", "SELECT count(*) AS n, max(vec_id) AS newest, count(*) <> 400 AS stale FROM embeddings")
def staleness(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.max("vec_id").alias("newest"), (F.count("*") != 400).alias("stale"))


@query("vec19_frequent_texts", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, digest LIMIT 50")
def frequent_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n >= 2").orderBy(F.desc("n"), "digest").limit(50)


@query("agg22_word_changes", f"SELECT label, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN len < 0.7 THEN 'shorter' WHEN len > 1.3 THEN 'longer' ELSE 'same' END AS label, count(*) AS n FROM (SELECT length(text) / nullif(lag(length(text)) OVER (PARTITION BY chat_id ORDER BY date, id), 0) AS len FROM {CV}) WHERE len IS NOT NULL GROUP BY 1)")
def word_changes(spark, sf_dir):
    prev = F.lag(F.length("text")).over(Window.partitionBy("chat_id").orderBy("date", "id"))
    r = chat_messages(spark, sf_dir).select((F.length("text") / F.nullif(prev, F.lit(0))).alias("len")).where("len IS NOT NULL")
    g = r.groupBy(F.when(F.col("len") < 0.7, "shorter").when(F.col("len") > 1.3, "longer").otherwise("same").alias("label")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # three rows
