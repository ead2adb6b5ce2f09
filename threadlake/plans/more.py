"""Further scalar, retrieval and streaming queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadlake.functions import text as tx
from threadlake.operators import facts as of
from threadlake.operators import messages as ops
from threadlake.operators import vectors as ov
from threadlake.plans.registry import query
from threadlake.plans.texts import I8, _knn, first_vector
from threadlake.session import shared_dir, ship
from threadlake.sources.tables import CV, EV, chat_messages, table
from threadlake.streaming import messages as st


@query("scl02_phone", """
WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' (555) ' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') WHEN 1 THEN '+44 ' || c_custkey WHEN 2 THEN 'User' || c_custkey || '@Mail.Com ' ELSE '1-555-' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') END AS v FROM customer),
d AS (SELECT c_custkey, trim(v) AS v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM p)
SELECT c_custkey, CASE WHEN contains(v, '@') THEN lower(v) WHEN starts_with(v, '+') THEN '+' || d WHEN length(d) = 10 THEN '+1' || d WHEN length(d) = 11 AND starts_with(d, '1') THEN '+' || d ELSE d END AS phone FROM d""")
def phone(spark, sf_dir):
    k = F.col("c_custkey")
    tail = F.lpad((k % 10000000).cast("string"), 7, "0")
    v = F.when(k % 4 == 0, F.concat(F.lit(" (555) "), tail)).when(k % 4 == 1, F.concat(F.lit("+44 "), k)).when(k % 4 == 2, F.concat(F.lit("User"), k, F.lit("@Mail.Com "))).otherwise(F.concat(F.lit("1-555-"), tail))
    return table(spark, sf_dir, "customer").select("c_custkey", ops.normal_phone(v).alias("phone"))


@query("scl03_attributed_body", "SELECT n_nationkey, n_name AS text FROM nation")
def attributed_body(spark, sf_dir):
    ship(spark)
    n = table(spark, sf_dir, "nation")
    head = F.lit(bytearray(b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x12NSString\x01\x94\x84\x01+"))
    body = F.concat(head, F.unhex(F.lpad(F.hex(F.length("n_name")), 2, "0")), F.encode("n_name", "UTF-8"))
    return n.withColumn("body", body).select("n_nationkey", of.decode_attributed_body("body").alias("text"))


@query("scl06_display_names", "SELECT n_regionkey, array_to_string(list_sort(list(n_name))[1:3], ', ') || CASE WHEN count(*) > 3 THEN '...' ELSE '' END AS name FROM nation GROUP BY 1")
def display_names(spark, sf_dir):
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return g.select("n_regionkey", F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.when(F.size("names") > 3, "...").otherwise("")).alias("name"))


@query("scl10_predicates", rf"SELECT id, ends_with(rtrim(text), '?') AS asks, regexp_matches(lower(text), '^(btw|by the way|anyway|also|speaking of|side note)\b') AS shifts, length(text) - length(regexp_replace(text, '\d', '', 'g')) AS digits, regexp_matches(lower(text), '\b(today|tonight|tomorrow|yesterday)\b') AS temporal FROM {CV}")
def predicates(spark, sf_dir):
    low = F.lower("text")
    return chat_messages(spark, sf_dir).select("id", F.rtrim("text").endswith("?").alias("asks"), low.rlike(r"^(btw|by the way|anyway|also|speaking of|side note)\b").alias("shifts"), (F.length("text") - F.length(F.regexp_replace("text", r"\d", ""))).alias("digits"), low.rlike(r"\b(today|tonight|tomorrow|yesterday)\b").alias("temporal"))


@query("scl16_relationship", f"""
WITH f AS (SELECT chat_id, avg(length(text)) AS len, count(*) FILTER (is_from_me) / count(*) AS mine, var_pop(hour(date)) AS spread FROM {CV} GROUP BY 1),
s AS (SELECT chat_id, CASE WHEN len > 200 THEN 0.4 ELSE 0 END + CASE WHEN spread < 2 THEN 0.2 ELSE 0 END AS work, CASE WHEN len <= 200 THEN 0.4 ELSE 0 END + CASE WHEN mine BETWEEN 0.4 AND 0.6 THEN 0.2 ELSE 0 END AS friend FROM f)
SELECT chat_id, CASE WHEN work >= friend THEN 'work' ELSE 'friend' END AS category, round(least(greatest(work, friend) / 0.6, 1), 4)::DOUBLE AS confidence FROM s""")
def relationship(spark, sf_dir):
    f = chat_messages(spark, sf_dir).groupBy("chat_id").agg(F.avg(F.length("text")).alias("len"), (F.count_if("is_from_me") / F.count("*")).alias("mine"), F.var_pop(F.hour("date")).alias("spread"))
    work = F.when(F.col("len") > 200, 0.4).otherwise(0.0) + F.when(F.col("spread") < 2, 0.2).otherwise(0.0)
    friend = F.when(F.col("len") <= 200, 0.4).otherwise(0.0) + F.when(F.col("mine").between(0.4, 0.6), 0.2).otherwise(0.0)
    return f.select("chat_id", F.when(work >= friend, "work").otherwise("friend").alias("category"), F.round(F.least(F.greatest(work, friend) / 0.6, F.lit(1.0)), 4).alias("confidence"))


@query("scl18_action_items", rf"SELECT id, regexp_extract(lower(text), '\b(?:to|will|need to)\s+([a-z]+)', 1) AS item FROM {CV} WHERE regexp_matches(lower(text), '\b(?:to|will|need to)\s+[a-z]+')")
def action_items(spark, sf_dir):
    m = chat_messages(spark, sf_dir).where(F.lower("text").rlike(r"\b(?:to|will|need to)\s+[a-z]+"))
    return m.select("id", F.regexp_extract(F.lower("text"), r"\b(?:to|will|need to)\s+([a-z]+)", 1).alias("item"))


@query("scl26_attribution", f"SELECT id, CASE WHEN regexp_matches(lower(text), '\\b(he|she|they|his|her|their)\\b') THEN 'third_party' WHEN is_from_me THEN 'user' ELSE 'contact' END AS owner FROM {CV}")
def attribution(spark, sf_dir):
    return chat_messages(spark, sf_dir).select("id", F.when(F.lower("text").rlike(r"\b(he|she|they|his|her|their)\b"), "third_party").when(F.col("is_from_me"), "user").otherwise("contact").alias("owner"))


@query("flt12_validity_gate", f"SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) < 10 THEN 'short' WHEN NOT regexp_matches(text, '[A-Za-z]{{3}}') THEN 'no_words' ELSE 'passed' END AS reason, count(*) AS n FROM {CV} GROUP BY 1")
def validity(spark, sf_dir):
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.length("text") < 10, "short").when(~F.col("text").rlike("[A-Za-z]{3}"), "no_words").otherwise("passed")
    return chat_messages(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("vec06_knn_chunks", _knn("(SELECT vec_id, embedding FROM embeddings WHERE label = 3)"))
def knn_chunks(spark, sf_dir):
    return ov.nearest(table(spark, sf_dir, "embeddings").where("label = 3"), first_vector(spark, sf_dir), 10)


@query("vec09_dequantised", f"SELECT vec_id, round(list_sum(list_transform({I8.format(v='embedding')}, lambda x: x / 127.0)), 4) + 0.0 AS total FROM embeddings")
def dequantised(spark, sf_dir):
    q = ov.quantise("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(F.aggregate(q, F.lit(0.0), lambda s, x: s + x / 127.0), 4) + F.lit(0.0)).alias("total"))


@query("jon19_nearest_of_many", """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS sim FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank FROM r WHERE rank <= 5""")
def nearest_of_many(spark, sf_dir):
    """A stated query set (every fiftieth row) against all rows: queries go to every task in blocks, each task keeps its best."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ov.nearest_of_queries(e, q, 5, "vec_id", "query_id").select("query_id", "vec_id", "rank")


def _in_parts(spark, sf_dir, parts: list[str], run) -> None:
    """Write events by the conditions, one after another, into a folder, and run(folder, number) each time."""
    base = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    for i, rows in enumerate(parts):
        table(spark, sf_dir, "events").where(rows).write.mode("append").parquet(f"{base}/in")
        run(base, i)


@query("str07_watermark_counts", f"SELECT event_type, count(*) AS n FROM {EV} WHERE date >= TIMESTAMP '2024-01-08' GROUP BY 1")
def watermark_counts(spark, sf_dir):
    """Events from the eighth of January on come in two runs, each a batch; those before the sixth come last, later than the watermark lets in, and are dropped."""
    ship(spark)
    out = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"

    def run(base: str, i: int) -> None:
        windows = st.sliding(st.event_stream(spark, f"{base}/in", None), "1 day", "1 day", "1 day")
        st.drain(windows, "update", lambda df, batch: st.put(df, f"{out}/rows", batch), out)

    _in_parts(spark, sf_dir, ["ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-20'", "ts >= TIMESTAMP '2024-01-20'", "ts < TIMESTAMP '2024-01-06'"], run)
    # a window's newest count is its largest
    newest = spark.read.parquet(f"{out}/rows").groupBy("start", "event_type").agg(F.max("n").alias("n"))
    return newest.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("str02_restart", f"SELECT id, chat_id, CASE WHEN date < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS run FROM {EV}")
def restart(spark, sf_dir):
    """A tail that is stopped and run again over more rows goes on from its offset: every row comes once, in the run in which it was new."""
    ship(spark)
    out = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"

    def run(base: str, i: int) -> None:
        rows = st.event_stream(spark, f"{base}/in").select("id", "chat_id")
        st.drain(rows, "append", lambda df, batch: st.put(df.withColumn("run", F.lit(i)), f"{out}/rows", batch), out)

    _in_parts(spark, sf_dir, ["ts < TIMESTAMP '2024-01-15'", "ts >= TIMESTAMP '2024-01-15'"], run)
    return spark.read.parquet(f"{out}/rows").select("id", "chat_id", "run")


@query("snk12_buffered_metrics", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {EV} GROUP BY 1")
def buffered_metrics(spark, sf_dir):
    """Micro-batches put into a metrics table, each once however often it is tried, then read."""
    ship(spark)
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    st.drain(st.event_stream(spark, f"{sf_dir}/events.parquet").select("event_type", "value"), "append", lambda df, batch: st.put(df, path, batch))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("scl20_naturalness", f"SELECT id, round(exp(-abs(length(text) - 120) / 100.0), 6) AS length_score FROM {CV}")
def naturalness(spark, sf_dir):
    return chat_messages(spark, sf_dir).select("id", F.round(F.exp(-F.abs(F.length("text") - 120) / 100.0), 6).alias("length_score"))


@query("agg46_fleiss_kappa", """
WITH r AS (SELECT doc_id, quality + toxic + (doc_id % 2) AS yes FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), k AS (SELECT count(*) AS n, sum(yes) AS yes, sum((yes * yes + (3 - yes) * (3 - yes) - 3) / 6.0) AS agree FROM r),
p AS (SELECT n, agree / n AS po, yes / (3.0 * n) AS p FROM k) SELECT n, round(po, 6) AS agreement, round((po - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa FROM p""")
def fleiss(spark, sf_dir):
    r = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select((F.col("quality") + F.col("toxic") + F.col("doc_id") % 2).alias("yes"))
    y = F.col("yes")
    k = r.agg(F.count("*").alias("n"), F.sum("yes").alias("yes"), F.sum((y * y + (3 - y) * (3 - y) - 3) / 6.0).alias("agree"))
    po, p = F.col("agree") / F.col("n"), F.col("yes") / (3.0 * F.col("n"))
    pe = p * p + (1 - p) * (1 - p)
    return k.select("n", F.round(po, 6).alias("agreement"), F.round((po - pe) / (1 - pe), 6).alias("kappa"))


@query("scl09_normalised", f"SELECT id, CASE WHEN regexp_matches(t, '{tx.REACTION}') THEN '' ELSE t END AS text FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{tx.INVISIBLE}', '', 'g'), '{tx.SIGNATURE}', ''), '\\s+', ' ', 'g')) AS t FROM {CV})")
def normalised(spark, sf_dir):
    """The data hold no emoji, which SQL here could not collapse."""
    return chat_messages(spark, sf_dir).select("id", tx.normalised("text").alias("text"))
