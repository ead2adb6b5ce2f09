"""Queries over versioned vector tables (SRC-08, SRC-13, VEC-08)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from threadlake.operators import facts as of
from threadlake.operators import sequences as seq
from threadlake.plans.registry import query
from threadlake.session import dealt, shared_dir, stored
from threadlake.sources import vectorstore as vs
from threadlake.sources.tables import CV, chat_messages, table

CUT = "2024-01-03"
DIM = 64


def _store(spark) -> str:
    return f"{shared_dir(spark)}/vectors-{uuid4().hex}"


def _messages(spark, sf_dir):
    """Messages with their vectors, which are worked out once, by all cores however the table lies in files, and written, as several runs read them."""
    return stored(of.embedded(dealt(chat_messages(spark, sf_dir), "id"), "hash"), "embedded")


@query("src08_typed_vectors", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: trunc(x * 127::FLOAT)::TINYINT) AS b, list_transform(range(16), lambda k: list_sum(list_transform(range(4), lambda j: CASE WHEN embedding[k * 4 + j + 1] > 0 THEN 8 >> j ELSE 0 END))) AS h FROM embeddings)
SELECT vec_id, label::VARCHAR AS chat_id, md5(array_to_string(b, ',')) AS digest, array_to_string(list_transform(h, lambda x: format('{:X}', x::INT)), '') AS bits FROM v""")
def typed_vectors(spark, sf_dir):
    """Vectors as a typed table of a store, written and read back: bytes (as a digest) and packed signs."""
    base = _store(spark)
    vs.add_version(spark, base, "v1", "given", DIM)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("chat_id"), F.lit("abc").alias("text"), F.lit("x").alias("sender"), F.lit(0).cast("timestamp").alias("date"), F.lit(False).alias("is_from_me"), "embedding")
    vs.index_messages(v, base, "v1", DIM)
    r = vs.read(spark, base, "messages", "v1")
    return r.select(F.col("id").alias("vec_id"), "chat_id", F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",")).alias("digest"), F.hex("bits").alias("bits"))


@query("vec08_message_index", f"SELECT id, chat_id::VARCHAR AS chat_id, substr(text, 1, 200) AS preview, sender, epoch(date)::BIGINT AS timestamp, is_from_me, CASE WHEN date < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS batch, len(text) > 0 AS filled FROM {CV} WHERE length(trim(text)) >= 3")
def message_index(spark, sf_dir):
    """Messages up to a day, then all: the second run adds only those that are new, the third nothing."""
    base = _store(spark)
    vs.add_version(spark, base, "v1", "hash", DIM)
    m = _messages(spark, sf_dir)
    for own in (m.where(F.col("date") < F.lit(CUT).cast("timestamp")), m, m):
        vs.index_messages(own, base, "v1", DIM)
    return vs.read(spark, base, "messages", "v1").select("id", "chat_id", "preview", "sender", "timestamp", "is_from_me", "batch", F.exists("embedding", lambda x: x != 0).alias("filled"))


@query("vec08_segment_index", f"""
WITH f AS (SELECT *, CASE WHEN lag(date) OVER w IS NULL OR date_diff('second', lag(date) OVER w, date) > 1800 THEN 1 ELSE 0 END AS s FROM {CV} WINDOW w AS (PARTITION BY chat_id ORDER BY date, id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY chat_id ORDER BY date, id) AS k FROM f)
SELECT chat_id::VARCHAR AS chat_id, epoch(min(date))::BIGINT AS timestamp, substr(string_agg(text, chr(10) ORDER BY date, id) FILTER (NOT is_from_me AND text <> ''), 1, 1000) AS context, coalesce(substr(string_agg(text, chr(10) ORDER BY date, id) FILTER (is_from_me AND text <> ''), 1, 1000), '') AS reply, count(*) AS n
FROM i GROUP BY chat_id, k HAVING coalesce(string_agg(text, '') FILTER (NOT is_from_me AND text <> ''), '') <> ''""")
def segment_index(spark, sf_dir):
    """Threads as segments: what the others said, what was answered, and the mean vector."""
    base = _store(spark)
    vs.add_version(spark, base, "v1", "hash", DIM)
    m = seq.gap_threads(_messages(spark, sf_dir)).withColumn("segment_id", F.concat_ws("-", "chat_id", "island"))
    means = m.select("segment_id", F.posexplode("embedding").alias("pos", "x")).groupBy("segment_id", "pos").agg(F.avg("x").alias("x"))
    centre = means.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"].cast("float")).alias("embedding"))
    vs.index_segments(m, centre, base, "v1", DIM)
    return vs.read(spark, base, "segments", "v1").select("chat_id", "timestamp", "context", "reply", "n")


@query("src13_version_catalog", f"""
SELECT 'v1' AS version, 'hash' AS model, 64 AS dim, (SELECT count(*) FROM {CV} WHERE length(trim(text)) >= 3 AND date < TIMESTAMP '{CUT}') AS vectors, false AS is_active
UNION ALL SELECT 'v2', 'hash', 64, (SELECT count(*) FROM {CV} WHERE length(trim(text)) >= 3), true UNION ALL SELECT 'v3', 'none', 64, 0, false""")
def version_catalog(spark, sf_dir):
    """Three versions, of which the second is made active after the first."""
    base, m = _store(spark), _messages(spark, sf_dir)
    for version, model in (("v1", "hash"), ("v2", "hash"), ("v3", "none")):
        vs.add_version(spark, base, version, model, DIM)
    vs.index_messages(m.where(F.col("date") < F.lit(CUT).cast("timestamp")), base, "v1", DIM)
    vs.activate(spark, base, "v1")
    vs.index_messages(m, base, "v2", DIM)
    vs.activate(spark, base, "v2")
    return vs.versions(spark, base)


@query("vec12_store_staleness", f"""
WITH m AS (SELECT * FROM {CV} WHERE length(trim(text)) >= 3)
SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM m WHERE date < TIMESTAMP '{CUT}') AS indexed, (SELECT epoch(max(date))::BIGINT FROM m) AS newest, (SELECT epoch(max(date))::BIGINT FROM m WHERE date < TIMESTAMP '{CUT}') AS newest_indexed,
  (SELECT count(*) FROM m WHERE date >= TIMESTAMP '{CUT}') > 0 AS stale""")
def store_staleness(spark, sf_dir):
    """Whether the active version has all messages, by their number and the newest one, after a run up to a day."""
    base, m = _store(spark), _messages(spark, sf_dir)
    vs.add_version(spark, base, "v1", "hash", DIM)
    vs.index_messages(m.where(F.col("date") < F.lit(CUT).cast("timestamp")), base, "v1", DIM)
    vs.activate(spark, base, "v1")
    return vs.staleness(m, base)


@query("udf04_letter_embedder", "SELECT doc_id, md5(array_to_string([" + ", ".join(f"length(low) - length(replace(low, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz") + "], ',')) AS digest FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)")
def letter_embedder(spark, sf_dir):
    """A registered embedder by its name, without normalisation."""
    e = of.embedded(table(spark, sf_dir, "documents"), "letters", normalize=False)
    return e.select("doc_id", F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",")).alias("digest"))
