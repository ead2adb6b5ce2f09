"""Queries on typed stores, slang and events in text, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadlake.functions import dates, slang
from threadlake.plans.registry import query
from threadlake.session import dealt, shared_dir
from threadlake.sources import stores
from threadlake.sources.tables import table

#: Messages in which terms stand alone, in capitals, next to signs and inside other words; and what they are written out as.
SPOKEN = (
    ("u coming rn?", "you coming right now?"),
    ("IDK what to do", "I DON'T KNOW what to do"),
    ("U free? lmk", "You free? let me know"),
    ("burn the fur", "burn the fur"),
    ("no cap that is lit", "no lie that is exciting"),
    ("Hello, how are you doing today?", "Hello, how are you doing today?"),
    ("brb, ttyl!", "be right back, talk to you later!"),
)
#: Messages with events; title, days after 2024-01-03 (a Wednesday), minutes after midnight, whether all day, place and confidence.
PLANNED = (
    ("Dinner with Ana tomorrow at 7pm", "Dinner with Ana tomorrow at", 1, 1140, False, None, 0.725),
    ("See you. Team meeting on friday at 10:30 at Blue Room, ok?", "Team meeting", 2, 630, False, "Blue Room", 0.775),
    ("party this weekend", "Party", 3, 540, True, None, 0.5),
    ("party next weekend! lunch today 12 @cafe", "Lunch", 0, 720, False, "cafe", 0.8),
    ("no day for this call", None, None, None, None, None, None),
    ("Flight next week", "Flight", 7, 540, True, None, 0.55),
    ("doctor monday 99", "Doctor", 5, 540, True, None, 0.525),
)


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(lit, r))})" for i, r in enumerate(rows)) + ")"


def _said(spark, sf_dir, texts: list[str]):
    """events with one of the texts each, in turn."""
    pick = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % len(texts) + 1).cast("int"))
    return dealt(table(spark, sf_dir, "events"), "event_id").select("event_id", pick.alias("text"))


@query("scl11_slang", f"SELECT event_id, expanded FROM events JOIN {_values(SPOKEN)} t(i, text, expanded) ON i = event_id % {len(SPOKEN)}")
def written_out(spark, sf_dir):
    return _said(spark, sf_dir, [t for t, _ in SPOKEN]).select("event_id", slang.expanded("text").alias("expanded"))


@query("scl11_slang_terms", "SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ', ' (u|ur|rn|idk|lol|omg|des|v) ')) AS n FROM documents")
def slang_terms(spark, sf_dir):
    """How many of a few terms stand alone in each document: a table of one's own marks them."""
    marked = slang.expanded("text", {t: "\x01" for t in ("u", "ur", "rn", "idk", "lol", "omg", "des", "v")})
    d = table(spark, sf_dir, "documents").select("doc_id", "text", marked.alias("m"))
    return d.select("doc_id", (F.length("m") - F.length(F.replace("m", F.lit("\x01"), F.lit("")))).alias("n"))


@query("scl19_events", f"""
SELECT event_id, title, (DATE '2024-01-03' + ahead::INT)::DATE::VARCHAR AS day, minute::INT AS minute, all_day, place, confidence::DOUBLE AS confidence
FROM events JOIN {_values(PLANNED)} t(i, text, title, ahead, minute, all_day, place, confidence) ON i = event_id % {len(PLANNED)}""")
def planned(spark, sf_dir):
    e = _said(spark, sf_dir, [r[0] for r in PLANNED]).withColumn("e", F.get(dates.events(F.col("text"), F.lit("2024-01-03 15:00:00").cast("timestamp")), F.lit(0)))
    return e.select("event_id", "e.title", F.to_date("e.start").cast("string").alias("day"), (F.hour("e.start") * 60 + F.minute("e.start")).alias("minute"), "e.all_day", "e.place", "e.confidence")


def _feedback(spark, sf_dir):
    """events as feedback: purchases are accepted, errors rejected, clicks edited."""
    action = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "edited")
    e = table(spark, sf_dir, "events").withColumn("action", action).where("action IS NOT NULL")
    return e.select(F.col("event_id").alias("id"), "action", F.col("user_id").cast("string").alias("contact_id"), F.create_map(F.lit("value"), F.round("value", 2).cast("string")).alias("metadata"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(1).alias("unknown"))


@query("src09_feedback_store", "SELECT CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'edited' END AS action, count(*) AS n, count(DISTINCT user_id) AS contacts, round(sum(round(value, 2)), 2) AS total, max(ts)::TIMESTAMP AS last, 0::BIGINT AS suggestions FROM events WHERE event_type IN ('purchase', 'error', 'click') GROUP BY 1")
def feedback_store(spark, sf_dir):
    """Laid down as JSON lines and read back in its types: an unknown field is gone, missing ones are null."""
    path = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    stores.write(_feedback(spark, sf_dir), path, "feedback", "json")
    f = stores.read(spark, path, "feedback", "json")
    value = F.element_at("metadata", "value").cast("double")
    return f.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("contact_id").alias("contacts"), F.round(F.sum(value), 2).alias("total"), F.max("timestamp").alias("last"), F.count("suggestion_id").alias("suggestions"))


@query("src09_task_store", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, sum(o_orderkey % 3)::BIGINT AS retries FROM orders GROUP BY 1")
def task_store(spark, sf_dir):
    """A queue from an older writer, whose numbers are text and which has no error column."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    old = o.select(F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), (F.col("o_orderkey") % 3).cast("string").alias("retries"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("completed_at"))
    path = f"{shared_dir(spark)}/tasks-{uuid.uuid4().hex}"
    old.write.parquet(path)
    return stores.read(spark, path, "tasks").groupBy("status").agg(F.count("*").alias("n"), F.count("completed_at").alias("finished"), F.sum("retries").alias("retries"))


@query("src07_segment_store", "SELECT o_custkey::VARCHAR AS chat_id, count(*) AS segments, sum(n)::BIGINT AS messages FROM (SELECT o_custkey, o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def segment_store(spark, sf_dir):
    """Segments and their messages as two stores, joined again by segment."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    segments = stores.typed(o.select(F.col("o_orderkey").cast("string").alias("segment_id"), F.col("o_custkey").cast("string").alias("chat_id")), "segments")
    members = stores.typed(li.select(F.col("l_orderkey").cast("string").alias("segment_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"), F.col("l_linenumber").alias("position")), "segment_messages")
    n = members.groupBy("segment_id").agg(F.count("message_id").alias("n"))
    return segments.join(n, "segment_id", "left").groupBy("chat_id").agg(F.count("*").alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
