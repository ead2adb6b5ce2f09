"""Scans that run as Spark jobs against plain versions; streams that are run again; slang, events and stores by hand."""

import datetime
import re

import numpy as np
from pyspark.sql import functions as F

from threadlake.functions import dates, slang
from threadlake.operators import facts, vectors
from threadlake.sources import stores
from threadlake.streaming import messages as st


def test_semantic_dedup_equals_scan(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 50 == 0 else f"g{int(rng.integers(0, 3))}", None if i % 41 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(400)]
    rows = [(i, g, v and [float(x / np.linalg.norm(v)) for x in v]) for i, g, v in rows]
    want, kept = set(), {}
    for i, g, v in rows:
        own = kept.setdefault(g, [])
        if v is None or not any(np.dot(v, k) >= 0.9 for k in own):
            want.add(i)
            if v is not None:
                own.append(v)
    df = spark.createDataFrame(rows, "id long, g string, embedding array<double>").repartition(5)
    monkeypatch.setattr(facts, "BLOCK", 20)
    got = facts.semantic_dedup(df, ["g"], "id", 0.9)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(want)
    assert facts.semantic_dedup(df.limit(0), ["g"], "id").count() == 0


def plain_segments(chat, threshold=0.35, factor=4.0, least=0.25, shift=0.25, markers=("btw", "anyway")):
    """chat: (id, hours, text, vector) in order."""
    gaps = [b[1] - a[1] for a, b in zip(chat, chat[1:])]
    limit = max(factor * float(np.median(gaps)) if gaps else 0.0, least)
    out, seg, anchors = {chat[0][0]: 0}, 0, set(re.findall(r"\b[A-Z][a-z]{2,}\b", chat[0][2]))
    for (_, h0, _, v0), (i, h1, text, v1) in zip(chat, chat[1:]):
        drift = 1 - np.dot(v0, v1) / (np.linalg.norm(v0) * np.linalg.norm(v1))
        own = set(re.findall(r"\b[A-Z][a-z]{2,}\b", text))
        shared = len(own & anchors) / len(own | anchors) if own and anchors else 0.0
        score = 0.4 * drift + 0.3 * (1 - shared) + (0.2 if h1 - h0 > limit else 0.0) + (shift if any(m in text.lower() for m in markers) else 0.0)
        anchors |= own
        if score >= threshold + 0.3 or h1 - h0 > limit:
            seg, anchors = seg + 1, own
        out[i] = seg
    return out


def test_topic_segments_equal_scan(spark):
    rng = np.random.default_rng(1)
    words = ["Anna", "Berlin", "btw", "so", "yes", "Carla", "fine"]
    rows, want, n = [], {}, 0
    for chat in range(4):
        at, own = 0.0, []
        for _ in range((1, 2, 40, 90)[chat]):
            at += float(rng.choice([1 / 60, 3 / 60, 5 / 60, 2.0], p=[0.5, 0.25, 0.2, 0.05]))
            own.append((n, at, " ".join(rng.choice(words, 3)), [float(x) for x in rng.normal(size=4)]))
            n += 1
        want |= plain_segments(own)
        rows += [(i, chat, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), t, v) for i, h, t, v in own]
    df = spark.createDataFrame(rows, "id long, chat_id long, date timestamp, text string, embedding array<double>").repartition(3)
    assert {r["id"]: r["segment"] for r in facts.topic_segments(df, markers=("btw", "anyway")).collect()} == want


def test_similarities_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, embedding array<double>")
    q = v.where("id < 5").withColumnRenamed("id", "q")
    monkeypatch.setattr(vectors, "QUERIES", 2)
    got = {(r["id"], r["q"]): r["sim"] for r in vectors.similarities(v, q, "id", "q").collect()}
    assert got == {(i, j): i * j + 1.0 for i in range(9) for j in range(5)}
    assert vectors.similarities(v, q.limit(0), "id", "q").count() == 0


def test_batches_that_are_tried_again(spark, tmp_path):
    df = spark.range(5)
    for _ in range(2):
        st.put(df, str(tmp_path / "t"), 0)
    st.put(df, str(tmp_path / "t"), 1)
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 5)]


def test_slang(spark):
    cases = {"u coming rn?": "you coming right now?", "IDK": "I DON'T KNOW", "U?": "You?", "burn urn fur": "burn urn fur", "no cap": "no lie", "w/me": "withme", "w/ me": "w/ me", "": "", "Brb,\nttyl": "Be right back,\ntalk to you later"}
    df = spark.createDataFrame([*((k,) for k in cases), (None,)], "text string")
    assert {r["text"]: r["e"] for r in df.select("text", slang.expanded("text").alias("e")).collect()} == {**cases, None: None}


def test_events_in_text(spark):
    now = F.lit("2024-01-03 15:00:00").cast("timestamp")  # a Wednesday
    df = spark.createDataFrame([(0, "lunch on wednesday at 12:15. Game next weekend"), (1, "call tomorrow at 77"), (2, None), (3, "no event today"), (4, "meeting this weekend in Old Town for")], "id int, text string")
    got = {r["id"]: [(e["title"], e["start"], e["all_day"], e["place"], e["confidence"]) for e in r["e"]] for r in df.select("id", dates.events(F.col("text"), now).alias("e")).collect()}
    day = datetime.datetime
    assert got == {
        0: [("Lunch", day(2024, 1, 3, 12, 15), False, None, 0.7), ("Game", day(2024, 1, 13, 9), True, None, 0.5)],
        1: [("Call", day(2024, 1, 4, 9), True, None, 0.55)],
        2: [],
        3: [("No event", day(2024, 1, 3, 9), True, None, 0.55)],
        4: [("Meeting", day(2024, 1, 6, 9), True, "Old Town", 0.575)],
    }


def test_stores(spark, tmp_path):
    assert all(stores.schema(n).fields for n in stores.STORES)
    df = spark.createDataFrame([("7", "x", "extra"), ("no number", "y", "extra")], "id string, action string, other string")
    for form in ("parquet", "json"):
        stores.write(df, str(tmp_path / form), "feedback", form)
        got = stores.read(spark, str(tmp_path / form), "feedback", form)
        assert got.columns == stores.schema("feedback").names
        assert sorted((r["id"] or -1, r["action"], r["contact_id"]) for r in got.collect()) == [(-1, "y", None), (7, "x", None)]
