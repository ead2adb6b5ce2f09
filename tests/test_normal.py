"""Hand-built cases of text cleaning; cleaning twice changes nothing."""

import pytest
from pyspark.sql import functions as F

from threadlake.functions import normal as no

CLEAN = [
    (None, ""),
    ("", ""),
    ("Liked “hello”", ""),
    ('loved "a\nb"', ""),
    ("Liked hello", "Liked hello"),
    ("Hey   there!!!", "Hey there!!!"),
    ("a​b﻿ \t c\n\n  d  ", "ab c\nd"),
    ("hi\nSent from my iPhone 12", "hi"),
    ("hi\n-- \nJo\nBoss", "hi"),
    ("😭😭😭😭 ok", "😭😭 ok"),
]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalise(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "i int, t string")
    twice = df.withColumn("a", no.normalise(F.col("t"))).withColumn("b", no.normalise(F.col("a"))).orderBy("i").collect()
    for r, (text, want) in zip(twice, CLEAN, strict=True):
        assert (r["a"], r["b"]) == (want, want), text


@pytest.mark.parametrize(
    "text,want",
    [
        ("see https://Example.org:80/a?b and http://X.io", "see <URL:example.org:80> and <URL:x.io>"),
        ("https://a.io https://a.io/b", "<URL:a.io> <URL:a.io>"),
        ("http:///x", "<URL>"),
        ("no links", "no links"),
    ],
)
def test_domains(spark, text, want):
    assert one(spark, text, no.url_domains) == want


def test_masks(spark):
    assert one(spark, "your code is 48213, not 12", no.codes_masked) == "your code is <CODE>, not 12"
    assert one(spark, "meet me at 48213", no.codes_masked) == "meet me at 48213"
    masked = one(spark, "call Anna Lee in San Diego, they beat Lions; a@b.co @joe 555-123-4567", no.entities_masked)
    assert masked == "call <PERSON> in <CITY>, they beat <TEAM>; <EMAIL> <PERSON> <PHONE>"


def test_predicates(spark):
    rows = ["Sounds good!!", "ok", "okay then", "😀 😀", "😀 a", "btw, look", "What now", "whatever", "is it?", "see you tomorrow at 5 pm, next week or in 3 days", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    t = F.col("t")
    got = df.select(no.is_acknowledgment(t), no.is_emoji_only(t), no.starts_new_topic(t), no.is_question(t), no.temporal_refs(t)).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False, False, False, False, False]
    assert [i for i, r in enumerate(got) if r[1]] == [3]
    assert [i for i, r in enumerate(got) if r[2]] == [5]
    assert [i for i, r in enumerate(got) if r[3]] == [6, 8]
    assert got[9][4] == ["tomorrow", "at 5 pm", "next week", "in 3 days"] and got[10][4] == []


def test_tasks(spark):
    rows = ["https://x.io", "your security code is 1234", "12345", "NSAttributedString", "u ok? 😂", "ab", "x" * 1500, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {task: [r["clean"] for r in no.written_for(df, "t", task).orderBy("i").collect()] for task in no.PROFILES}
    assert got["classification"] == ["", "", "", "", "you ok? <EMOJI_LAUGH>", "ab", "", ""]
    assert got["extraction"] == ["", "", "", "", "you ok? 😂", "ab", "x" * 1500, ""]
    assert got["topic_modeling"][5] == "" and got["chunk_embedding"][6] == "x" * 1500
