"""Hand-built cases of tone, naturalness, length and what edits ask for."""

import pytest
from pyspark.sql import functions as F

from threadlake.functions import tone as to
from threadlake.operators import suggestions as su

TONES = [
    (None, (0.5, 0, 0, 0, 0, 0)),
    (" \n", (0.5, 0, 0, 0, 0, 0)),
    ("lol idk!!", (0.0, 0, 2.0, 0, 2.0, 2)),
    ("Would you please send the report? However, we appreciate it.", (round(4 / 5, 3), 0, 0, 0.5, 5.0, 0)),
    ("ok 😀😀", (0.0, round(2 / 5 * 100, 3), 0, 0, 2.0, 1)),
    ("...", (0.0, 0, 0, 0, 0.0, 0)),
    (" ".join(["word"] * 25), (round(0.5 + 0.2, 3), 0, 0, 0, 25.0, 0)),
]


def test_tone(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TONES)], "i int, t string").select("i", to.tone(F.col("t")).alias("x")).orderBy("i").collect()
    for r, (text, want) in zip(rows, TONES, strict=True):
        assert tuple(r["x"]) == pytest.approx(want), text


def test_similarity_of_tones(spark):
    df = spark.createDataFrame([("lol!!", "lol!!"), ("lol!!", "Would you kindly appreciate it"), (None, "x")], "a string, b string")
    same, other, null = (r[0] for r in df.select(to.tone_similarity(to.tone(F.col("a")), to.tone(F.col("b")))).collect())
    assert same == 1 and other < 0.6 and 0 <= null <= 1


@pytest.mark.parametrize("text,want", [(None, 0), ("", 0), ("sounds good to me", 1), ("the the the the", 1 - 0.2 - 0.3), ("as an ai i cannot help", 0.7), ("hm!!!", 0.9), ("i don't have it", 0.95), ("a a b", 0.9), ("x", 1)])
def test_naturalness(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(to.naturalness(F.col("t"))).first()[0] == pytest.approx(want)


def test_length_score(spark):
    rows = [(5, None, None, 0), (100, None, None, None), (300, None, None, 0), (600, None, None, 0), (120, 100.0, 40.0, 9), (60, 100.0, 40.0, 9), (60, 100.0, None, 1), (60, 100.0, 2.0, 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "l int, m double, d double, n int").select(to.length_score(*map(F.col, "lmdn"))).collect()]
    import math

    assert got == pytest.approx([0.5, 1.0, 0.8, 0.5, 1.0, math.exp(-0.75), math.exp(-0.6), math.exp(-1.0)])


def test_improvements(spark):
    rows = [(i, "please come to the party tonight", "come lol!!") for i in range(4)] + [(9, "x", ""), (10, "y", None), (11, "", "come lol!!")]
    df = spark.createDataFrame(rows, "id long, suggestion string, edited string")
    got = {(r["type"], r["suggestion"]): (r["detail"], r["confidence"]) for r in su.improvements(df).collect()}
    assert got["length", "Generate shorter responses"][1] == 0.25
    assert got["vocabulary", "Avoid certain words/phrases"] == ("Frequently removed: party, please, the, to, tonight", 0.4)
    assert got["vocabulary", "Include certain words/phrases more often"] == ("Frequently added: lol!!, come", 0.5)
    assert ("tone", "Use more casual language") in got
    assert su.improvements(df.where("false")).count() == 0
    assert [r["type"] for r in su.improvements(df.where("id >= 9")).collect()] == ["tone"]
