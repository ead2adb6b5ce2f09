"""The hash embedder: signed counts, worked out once."""

import os

import pytest
from pyspark.sql import functions as F

from threadlake.operators import facts
from threadlake.plans import vectorstores

SF = "/root/testdata/sf0.001"


def codes(spark, words):
    """Component and sign of each word."""
    w = spark.createDataFrame([(x,) for x in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("at"), F.when(F.xxhash64("w") > 0, 1).otherwise(-1).alias("sign"))
    return {r["w"]: (r["at"], r["sign"]) for r in w.collect()}


def vectors(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(2)
    return {r["id"]: r["v"] for r in d.select("id", facts.hash_embedding("text").alias("v")).collect()}


def test_signed_counts(spark):
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(words[:k]) + ", Word1! WORD1" for k in (1, 7, 40)] + ["", None]
    known, got = codes(spark, words), vectors(spark, texts)
    for i, k in enumerate((1, 7, 40)):
        want = [0.0] * 64
        for w in [*words[:k], "word1", "word1"]:
            want[known[w][0]] += known[w][1]
        assert got[i] == want
    assert got[3] == got[4] == [0.0] * 64


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_an_index_reads_vectors_that_are_written(spark):
    m = vectorstores._messages(spark, SF)
    assert "xxhash64" not in m._jdf.queryExecution().toString()
    assert {len(r["embedding"]) for r in m.collect()} == {64}


def test_words_that_cancel_out(spark):
    known = codes(spark, [f"w{i}" for i in range(400)])
    a, b = next((a, b) for a in known for b in known if known[a][0] == known[b][0] and known[a][1] > known[b][1])
    got = vectors(spark, [f"{a} {b}", "!!", "", f"{a} {b} {a}"])
    for i, text in enumerate((f"{a} {b}", "!!")):
        at, sign = codes(spark, [text])[text]
        assert got[i] == [float(sign) if k == at else 0.0 for k in range(64)]
    assert got[2] == [0.0] * 64
    assert [x for x in got[3] if x] == [float(known[a][1])]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_vectors_are_made_by_several_tasks(spark):
    """Also where all messages lie in one file: each task writes its own."""
    assert len(spark.read.parquet(f"{SF}/conversations.parquet").inputFiles()) == 1
    m = vectorstores._messages(spark, SF)
    assert len(m.inputFiles()) > 1
    assert m.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
