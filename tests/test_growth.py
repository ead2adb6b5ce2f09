"""What grows with the tables: rows are dealt over the cores, values worked out once, batches held one at a time, words added up before they are shuffled."""

import re
import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlake.functions import relationships as rel
from threadlake.operators import adaptive, text
from threadlake.plans import knowledge, registry, stores
from threadlake.sources.spoken import spoken_messages

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [lambda s: knowledge.sentences(s, SF), lambda s: stores._said(s, SF, ["a"]), lambda s: spoken_messages(s, SF, even=True)])
def test_a_small_file_is_dealt(spark, make):
    df = make(spark)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.groupBy(F.spark_partition_id()).count().count() > 1


def test_replies_meet_their_chat_without_a_join_on_ids(spark):
    plan = registry.QUERIES["scl20_reply_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join ", plan)) == 1


def test_quick_patterns_match_the_same(spark):
    said = ["my mom, Dad's kids; love you", "kidsmom son", "pr review eod❤️😘 baby babe", "can't wait to see you", "", "good morning good night xoxo", "let's catch up long time", "daughter son dinner at home"]
    rows = spark.createDataFrame([(s,) for s in said], "t string")
    for kw, anti, _ in rel.CATEGORIES.values():
        for words in (kw, anti):
            found = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (rel.pattern(words), rel._quick(words))]
            assert rows.where(found[0] != found[1]).count() == 0


def test_batches_are_held_one_at_a_time():
    seen = []

    def batches():
        for k in range(4):
            df = pd.DataFrame({"period": [k // 2, 5 - k], "bucket": [k, 19], "good": [1, 0]})
            seen.append(weakref.ref(df))
            yield df
            del df
            assert seen[-1]() is None

    out = adaptive.counted(batches(), 20)
    assert {p: (n.sum(), g.sum()) for p, (n, g) in out.items()} == {0: (2, 2), 5: (1, 0), 4: (1, 0), 1: (2, 2), 3: (1, 0), 2: (1, 0)}
    assert out[0][0][:2].tolist() == [1, 1] and np.all(out[5][0][:19] == 0)


def test_words_of_one_document_are_not_shuffled(spark):
    rows = [(1, "en", "tea tea milk"), (2, "en", "tea rice"), (3, "de", "tee milk"), (4, None, "tea")]
    own = text.tfidf_keywords(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "lang", "doc_id", 5)
    assert not re.search(r"hashpartitioning\([^)]*doc_id", own._jdf.queryExecution().executedPlan().toString())
    want = {("en", "tea"): round(3 / 2 * np.log(4 / 3), 6), ("en", "milk"): round(1 / 2 * np.log(2), 6), ("en", "rice"): round(1 / 2 * np.log(4), 6), ("de", "tee"): round(np.log(4), 6), ("de", "milk"): round(np.log(2), 6)}
    assert {(r["lang"], r["word"]): r["weight"] for r in own.collect()} == want
    # rows of one key are one document, as count(DISTINCT doc_id) has it
    again = text.tfidf_keywords(spark.createDataFrame([*rows, (2, "en", "tea rice")], "doc_id long, lang string, text string"), "lang", "doc_id", 5)
    assert {(r["lang"], r["word"]): r["weight"] for r in again.collect()}["en", "tea"] == round(4 / 3 * np.log(5 / 3), 6)
