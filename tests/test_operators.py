"""Small hand-built cases: ties, nulls, empty tables, borders."""

import datetime as dt

from pyspark.sql import functions as F

from threadlake.functions import text as tx
from threadlake.operators import aggregates as agg
from threadlake.operators import graph, sequences, vectors
from threadlake.operators import messages as ops
from threadlake.sources.tables import MESSAGE, with_columns

M = "id long, chat_id long, date timestamp, is_from_me boolean, sender string, text string, is_system boolean, value double"


def at(minutes, base=dt.datetime(2024, 1, 15, 10, 0)):
    return base + dt.timedelta(minutes=minutes)


def messages(spark, rows):
    return spark.createDataFrame([(i, c, d, mine, "me" if mine else "x", t, False, 1.0) for i, c, d, mine, t in rows], M)


def test_thirty_minutes_do_not_split_a_second_more_does(spark):
    m = messages(spark, [(1, 1, at(0), True, "a"), (2, 1, at(30), False, "b"), (3, 1, at(60) + dt.timedelta(seconds=1), True, "c")])
    assert [r["island"] for r in sequences.gap_threads(m).orderBy("id").collect()] == [1, 1, 2]


def test_bounded_threads_end_by_length(spark):
    m = messages(spark, [(i, 1, at(20 * i), True, "") for i in range(10)])
    got = sequences.bounded_threads(m, 30, 60).groupBy("thread").count().orderBy("thread").collect()
    assert [r["count"] for r in got] == [4, 4, 2]


def test_response_borders(spark):
    m = messages(spark, [(1, 1, at(0), True, ""), (2, 1, at(0), False, ""), (3, 1, at(5), True, ""), (4, 1, at(5 + 1440), False, "")])
    got = sequences.response_times(m).collect()
    assert [(r["id"], r["minutes"]) for r in got] == [(3, 5.0)]


def test_anomalies_of_constant_and_short_series(spark):
    day = dt.date(2024, 1, 1)
    flat = spark.createDataFrame([(day + dt.timedelta(i), 5) for i in range(10)], "day date, n long")
    assert sequences.anomalies(flat).count() == 0
    assert sequences.anomalies(flat.limit(3)).count() == 0


def test_week_00(spark):
    d = spark.createDataFrame([(dt.datetime(2023, 1, 1),), (dt.datetime(2024, 1, 1),), (dt.datetime(2023, 1, 2),)], "date timestamp")
    assert [r[0] for r in d.select(agg.week_key("date")).collect()] == ["2023-W00", "2024-W01", "2023-W01"]


def test_empty_input(spark):
    m = messages(spark, []).limit(0)
    assert agg.by_hour(m).count() == 24
    assert agg.contact_table(m).count() == 0
    assert sequences.response_times(m).count() == 0
    assert ops.latest_per_chat(m).count() == 0


def test_search_is_literal(spark):
    m = messages(spark, [(1, 1, at(0), True, "100% sure"), (2, 1, at(1), True, "100 sure"), (3, 1, at(2), True, None), (4, 1, at(3), True, "a_b\\c")])
    assert [r["id"] for r in ops.search(m, "100%").collect()] == [1]
    assert [r["id"] for r in ops.search(m, "A_B\\").collect()] == [4]


def test_phone_forms(spark):
    d = spark.createDataFrame([(" (555) 123-4567",), ("1 555 123 4567",), ("+44 20 1",), ("A@B.C",), (None,), ("",)], "v string")
    assert [r[0] for r in d.select(ops.normal_phone("v")).collect()] == ["+15551234567", "+15551234567", "+44201", "a@b.c", None, None]


def test_sentiment(spark):
    d = spark.createDataFrame([("I love this 😀",), ("can't stop, hate it",), ("",), (None,), ("nothing here",)], "text string")
    got = [r[0] for r in d.select(tx.sentiment_score(tx.sentiment_parts("text"))).collect()]
    assert got == [0.6, -0.565, 0.0, 0.0, 0.0]


def test_csv_guard(spark):
    d = spark.createDataFrame([("=1+1",), ("a\nb",), (None,)], "text string")
    assert [r[0] for r in d.select(tx.csv_safe("text")).collect()] == ["'=1+1", "a\\nb", ""]


def test_missing_columns(spark):
    assert with_columns(spark.range(1), MESSAGE).schema["date"].dataType.simpleString() == "timestamp"


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-0.5, 0.5])], "vec_id long, embedding array<float>")
    assert v.select(vectors.quantise("embedding")).collect()[2][0] == [-63, 63]
    near = vectors.nearest(v, [1.0, 0.0], 3).collect()
    assert (near[0]["vec_id"], near[0]["similarity"]) == (0, 1.0)


def test_variant_bucket(spark):
    import hashlib

    d = spark.createDataFrame([(f"k{i}",) for i in range(20)], "k string")
    got = {r[0]: r[1] for r in d.select("k", tx.variant_bucket(F.col("k"))).collect()}
    assert got == {k: int(hashlib.sha256(k.encode()).hexdigest(), 16) % 100 for k in got}


def test_ego_graph_depth(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a long, b long")
    assert {r["node"]: r["hops"] for r in graph.ego_graph(e, 1, 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_rules_fold(spark):
    d = spark.createDataFrame([(1, "ab"), (2, "b")], "x int, t string")
    assert d.where(ops.rules([("x", "greater_than", 1), ("t", "contains", "A")], "any")).count() == 2
    assert d.where(ops.rules([])).count() == 2


def test_normalised(spark):
    rows = [("  a\u200b  b\n\nSent from my phone",), ("Loved \u201chi\u201d",), ("\U0001f600\U0001f600\U0001f600\U0001f600 ok",), (None,), ("Removed a heart from \u201cx",)]
    d = spark.createDataFrame(rows, "text string").select(tx.normalised("text").alias("text"))
    once = [r[0] for r in d.collect()]
    assert once == ["a b", "", "\U0001f600\U0001f600 ok", "", ""]
    assert [r[0] for r in d.select(tx.normalised("text")).collect()] == once


def test_resegment_sees_the_rows_before(spark, tmp_path):
    from threadlake.streaming import messages as st

    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([[(1, 1, at(0)), (2, 1, at(20))], [(3, 1, at(40)), (4, 1, at(120))]]):
        spark.createDataFrame(rows, "id long, chat_id long, date timestamp").coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    both = spark.readStream.schema("id long, chat_id long, date timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    st.resegment(both, base)
    got = {r["id"]: (r["batch"], r["thread_id"]) for r in spark.read.parquet(f"{base}/threads").collect()}
    assert set(got) == {1, 2, 3, 4} and got[3][0] != got[1][0]
    assert got[1][1] == got[2][1] == got[3][1] != got[4][1]


def test_best_templates(spark):
    """Threshold, bounds of groups, the boost of group templates, ties, zero vectors, unknown sizes."""
    from threadlake.operators import vectors

    t = spark.createDataFrame([(1, [1.0, 0.0], False, None, None), (2, [0.995, 0.1], True, None, None), (3, [0.0, 1.0], False, 2, 4), (4, [0.0, 2.0], False, 2, 4)], "template long, embedding array<double>, is_group boolean, least int, most int")
    rows = [(1, [2.0, 0.0], None), (2, [2.0, 0.0], 2), (3, [1.0, 0.05], 3), (4, [0.0, 5.0], 4), (5, [0.0, 5.0], 5), (6, [0.0, 0.0], 3), (7, [-1.0, 0.0], None), (8, [0.0, 5.0], None)]
    got = {r["vec_id"]: (r["template"], r["similarity"]) for r in vectors.best_templates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, group_size int"), t).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (2, 0.99874), 4: (3, 1.0), 5: (None, None), 6: (None, None), 7: (None, None), 8: (3, 1.0)}
