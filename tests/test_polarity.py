"""Boosted polarity: its steps are worked out once a text; its query gives the SQL's rows, to the last place."""

import duckdb

from threadlake.functions import text as tx
from threadlake.plans import registry

registry.load()


def test_weights_and_one_split(spark):
    texts = ["Good very bad", "very very good bad", "very", "", None, "bad bad very good", " good\tvery\nGOOD "]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", tx.boosted_polarity("text", ["good"], ["bad"], ["very"]).alias("p"))
    got = {r["id"]: r["p"] for r in d.collect()}
    want = [(1 - 1.5) / 2.5, (1.5 - 1) / 2.5, 0.0, 0.0, 0.0, (1.5 - 2) / 3.5, 1.0]
    assert [round(got[i], 9) for i in range(len(texts))] == [round(x, 9) for x in want]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_query_like_sql(spark, tmp_path):
    # two sums whose quotients end in a 5 at the seventh place; no words; repeated and null keys; a vertical tab; a dotted capital I
    ties = ["and the" + " the" * p + " and that" + " that" * n for p, n in ((152, 485), (480, 157))]
    texts = [*enumerate([*ties, None, "", " \t\n", "x y", "the\vthe with", "the that", "the and\vthat was", "W\u0130TH was was", "\u00a0the the", "with"])]
    texts += [(7, "and the"), (7, None), (11, ""), (20, ""), (20, None), (None, "the was was"), (None, "the")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.QUERIES["scl08_polarity"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got, want = {r["doc_id"]: r["polarity"] for r in df.collect()}, dict(duck.sql(registry.ORACLE["scl08_polarity"]).fetchall())
    assert df.count() == len(got) and got == want
