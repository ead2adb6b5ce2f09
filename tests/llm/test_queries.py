"""The opN queries against their SQL, and the pipeline against a plain version of its stages."""

import duckdb
import pytest

import corpus_pipeline
from threadlake.llm import queries
from tests.llm.test_operators import brute_components, tik

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda df: sorted(tuple(str(v) if not isinstance(v, float) else f"{v:.6g}" for v in r) for r in df[cols].fillna("null").itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        kept[name] = ({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in after.collect()})
        docs = after
    before, after = kept["near_copies"]
    parts = brute_components(before, 5, 80, 100)
    assert set(after) == {i for i, (_, c) in parts.items() if c == i}
    before, after = kept["personal_data"]
    assert set(before) == set(after)
    import public_tokenizers as pt

    from threadlake.llm import bpe

    enc = tik(bpe.read_ranks(pt.path("byte_bpe_50k.tiktoken")))
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert out == {i: enc.encode_ordinary(t) for i, t in after.items()}


def test_pipeline_of_no_rows(spark):
    docs = spark.createDataFrame(spark.read.parquet(f"{SF}/documents.parquet").limit(0).collect(), spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_labels_outside_the_fold_are_used_and_those_inside_are_not(spark, tmp_path):
    """Labels of the held-out fold change no score; those of the others do."""
    import zlib

    from threadlake.llm import toxicity

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = [r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]

    def scores(own):
        return {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, toxicity.fit(docs, own)).collect()}

    want = scores(labels)
    other = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({', '.join(map(str, held))}) THEN 1 - toxic ELSE toxic END AS toxic")
    assert scores(other) == want
    assert scores(labels.selectExpr("doc_id", "1 - toxic AS toxic")) != want
