"""Documents to token ids: toxic texts and near copies go, benchmark copies go, personal data are masked, the rest is encoded.

Each stage takes all rows that the one before kept, as Parquet read again. All but the last return the columns of
documents. Rows that share a doc_id share its fate; rows with a null doc_id are kept by the stages that compare
documents by id (near copies, benchmark copies) and judged by their text by the others. Null texts are
clean (the first stage never judges them), unlike anything, and encode to no ids. Empty tables pass through. Each stage begins
with executors whose heaps the stage before has left small (session.settle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import bpe, decontam, jaccard, pii, toxicity
from threadlake.session import settle, stored

#: Text of a block in the last stage: smaller than alone, as executors still hold what earlier stages needed.
BLOCK_BYTES = 12 << 20
#: Up to so many ids are sent to every task to leave rows out; beyond, both sides are shuffled.
MOST_SENT = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids."""
    ids = stored(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "left-out")
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join, the smallest doc_id stays."""
    settle(spark)
    groups = jaccard.jaccard_components(docs, k=5, num=80, den=100)
    return without(docs, groups.where("doc_id <> component_id"))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return without(docs, decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return pii.redact(docs, pii.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the bytes that they decode to."""
    import public_tokenizers

    settle(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encoded_digests(docs, ranks, public_tokenizers.PATTERN, keep_ids=True, block_bytes=BLOCK_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("personal_data", mask_personal_data),
    ("encode", encode),
]

#: The trained stages and the encoding cannot be told in SQL; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
