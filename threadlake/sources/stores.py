"""Typed stores: the tables that a conversation product keeps besides its messages.

Each is a schema by name; read() gives a store from Parquet or JSON lines in these types, missing columns as nulls, and write()
lays one down. Fields that a store does not know are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.sources.tables import with_columns


#: Time stamps in JSON keep their microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


#: Stores by name.
STORES: dict[str, str] = {
    "contacts": "id long, chat_id string, display_name string, phone_or_email string, relationship string, style_notes string, handles array<string>, created_at timestamp, updated_at timestamp",
    "facts": "id long, contact_id string, category string, subject string, predicate string, value string, confidence double, attribution string, source_message_id long, source_text string, valid_from timestamp, valid_until timestamp, extracted_at timestamp",
    "segments": "segment_id string, chat_id string, contact_id string, start_time timestamp, end_time timestamp, topic_label string, summary string, keywords array<string>, message_count int, confidence double, created_at timestamp",
    "segment_messages": "segment_id string, message_id long, position int, is_from_me boolean",
    "drafts": "id long, chat_id string, incoming_text string, draft_text string, final_text string, status string, confidence double, created_at timestamp, sent_at timestamp",
    "reply_logs": "id long, chat_id string, contact_id string, incoming_text string, pressure string, final_reply string, confidence double, metadata map<string,string>, created_at timestamp",
    "feedback": "id long, message_id long, suggestion_id string, action string, suggestion_text string, edited_text string, chat_id string, contact_id string, metadata map<string,string>, timestamp timestamp",
    "routing_metrics": "id long, timestamp timestamp, query_hash string, latency_ms map<string,double>, similarity_score double, routing_decision string, faiss_candidates int, model_loaded boolean, generation_time_ms double, tokens_per_second double",
    "tasks": "id string, task_type string, status string, params map<string,string>, progress double, error string, created_at timestamp, started_at timestamp, completed_at timestamp, retries int",
    "experiments": "name string, enabled boolean, description string, variants array<struct<id:string,weight:int,config:map<string,string>>>, created_at timestamp",
    "outcomes": "experiment string, variant string, contact_id string, action string, timestamp timestamp",
}


def schema(name: str) -> T.StructType:
    return _schema(STORES[name])


def typed(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of the store: missing ones null, others left out. Values that do not fit are null."""
    own = schema(name)
    have = with_columns(df, own)
    return have.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.AtomicType) else F.col(f.name).cast(f.dataType).alias(f.name) for f in own.fields])


def read(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """The store at path, from Parquet (older files may lack columns) or JSON lines."""
    if form == "json":
        return spark.read.schema(schema(name)).options(**_TIMES).json(path)
    return typed(spark.read.option("mergeSchema", "true").parquet(path), name)


def write(df: DataFrame, path: str, name: str, form: str = "parquet") -> None:
    """Lay df down as the store, replacing what is at path."""
    out = typed(df, name).write.mode("overwrite")
    out.options(**_TIMES).json(path) if form == "json" else out.parquet(path)
