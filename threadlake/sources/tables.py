"""Tables and their views as messages.

A message table has id, chat_id, date, is_from_me and what else its source gives (text, sender, category, value).
The adapters are projections only, so filters and column choices reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of a full message table; missing columns are added as nulls (see with_columns).
MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("chat_id", T.LongType()),
        T.StructField("sender", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("is_from_me", T.BooleanType()),
        T.StructField("reply_to_id", T.LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: a user is a chat; clicks and purchases count as sent."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("chat_id"), F.col("ts").cast("timestamp").alias("date"), F.col("event_type").isin("click", "purchase").alias("is_from_me"), "event_type", "value", "props")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: the user's turns count as sent; a conversation begins at its own hour and has a turn every seven minutes."""
    c = table(spark, sf_dir, "conversations")
    date = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 420)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), date.alias("date"), (F.col("role") == "user").alias("is_from_me"), (F.col("role") == "system").alias("is_system"), F.col("role").alias("sender"), "text")


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema that it lacks added as nulls: older exports have fewer columns."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def schema_version(df: DataFrame) -> str:
    """Which export a source table comes from, told by its columns: v15 has service_name, v14 has not; else unknown."""
    names = set(df.columns)
    if {"id", "chat_id", "date"} <= names:
        return "v15" if "service_name" in names else "v14"
    return "unknown"


#: The same adapters for DuckDB.
EV = "(SELECT event_id AS id, user_id AS chat_id, ts AS date, event_type IN ('click', 'purchase') AS is_from_me, event_type, value, props FROM events)"
CV = "(SELECT conv_id * 1000 + turn AS id, conv_id AS chat_id, make_timestamp((1704067200 + conv_id * 3600 + turn * 420) * 1000000) AS date, role = 'user' AS is_from_me, role = 'system' AS is_system, role AS sender, text FROM conversations)"
