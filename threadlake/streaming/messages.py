"""Message streams: sources, windows and state with Structured Streaming.

The studied watcher follows row numbers, without event time. Windows, watermarks and late rows here are additions:
rows later than the watermark are dropped by windowed aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadlake.session import shared_dir


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """events files as a stream of messages; the checkpoint holds the offset that the row-number tail had.

    Without files_per_batch all files that a run finds are one batch. Files that one write has left are in no order of time: where a
    watermark follows them, the first file's newest row would make the others' rows late.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    s = reader.parquet(path if path.endswith("*") else f"{path}*")
    return s.select(F.col("event_id").alias("id"), F.col("user_id").alias("chat_id"), F.col("ts").cast("timestamp").alias("date"), F.col("event_type").isin("click", "purchase").alias("is_from_me"), "event_type", "value")


def tumbling(messages: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = messages.withWatermark("date", late).groupBy(F.window("date", width)).agg(F.count("*").alias("n"), F.count_if("is_from_me").alias("sent"))
    return w.select(F.col("window.start").alias("start"), "n", "sent")


def sliding(messages: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = messages.withWatermark("date", late).groupBy(F.window("date", width, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = messages.withWatermark("date", late).groupBy(F.session_window("date", gap), "chat_id").agg(F.count("*").alias("n"))
    return w.select("chat_id", F.col("session_window.start").alias("start"), "n")


def resegment_signals(messages: DataFrame, every: int = 15) -> DataFrame:
    """chat_id, n: a row whenever a chat has had every messages more since its last row; the rest waits in state."""

    def count(key: tuple, batches: Iterator[Any], state: GroupState) -> Iterator[Any]:
        import pandas as pd

        held = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        full = held // every
        state.update((held - full * every,))
        if full:
            yield pd.DataFrame({"chat_id": [key[0]], "n": [full * every]})

    return messages.select("chat_id", "id").groupBy("chat_id").applyInPandasWithState(count, "chat_id long, n long", "held int", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None, base: str | None = None) -> DataFrame | None:
    """Run a stream over all that is there, into a Parquet table of the shared folder, and return that table.

    Aggregates in mode complete or update keep their last batch's rows. With each, batches go to that function instead. A stream that
    is run again with the same base goes on after the rows that it has had.
    """
    import uuid

    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    out = f"{base}/table"
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def put(df: DataFrame, path: str, batch: int) -> None:
    """Write a micro-batch into its own folder of the table at path: a batch that is tried again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]]) -> None:
    """Give every micro-batch to each sink, read once from the source; a failed batch is given to all again."""

    def each(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for sink in sinks:
                sink(df, batch)
        finally:
            df.unpersist()

    drain(stream, "append", each)


def resegment(stream: DataFrame, base: str, minutes: int = 30, context: int = 5) -> None:
    """Cut every batch's messages into threads, each chat's last context messages before them in view; rows go to base/threads.

    A row's thread_id is that of the first message in view of its thread. base/context keeps each chat's last context messages
    as of every batch, so a batch reads as many rows as there are chats, not their history; a batch that is tried again reads
    what the batch before left and replaces what it wrote. Chats are keys of the shuffle, so no two tasks cut the same chat.
    """
    from pyspark.sql import Window

    from threadlake.operators.sequences import gap_threads

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        new = df.select("id", "chat_id", "date")
        seen = new.withColumn("fresh", F.lit(True))
        if batch:
            before = spark.read.schema(new.schema).parquet(f"{base}/context/batch={batch - 1}")
            seen = seen.unionByName(before.withColumn("fresh", F.lit(False)))
        view = seen if not batch else seen.join(new.select("chat_id").distinct(), "chat_id", "left_semi")
        put(gap_threads(view, minutes).where("fresh").select("id", "chat_id", "thread_id"), f"{base}/threads", batch)
        last = Window.partitionBy("chat_id").orderBy(F.desc("date"), F.desc("id"))
        put(seen.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= context).select("id", "chat_id", "date"), f"{base}/context", batch)

    drain(stream, "append", each)
