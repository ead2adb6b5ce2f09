"""What to prepare next: contacts by hour of day and running conversations, from tables that grow batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.streaming.messages import drain, put


def hour_weights(messages: DataFrame, half_life_days: float | None = None, anchor: str = "2024-01-01") -> DataFrame:
    """chat_id, hour, weight: received messages by hour of day. With a half-life a message weighs twice as much as one that is so much older.

    Weights are relative to the anchor, so tables of separate messages add up; decayed() gives them as of a day. Rows without date or direction are left out.
    """
    age = (F.unix_micros("date") - F.unix_micros(F.lit(anchor).cast("timestamp"))) / 86_400_000_000.0
    w = F.lit(1.0) if half_life_days is None else F.pow(F.lit(2.0), age / half_life_days)
    return messages.where("date IS NOT NULL AND NOT is_from_me").groupBy("chat_id", F.hour("date").alias("hour")).agg(F.sum(w).alias("weight"))


def decayed(hours: DataFrame, now: str, half_life_days: float | None = None, anchor: str = "2024-01-01") -> DataFrame:
    """hours with weights as of now."""
    if half_life_days is None:
        return hours
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.lit(anchor).cast("timestamp"))) / 86_400_000_000.0
    return hours.withColumn("weight", F.col("weight") * F.pow(F.lit(2.0), -age / half_life_days))


def time_of_day(hours: DataFrame, top: int = 3, least: float = 2.0) -> DataFrame:
    """hour, chat_id, score, confidence: for each hour of the day the top chats by weight in it and half of that in the hours beside it, of at least the least score."""
    near = F.array(*[F.struct(F.pmod(F.col("hour") + d, F.lit(24)).cast("int").alias("at"), F.lit(w).alias("share")) for d, w in ((0, 1.0), (1, 0.5), (-1, 0.5))])
    sums = hours.select("chat_id", "weight", F.explode(near).alias("n")).groupBy(F.col("n.at").alias("hour"), "chat_id").agg(F.round(F.sum(F.col("weight") * F.col("n.share")), 6).alias("score"))
    r = F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("score"), "chat_id"))
    best = sums.withColumn("r", r).where((F.col("r") <= top) & (F.col("score") >= least))
    return best.select("hour", "chat_id", "score", F.round(F.least(F.col("score") / 20, F.lit(0.9)), 6).alias("confidence"))


def _continuation(n: Column, since: Column, window: int) -> Column:
    return (1 - since / window) * 0.7 + F.least(n / 10, F.lit(1.0)) * 0.3


def continuation(messages: DataFrame, step: int = 3600, window: int = 1800, threshold: float = 0.3) -> DataFrame:
    """at, chat_id, n, confidence, priority: at every step of so many seconds, the chats with messages in the window before it, if confident enough.

    Confidence is 0.7 of how recent the last message is and 0.3 of how many there are, ten at most; priority is high within five minutes, medium
    within fifteen. A message is sent to the steps that see it, window / step + 1 at most.
    """
    s = F.unix_micros("date") / 1_000_000.0
    first = F.ceil(s / step) * step
    seen = messages.where("date IS NOT NULL").select("chat_id", s.alias("s"), F.explode(F.sequence(first, F.greatest(first, (F.floor((s + window) / step) * step)), F.lit(step).cast("long"))).alias("at")).where(F.col("at") - F.col("s") < window)
    g = seen.groupBy("at", "chat_id").agg(F.count("*").alias("n"), (F.first("at") - F.max("s")).alias("since"))
    c = g.withColumn("confidence", F.round(_continuation(F.col("n"), F.col("since"), window), 6)).where(F.col("confidence") >= threshold)
    priority = F.when(F.col("since") < 300, "high").when(F.col("since") < 900, "medium").otherwise("low")
    return c.select(F.timestamp_seconds("at").alias("at"), "chat_id", "n", "confidence", priority.alias("priority"))


def follow(stream: DataFrame, base: str, half_life_days: float | None = None, window: int = 1800) -> None:
    """Keep hour weights (base/hours) and the messages of the last window of each chat (base/recent) as of every batch of a stream.

    A batch adds its own sums to what the batch before left, a row a chat and hour; a batch that is tried again replaces what it wrote.
    """

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        new = hour_weights(df, half_life_days)
        recent = df.where("date IS NOT NULL").select("chat_id", "id", "date")
        if batch:
            held = spark.read.schema(new.schema).parquet(f"{base}/hours/batch={batch - 1}")
            new = held.unionByName(new).groupBy("chat_id", "hour").agg(F.sum("weight").alias("weight"))
            recent = spark.read.schema(recent.schema).parquet(f"{base}/recent/batch={batch - 1}").unionByName(recent)
        put(new, f"{base}/hours", batch)
        last = F.max("date").over(Window.partitionBy("chat_id"))
        put(recent.withColumn("last", last).where(F.unix_micros("last") - F.unix_micros("date") < window * 1_000_000).drop("last"), f"{base}/recent", batch)

    drain(stream, "append", each, base)


def latest(spark, base: str, name: str, schema: str) -> DataFrame:
    """The table base/name as of the last batch; empty before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName().split("=")[1]) for f in (fs.listStatus(path) if fs.exists(path) else []) if "=" in f.getPath().getName()]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/{name}/batch={max(done)}")
