"""Window functions and sequential analytics over message tables.

Partitions are chats or smaller; a global order is used on already aggregated rows only (days, hours).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def response_times(messages: DataFrame) -> DataFrame:
    """id, chat_id, mine, minutes, hour, weekday of every reply: the sender changes and 0 < gap < one day, hour and weekday of the message replied to."""
    w = Window.partitionBy("chat_id").orderBy("date", "id")
    m = messages.select("id", "chat_id", "date", "is_from_me", F.lag("date").over(w).alias("prev"), F.lag("is_from_me").over(w).alias("prev_mine"))
    gap = F.unix_micros("date") - F.unix_micros("prev")
    m = m.where((F.col("prev_mine") != F.col("is_from_me")) & (gap > 0) & (gap < DAY * 1_000_000))
    return m.select("id", "chat_id", F.col("is_from_me").alias("mine"), (gap / 60_000_000).alias("minutes"), F.hour("prev").alias("hour"), F.weekday("prev").alias("weekday"))


def response_stats(replies: DataFrame, by: list[str | Column]) -> DataFrame:
    return replies.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("minutes"), 4).alias("avg_minutes"), F.round(F.percentile("minutes", 0.5), 4).alias("median_minutes"), F.round(F.min("minutes"), 4).alias("min_minutes"), F.round(F.max("minutes"), 4).alias("max_minutes"))


def trend_label(change: Column, limit: float) -> Column:
    return F.when(change > limit, "increasing").when(change < -limit, "decreasing").otherwise("stable")


def half_split_trend(daily: DataFrame, key: str | None = None, limit: float = 10.0) -> DataFrame:
    """Mean of the later half of days against the first n // 2: key, first_avg, second_avg, change (percent), direction; fewer than two days are stable."""
    w = Window.partitionBy(key) if key else Window.partitionBy(F.lit(1))  # days only, when there is no key
    d = daily.withColumn("rn", F.row_number().over(w.orderBy("day"))).withColumn("k", F.count("*").over(w))
    mid = F.floor(F.col("k") / 2)
    g = d.groupBy(*([key] if key else []), "k").agg(F.avg(F.when(F.col("rn") <= mid, F.col("n"))).alias("a"), F.avg(F.when(F.col("rn") > mid, F.col("n"))).alias("b"))
    change = F.when(F.col("k") < 2, 0.0).when(F.col("a") == 0, F.when(F.col("b") > 0, 100.0).otherwise(0.0)).otherwise((F.col("b") - F.col("a")) / F.col("a") * 100)
    return g.select(*([key] if key else []), F.round("a", 4).alias("first_avg"), F.round("b", 4).alias("second_avg"), F.round(change, 4).alias("change"), trend_label(change, limit).alias("direction"))


def ends_trend(daily: DataFrame, key: str, k: int = 3, least: int = 4, limit: float = 10.0) -> DataFrame:
    """Mean of the last k days against the first k: key, days, change, direction, confidence.

    Confidence is the share of steps that go the trend's way; of a stable series at least a half, less the change.
    """
    w = Window.partitionBy(key)
    o = w.orderBy("day")
    d = daily.withColumn("rn", F.row_number().over(o)).withColumn("days", F.count("*").over(w)).withColumn("step", F.col("n") - F.lag("n").over(o))
    g = d.groupBy(key, "days").agg(F.avg(F.when(F.col("rn") <= k, F.col("n"))).alias("a"), F.avg(F.when(F.col("rn") > F.col("days") - k, F.col("n"))).alias("b"), F.count_if(F.col("step") > 0).alias("up"), F.count_if(F.col("step") < 0).alias("down")).where(F.col("days") >= least)
    change = F.when(F.col("a") == 0, F.when(F.col("b") > 0, 100.0).otherwise(0.0)).otherwise((F.col("b") - F.col("a")) / F.col("a") * 100)
    direction = trend_label(change, limit)
    confidence = F.when(direction == "increasing", F.col("up") / (F.col("days") - 1)).when(direction == "decreasing", F.col("down") / (F.col("days") - 1)).otherwise(F.greatest(F.lit(0.5), 1 - F.abs(change) / 100))
    return g.select(key, "days", F.round(change, 4).alias("change"), direction.alias("direction"), F.round(confidence, 4).alias("confidence"))


def anomalies(daily: DataFrame, limit: float = 2.0, least: int = 5) -> DataFrame:
    """Days whose count is limit population standard deviations from the mean: day, n, z, kind. Constant or short series have none."""
    s = daily.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count("*").alias("k"))
    z = (F.col("n") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    # one row of statistics beside the days
    joined = daily.withColumn("one", F.lit(1)).join(F.broadcast(s.withColumn("one", F.lit(1))), "one")
    return joined.where((F.col("k") >= least) & (F.abs(z) >= limit)).select("day", "n", F.round(z, 4).alias("z"), F.when(z > 0, "spike").otherwise("drop").alias("kind"))


def weekday_pattern(daily: DataFrame, least_days: int = 28, deviation: float = 0.3) -> DataFrame:
    """weekday, mean, share of the overall mean, kind (high, low, normal) over active days; nothing for shorter histories."""
    by = daily.groupBy(F.date_format("day", "EEEE").alias("weekday")).agg(F.avg("n").alias("mean"), F.count("*").alias("days"))
    whole = by.agg(F.sum("days").alias("k"), F.avg("mean").alias("overall")).withColumn("one", F.lit(1))
    r = F.col("mean") / F.col("overall")
    out = by.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").where(F.col("k") >= least_days)
    return out.select("weekday", F.round("mean", 4).alias("mean"), F.round(r, 4).alias("share"), F.when(r > 1 + deviation, "high").when(r < 1 - deviation, "low").otherwise("normal").alias("kind"))


def compare_periods(messages: DataFrame, days: int) -> DataFrame:
    """One row: counts of the last days (start included) and of the days before, and the change in percent (100 or 0 from none)."""
    newest = messages.agg(F.max("date").alias("now"))
    m = messages.join(F.broadcast(newest), F.col("date") <= F.col("now")).where(F.col("date") >= F.col("now") - F.expr(f"INTERVAL {2 * days} DAYS"))
    cur = F.col("date") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS")
    g = m.agg(F.count_if(cur).alias("current"), F.count_if(~cur).alias("previous"))
    return g.select("current", "previous", F.round(F.when(F.col("previous") == 0, F.when(F.col("current") > 0, 100.0).otherwise(0.0)).otherwise((F.col("current") - F.col("previous")) / F.col("previous") * 100), 4).alias("change"))


def islands(messages: DataFrame, starts: Column, key: str = "chat_id", order: tuple[str, ...] = ("date", "id")) -> DataFrame:
    """messages with island, a number from 1 within key that goes up where starts holds; starts may use lag over (key, order)."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = messages.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int"))
    return flagged.withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def gap_threads(messages: DataFrame, minutes: int = 30) -> DataFrame:
    """messages with island and thread_id: a new thread begins after a gap of more than minutes. thread_id hashes chat and first message."""
    w = Window.partitionBy("chat_id").orderBy("date", "id")
    gap = F.unix_micros("date") - F.unix_micros(F.lag("date").over(w))
    m = islands(messages.withColumn("_gap", gap), F.col("_gap").isNull() | (F.col("_gap") > minutes * 60_000_000)).drop("_gap")
    first = F.first("id").over(Window.partitionBy("chat_id", "island").orderBy("date", "id"))
    return m.withColumn("thread_id", F.substring(F.sha2(F.concat_ws(":", "chat_id", first), 256), 1, 16))


THREADS = "id long, chat_id long, thread int"


def bounded_threads(messages: DataFrame, gap_minutes: int = 30, longest_minutes: int = 240) -> DataFrame:
    """id, chat_id, thread: as gap_threads, but a thread also ends when it would last longer than longest_minutes.

    The reset depends on where the thread began, so each chat is read in order, as it comes from Spark's sort, by a scan that holds
    the thread's begin and the row before: no group is gathered, neither a chat nor a thread.
    """
    gap, longest = gap_minutes * 60_000_000, longest_minutes * 60_000_000

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = before = began = None
        thread = 0
        for batch in batches:
            out = []
            for c, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not thread or c != chat:
                    chat, began, thread = c, t, 1
                elif t is None or before is None or t - before > gap or t - began > longest:
                    began, thread = t, thread + 1
                before = t
                out.append(thread)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["id", "chat_id", "thread"])

    m = messages.select("id", "chat_id", F.unix_micros("date").alias("t"))
    return m.repartition("chat_id").sortWithinPartitions("chat_id", "t", "id").mapInArrow(scan, THREADS)


def turns(messages: DataFrame) -> DataFrame:
    """chat_id, turn, sender, n, text of runs of one sender, texts joined by line ends; system messages end a run and are left out."""
    w = Window.partitionBy("chat_id").orderBy("date", "id")
    prev = F.lag("sender").over(w)
    m = islands(messages.withColumn("_new", prev.isNull() | (prev != F.col("sender"))), F.col("_new")).where("NOT is_system")
    g = m.groupBy("chat_id", "island", "sender").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    return g.select("chat_id", F.row_number().over(Window.partitionBy("chat_id").orderBy("island")).alias("turn"), "sender", "n", "text")


def since_watermark(messages: DataFrame, marks: DataFrame, context: int = 5) -> DataFrame:
    """Messages after each chat's mark (chat_id, end_time), and the context last ones before it, with fresh telling which."""
    m = messages.join(marks, "chat_id", "left").withColumn("fresh", F.col("end_time").isNull() | (F.col("date") > F.col("end_time")))
    w = Window.partitionBy("chat_id", "fresh").orderBy(F.desc("date"), F.desc("id"))
    return m.withColumn("rn", F.row_number().over(w)).where(F.col("fresh") | (F.col("rn") <= context)).drop("rn", "end_time")


def threshold_for_rate(buckets: DataFrame, target: float, least: int) -> DataFrame:
    """The lowest bucket such that it and all above it with enough samples reach the target rate: bucket, n. Buckets are few rows."""
    b = buckets.where(F.col("n") >= least).withColumn("ok", (F.col("rate") >= target).cast("int"))
    run = F.min("ok").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("run", run).where("run = 1").agg(F.min("bucket").alias("bucket"), F.count("*").alias("n"))


def evolution(messages: DataFrame, step_days: int, most: int) -> DataFrame:
    """Cumulative snapshots every step_days from the first day: cutoff, chats, messages, most of them at most.

    Counts are made a day first, so the cumulative sums run over days.
    """
    first_seen = messages.groupBy("chat_id").agg(F.min(F.to_date("date")).alias("day")).groupBy("day").agg(F.count("*").alias("new_chats"))
    daily = messages.groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("n")).join(first_seen, "day", "left")
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    cuts = span.select(F.explode(F.slice(F.sequence("lo", "hi", F.expr(f"INTERVAL {step_days} DAYS")), 1, most)).alias("cutoff"))
    return cuts.join(daily, F.col("day") <= F.col("cutoff")).groupBy("cutoff").agg(F.sum(F.coalesce("new_chats", F.lit(0))).alias("chats"), F.sum("n").alias("messages"))
