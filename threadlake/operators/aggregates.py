"""Grouped aggregates over message tables. Each groups once, so that partial sums are made before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_key(date: str | Column) -> Column:
    """Year and Monday-first week number from 00, as strftime %Y-W%W has it."""
    week = F.floor((F.dayofyear(date) - 1 + 7 - F.weekday(date)) / 7).cast("int")
    return F.concat(F.date_format(date, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def by_hour(messages: DataFrame) -> DataFrame:
    """hour, n, sent, avg_value for all 24 hours; hours without messages have zeros."""
    found = messages.groupBy(F.hour("date").alias("hour")).agg(F.count("*").alias("n"), F.count_if("is_from_me").alias("sent"), F.avg("value").alias("avg_value"))
    hours = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(found, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sent", F.lit(0)).alias("sent"), F.round(F.coalesce("avg_value", F.lit(0.0)), 4).alias("avg_value"))


def by_period(messages: DataFrame, period: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """period, total, sent, received, contacts (distinct chats of received messages), active_days, first and last day."""
    day = F.to_date("date")
    agg = [
        F.count("*").alias("total"),
        F.count_if("is_from_me").alias("sent"),
        F.count_if(~F.col("is_from_me")).alias("received"),
        F.countDistinct(F.when(~F.col("is_from_me"), F.col("chat_id"))).alias("contacts"),
        F.countDistinct(day).alias("active_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    ]
    return messages.groupBy(period.alias("period")).agg(*agg, *[c.alias(n) for n, c in (extra or {}).items()])


def rollup_days(daily: DataFrame, period: Column) -> DataFrame:
    """Re-aggregate a daily table (day, n, sent) by a coarser period of its day: additive measures only."""
    return daily.groupBy(period.alias("period")).agg(F.sum("n").alias("n"), F.sum("sent").alias("sent"), F.count("*").alias("days"))


def activity_levels(messages: DataFrame) -> DataFrame:
    """day, n, level: 0 none, 1 to 5, 2 to 15, 3 to 30, 4 above."""
    n = F.col("n")
    return messages.groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("n")).withColumn("level", F.when(n == 0, 0).when(n <= 5, 1).when(n <= 15, 2).when(n <= 30, 3).otherwise(4))


def engagement(sent: Column, received: Column, days: Column) -> Column:
    """0.6 * balance + 0.4 * frequency, both out of 100: balance is the smaller side over the larger, frequency ten times messages per active day."""
    balance = F.least(sent, received) / F.greatest(sent, received, F.lit(1)) * 100
    return 0.6 * balance + 0.4 * F.least((sent + received) / F.greatest(days, F.lit(1)) * 10, F.lit(100.0))


def contact_table(messages: DataFrame) -> DataFrame:
    """One row a chat: counts, active days, first and last date, engagement."""
    g = messages.groupBy("chat_id").agg(F.count("*").alias("total"), F.count_if("is_from_me").alias("sent"), F.count_if(~F.col("is_from_me")).alias("received"), F.countDistinct(F.to_date("date")).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return g.withColumn("engagement", F.round(engagement(F.col("sent"), F.col("received"), F.col("days")), 4))


def length_stats(messages: DataFrame, by: list[str]) -> DataFrame:
    """avg, median, min, max of text length and counts of four buckets; null and empty texts are left out."""
    n = F.length("text")
    m = messages.where("text IS NOT NULL AND text <> ''").withColumn("len", n)
    b = F.col("len")
    return m.groupBy(*by).agg(F.round(F.avg(b), 4).alias("avg_len"), F.percentile(b, 0.5).alias("median_len"), F.min(b).alias("min_len"), F.max(b).alias("max_len"), F.count_if(b <= 20).alias("short"), F.count_if((b > 20) & (b <= 100)).alias("medium"), F.count_if((b > 100) & (b <= 300)).alias("long"), F.count_if(b > 300).alias("very_long"))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """One row: cumulative counts c0.. of values up to each bound, n and sum."""
    return df.agg(*[F.count_if(F.col(value) <= b).alias(f"c{i}") for i, b in enumerate(bounds)], F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"))


def rank_percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """The value at place int(n * share), from 0, of each group in order: no interpolation. Ranks need one sort of each group."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("rn") == F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col(value))).alias(name) for name, s in shares.items()]
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), *picks)


def action_counts(actions: DataFrame, by: list[str], actions_of: tuple[str, ...] = ("accepted", "rejected", "edited")) -> DataFrame:
    """Counts by action and the acceptance rate: accepted and edited of all."""
    g = actions.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in actions_of])
    return g.withColumn("acceptance", F.round((F.col("accepted") + F.col("edited")) / F.col("total"), 4))


def bucket_rates(df: DataFrame, score: str, width: float) -> DataFrame:
    """Counts and acceptance by score bucket of the given width."""
    return df.groupBy(F.floor(F.col(score) / width).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean_score"), F.count_if(F.col("action") != "rejected").alias("accepted")).withColumn("rate", F.round(F.col("accepted") / F.col("n"), 4))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, F1."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    # each pair counts for its truth and its prediction: two small rows a pair, then one group
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    g = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hit").alias("hit"))
    p = F.coalesce(F.col("hit") / F.nullif(F.col("named"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("hit") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return g.select("label", "support", "named", "hit", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, expected, kappa of two binary ratings."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    g = df.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select("n", F.round("po", 6).alias("agreement"), F.round(pe, 6).alias("expected"), F.round((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def mined_replies(pairs: DataFrame, least: int, least_chats: int, share: float, top: int) -> DataFrame:
    """Incoming texts that recur in several chats and have one reply most of the time: incoming, n, chats, reply, share."""
    each = pairs.groupBy("incoming", "reply").agg(F.count("*").alias("k"))
    best = each.groupBy("incoming").agg(F.max_by("reply", F.struct("k", "reply")).alias("reply"), F.max("k").alias("k"))
    g = pairs.groupBy("incoming").agg(F.count("*").alias("n"), F.countDistinct("chat_id").alias("chats")).where((F.col("n") >= least) & (F.col("chats") >= least_chats))
    return g.join(best, "incoming").withColumn("share", F.round(F.col("k") / F.col("n"), 4)).where(F.col("share") >= share).select("incoming", "n", "chats", "reply", "share").orderBy(F.desc("n"), "incoming").limit(top)
