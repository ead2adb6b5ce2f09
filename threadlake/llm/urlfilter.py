"""URL filters as of fetch time.

Dated list entries (add or remove a pattern) become validity intervals; every capture is held against the entries that
were active when it was fetched. Patterns are a host, a domain above it, or a host with its first path segment.
Intervals and captures are cut by month, so that the join runs on (pattern, month): a pattern with a long history is dealt over
many keys, and a capture meets its own month's intervals only. Where a domain has very many captures in a month, these are dealt
over several parts, each of which has the month's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import small, stored

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def _month(ts: str | Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: open) of entries(list, pattern, action, ts).

    An 'add' holds from its time to the list's next entry for the pattern; at equal times 'remove' comes last and wins.
    Rows with a null or another action are left out; repeated entries count once.
    """
    e = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND ts IS NOT NULL AND action IN ('add', 'remove')").select("list", F.lower("pattern").alias("pattern"), "action", "ts").distinct()
    e = e.withColumn("month", _month("ts"))
    # the next entry is in the same month or the first of a later month with entries: no long history meets in one task
    inside = Window.partitionBy("list", "pattern", "month").orderBy("ts", "action")
    firsts = e.groupBy("list", "pattern", "month").agg(F.min("ts").alias("first"))
    firsts = firsts.select("list", "pattern", "month", F.lead("first").over(Window.partitionBy("list", "pattern").orderBy("month")).alias("later"))
    e = e.withColumn("next", F.lead("ts").over(inside)).join(firsts, ["list", "pattern", "month"])
    return e.where("action = 'add'").select("list", "pattern", F.col("ts").alias("valid_from"), F.coalesce("next", "later").alias("valid_to")).where("valid_to IS NULL OR valid_to > valid_from")


def patterns(captures: DataFrame) -> DataFrame:
    """captures with host, and an array of the patterns that may hold for each."""
    host = F.nullif(F.regexp_replace(F.regexp_extract(F.lower("url"), HOST, 1), r"\.+$", ""), F.lit(""))
    segment = F.nullif(F.regexp_extract(F.lower("url"), SEGMENT, 1), F.lit(""))
    labels = F.split("host", r"\.")
    # the host and each domain above it of two labels at least
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    both = F.concat(domains, F.when(F.col("segment").isNotNull(), F.array(F.concat_ws("/", "host", "segment"))).otherwise(F.array().cast("array<string>")))
    return captures.withColumn("host", host).withColumn("segment", segment).withColumn("patterns", F.when(F.col("host").isNotNull(), F.array_distinct(both))).drop("segment")


#: Captures of one pattern in one month that make a part.
PART = 1_000_000


def filtered(captures: DataFrame, entries: DataFrame, part: int = PART) -> DataFrame:
    """page_id, url, fetch_ts, host, blocked, n_active, lists, pattern of every row of captures(page_id, url, fetch_ts, ...).

    n_active counts (list, pattern) entries active at fetch_ts, lists names their lists in order, pattern is the longest
    of them (ties: the first by name). A null or unreadable url or a null fetch_ts blocks nothing. Repeated rows are each
    answered; other columns are ignored; with no entries nothing is blocked.
    """
    c = patterns(captures.select("page_id", "url", F.col("fetch_ts").cast("timestamp").alias("fetch_ts")))
    keyed = c.where("fetch_ts IS NOT NULL AND patterns IS NOT NULL").select("page_id", "url", "fetch_ts", F.explode("patterns").alias("pattern"), _month("fetch_ts").alias("month"))
    # intervals are cut up to the last fetch
    last = F.lit(captures.agg(F.max(F.col("fetch_ts").cast("timestamp"))).first()[0]).cast("timestamp")
    end = F.least(F.coalesce(_month("valid_to"), _month(last)), _month(last))
    valid = intervals(entries).where(F.col("valid_from") <= last).select("list", "pattern", "valid_from", "valid_to", F.explode(F.sequence(_month("valid_from"), F.greatest(_month("valid_from"), end))).alias("month"))
    # as many rows at most as there are parts of that size among the captures' patterns
    hot = stored(keyed.groupBy("pattern", "month").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1"), "hot")
    hot, parts = small(hot), F.coalesce("parts", F.lit(1))
    keyed = keyed.join(hot, ["pattern", "month"], "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "fetch_ts"), parts).cast("int")).drop("parts")
    valid = valid.join(hot, ["pattern", "month"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    hits = keyed.join(valid, ["pattern", "month", "part"]).where("fetch_ts >= valid_from AND (valid_to IS NULL OR fetch_ts < valid_to)")
    found = hits.groupBy("page_id", "url", "fetch_ts").agg(F.countDistinct("list", "pattern").alias("n_active"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.min_by("pattern", F.struct(-F.length("pattern"), "pattern")).alias("pattern"))
    found = found.withColumnsRenamed({"page_id": "p", "url": "u", "fetch_ts": "f"})
    out = c.drop("patterns").join(found, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("fetch_ts") == F.col("f")), "left")
    return out.select("page_id", "url", "fetch_ts", "host", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "pattern")
