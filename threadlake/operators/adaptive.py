"""Thresholds that follow feedback: optimal ones by period, smoothed from period to period and kept in bounds; the same as a stream's state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadlake.session import ship


@dataclass(frozen=True)
class Rule:
    """Base thresholds (quick, context, generate), their bounds, share of the way to the optimum that a period goes, target rate, bucket width, rows that a period needs."""

    base: tuple[float, float, float] = (0.95, 0.65, 0.45)
    low: tuple[float, float, float] = (0.80, 0.50, 0.30)
    high: tuple[float, float, float] = (0.99, 0.85, 0.65)
    rate: float = 0.2
    target: float = 0.70
    width: float = 0.05
    least: int = 50

    @property
    def buckets(self) -> int:
        return round(1 / self.width)

    @property
    def walks(self) -> tuple[tuple[float, int], ...]:
        """The rate that a bucket must reach and the rows that it must have to count, for each threshold."""
        return (self.target, 5), (self.target * 0.85, 3), (self.target * 0.70, 3)


ACCEPTED, COUNTED = ("sent", "edited"), ("sent", "edited", "dismissed", "wrote_from_scratch", "copied")
NAMES = ("quick", "context", "generate")


def _walk(buckets: Column, target: float, least: int) -> Column:
    """The start of the lowest bucket such that it and all above it, of those with enough rows, reach the target; null if the highest does not."""
    start = F.struct(F.lit(False).alias("stop"), F.lit(None).cast("double").alias("at"))
    step = lambda s, b: F.when(s["stop"] | (b["n"] < least), s).when(b["good"] / b["n"] >= target, F.struct(F.lit(False).alias("stop"), b["start"].alias("at"))).otherwise(F.struct(F.lit(True).alias("stop"), s["at"].alias("at")))
    return F.aggregate(buckets, start, step)["at"]


def optimal(feedback: DataFrame, hours: int, rule: Rule = Rule()) -> DataFrame:
    """key, period (number of the span of so many hours), n, quick, context, generate of feedback(key, ts, similarity, action), each period by itself.

    Rows without key, time, similarity or a known action are left out; copied ones count, but not as accepted. A period keeps one row for each
    bucket of similarity, however many rows it has.
    """
    rows = feedback.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("similarity").isNotNull() & F.col("action").isin(list(COUNTED)))
    bucket = F.least(F.greatest(F.floor(F.round(F.col("similarity") / rule.width, 9)), F.lit(0)), F.lit(rule.buckets - 1)).cast("int")
    period = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (3600 * hours)).cast("long")
    g = rows.groupBy("key", period.alias("period"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("action").isin(list(ACCEPTED))).alias("good"))
    one = F.struct((-F.col("bucket")).alias("down"), F.round(F.col("bucket") * rule.width, 2).alias("start"), "n", "good")
    p = g.groupBy("key", "period").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(one)).alias("b"))
    q, c, a = (F.coalesce(_walk(F.col("b"), *w), F.lit(base)) for w, base in zip(rule.walks, rule.base, strict=True))
    p = p.select("key", "period", "n", q.alias("quick"), c.alias("context"), a.alias("generate"))
    p = p.withColumn("context", F.when(F.col("context") >= F.col("quick"), F.col("quick") - 0.1).otherwise(F.col("context")))
    return p.withColumn("generate", F.when(F.col("generate") >= F.col("context"), F.col("context") - 0.1).otherwise(F.col("generate")))


def adapted(feedback: DataFrame, hours: int = 168, rule: Rule = Rule()) -> DataFrame:
    """key, period, n, quick, context, generate, fallback: the thresholds in force after each period that has feedback.

    Each goes the rule's share of the way from the last period's to its optimum and is then put into its bounds; periods
    with too few rows have the base thresholds and leave no trace. Periods of a key, as many as its time has, are folded in one row.
    """
    row = F.struct("period", "n", *NAMES)
    folded = optimal(feedback, hours, rule).groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("p"))
    out = F.struct(F.lit(0).cast("long").alias("period"), F.lit(0).cast("long").alias("n"), *[F.lit(b).alias(x) for x, b in zip(NAMES, rule.base, strict=True)], F.lit(True).alias("fallback"))
    start = F.struct(F.struct(*[F.lit(b).alias(x) for x, b in zip(NAMES, rule.base, strict=True)]).alias("now"), F.array().cast(f"array<{out_type()}>").alias("rows"))

    def step(s: Column, p: Column) -> Column:
        moved = [F.greatest(F.lit(lo), F.least(F.lit(hi), s["now"][x] + rule.rate * (p[x] - s["now"][x]))).alias(x) for x, lo, hi in zip(NAMES, rule.low, rule.high, strict=True)]
        few = p["n"] < rule.least
        now = F.when(few, s["now"]).otherwise(F.struct(*moved))
        shown = F.when(few, F.struct(*[F.lit(b).alias(x) for x, b in zip(NAMES, rule.base, strict=True)])).otherwise(F.struct(*moved))
        line = F.struct(p["period"].alias("period"), p["n"].alias("n"), *[shown[x].alias(x) for x in NAMES], few.alias("fallback"))
        return F.struct(now.alias("now"), F.concat(s["rows"], F.array(line)).alias("rows"))

    return folded.select("key", F.explode(F.aggregate("p", start, step)["rows"]).alias("r")).select("key", "r.*")


def out_type() -> str:
    return "struct<period:bigint,n:bigint,quick:double,context:double,generate:double,fallback:boolean>"


def _settled(now: list[float] | None, n: np.ndarray, good: np.ndarray, rule: Rule) -> tuple[list[float] | None, list[float], bool]:
    """What a period leaves: the thresholds to go on from, those to show, and whether it had too few rows. n and good by bucket."""
    if n.sum() < rule.least:
        return now, list(rule.base), True
    best = []
    for (target, least), base in zip(rule.walks, rule.base, strict=True):
        at = None
        for b in range(rule.buckets - 1, -1, -1):
            if n[b] >= least:
                if good[b] / n[b] < target:
                    break
                at = round(b * rule.width, 2)
        best.append(base if at is None else at)
    for k in (1, 2):
        if best[k] >= best[k - 1]:
            best[k] = best[k - 1] - 0.1
    before = now or rule.base
    now = [max(lo, min(hi, b + rule.rate * (x - b))) for b, x, lo, hi in zip(before, best, rule.low, rule.high, strict=True)]
    return now, now, False


def counted(batches: Iterator[pd.DataFrame], sizes: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and accepted ones by bucket of each period of rows (period, bucket, good); of the batches one is held at a time."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for rows in batches:
        for p, own in rows.groupby("period"):
            n, good = out.setdefault(int(p), (np.zeros(sizes, np.int64), np.zeros(sizes, np.int64)))
            n += np.bincount(own["bucket"], minlength=sizes)
            good += np.bincount(own["bucket"], weights=own["good"], minlength=sizes).astype(np.int64)
        rows = own = None  # noqa: F841, PLW2901
    return out


def adapted_stream(feedback: DataFrame, hours: int = 168, rule: Rule = Rule()) -> DataFrame:
    """As adapted, of a stream of feedback whose periods come one after another: a row when a period is over, that is when a later one begins.

    The state of a key is its thresholds and the counts of the open period by bucket, whatever it has seen. Rows of a period that is over are dropped.
    """
    ship(feedback.sparkSession)
    sizes = rule.buckets

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, period, n, good = None, None, np.zeros(sizes, np.int64), np.zeros(sizes, np.int64)
        if state.exists:
            held: tuple[Any, ...] = state.get
            now, period, n, good = (list(held[0]) if held[0] else None), held[1], np.array(held[2]), np.array(held[3])
        out = []
        for p, (more, better) in sorted(counted(batches, sizes).items()):
            if period is not None and p < period:
                continue
            if period is not None and p > period:
                now, shown, few = _settled(now, n, good, rule)
                out.append((key[0], period, int(n.sum()), *shown, few))
                n, good = np.zeros(sizes, np.int64), np.zeros(sizes, np.int64)
            period = p
            n += more
            good += better
        state.update((now or [], period, n.tolist(), good.tolist()))
        if out:
            yield pd.DataFrame(out, columns=["key", "period", "n", *NAMES, "fallback"])

    rows = feedback.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("similarity").isNotNull() & F.col("action").isin(list(COUNTED)))
    bucket = F.least(F.greatest(F.floor(F.round(F.col("similarity") / rule.width, 9)), F.lit(0)), F.lit(sizes - 1)).cast("int")
    period = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (3600 * hours)).cast("long")
    ready = rows.select("key", period.alias("period"), bucket.alias("bucket"), F.col("action").isin(list(ACCEPTED)).cast("long").alias("good"))
    kind = feedback.schema["key"].dataType.simpleString()
    return ready.groupBy("key").applyInPandasWithState(run, f"key {kind}, period long, n long, quick double, context double, generate double, fallback boolean", "now array<double>, period long, n array<long>, good array<long>", "append", GroupStateTimeout.NoTimeout)
