"""Thresholds and access patterns: borders by hand, plain versions, and streams that leave what one batch gives, also when they go on after a stop."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.operators import adaptive, prefetch
from threadlake.streaming.messages import drain, event_stream

SF = "/root/testdata/sf0.001"
RULE = adaptive.Rule(least=6)


def made(seed, n=400, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, 40 * 24 * 3600, size=n))
    actions = ["sent", "edited", "dismissed", "wrote_from_scratch", "copied", "unknown"]
    sim = rng.random(n)
    pick = [actions[int(rng.choice(6, p=[0.15 + 0.55 * s, 0.2, 0.45 - 0.42 * s, 0.1 - 0.1 * s, 0.05, 0.05 - 0.03 * s] / np.sum([0.15 + 0.55 * s, 0.2, 0.45 - 0.42 * s, 0.1 - 0.1 * s, 0.05, 0.05 - 0.03 * s])))] for s in sim]
    rows = [(keys[int(rng.integers(len(keys)))], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)), float(round(x, 4)), a) for s, x, a in zip(t, sim, pick, strict=True)]
    return rows + [(None, rows[0][1], 0.5, "sent"), ("a", None, 0.5, "sent"), ("a", rows[3][1], None, "sent"), ("a", rows[3][1], 0.5, None), ("b", rows[5][1], 1.0, "sent"), ("b", rows[5][1], -0.2, "sent"), ("b", rows[5][1], 1.7, "sent")]


def plain(rows, hours, rule):
    """Key and period to thresholds, one row after another."""
    groups = {}
    for k, t, s, a in rows:
        if k is not None and t is not None and s is not None and a in adaptive.COUNTED:
            p = int((t - dt.datetime(1970, 1, 1)).total_seconds() // (3600 * hours))
            b = max(0, min(19, int(np.floor(round(s / 0.05, 9)))))
            groups.setdefault(k, {}).setdefault(p, []).append((b, a))
    out = {}
    for k, periods in groups.items():
        now = list(rule.base)
        for p, own in sorted(periods.items()):
            if len(own) < rule.least:
                out[k, p] = (len(own), *rule.base, True)
                continue
            best = []
            for (target, least), base in zip([(0.7, 5), (0.7 * 0.85, 3), (0.7 * 0.7, 3)], rule.base, strict=True):
                at = base
                for b in range(19, -1, -1):
                    mine = [a for x, a in own if x == b]
                    if len(mine) >= least:
                        if sum(a in ("sent", "edited") for a in mine) / len(mine) < target:
                            break
                        at = round(b * 0.05, 2)
                best.append(at)
            if best[1] >= best[0]:
                best[1] = best[0] - 0.1
            if best[2] >= best[1]:
                best[2] = best[1] - 0.1
            now = [max(lo, min(hi, x + 0.2 * (o - x))) for x, o, lo, hi in zip(now, best, rule.low, rule.high, strict=True)]
            out[k, p] = (len(own), *now, False)
    return out


def shown(rows):
    return {(r["key"], r["period"]): (r["n"], r["quick"], r["context"], r["generate"], r["fallback"]) for r in rows}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k]), k


@pytest.mark.parametrize("seed,hours", [(0, 72), (1, 24), (2, 24 * 10)])
def test_thresholds(spark, seed, hours):
    rows = made(seed)
    df = spark.createDataFrame(rows, "key string, ts timestamp, similarity double, action string")
    want = plain(rows, hours, RULE)
    close(shown(adaptive.adapted(df, hours, RULE).collect()), want)
    assert any(v[4] for v in want.values()) or hours > 24
    assert any(v[1:4] != RULE.base for v in want.values())
    assert adaptive.adapted(df.where("false")).count() == 0


def test_thresholds_of_a_stream(spark, tmp_path):
    """Rows in files by time, one a batch, with a stop between: what a batch over all gives, but for each key's open period."""
    rows, hours = made(4), 48
    df = spark.createDataFrame(rows, "key string, ts timestamp, similarity double, action string")
    schema = df.schema
    timed = df.where("ts IS NOT NULL")
    for i in range(4):
        lo, hi = (F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=10 * d)) for d in (i, i + 1))
        timed.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        out = drain(adaptive.adapted_stream(stream, hours, RULE), "append", base=str(tmp_path / "base"))
    want = plain(rows, hours, RULE)
    last = {k: max(p for key, p in want if key == k) for k, _ in want}
    close(shown(out.collect()), {(k, p): v for (k, p), v in want.items() if p < last[k]})


def test_access_patterns_after_batches(spark, tmp_path):
    """Hour weights and recent messages after several batches and a restart are those of one batch."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    one = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("chat_id"), F.col("ts").cast("timestamp").alias("date"), F.col("event_type").isin("click", "purchase").alias("is_from_me"))
    for half in (None, 3.0):
        base = str(tmp_path / f"base{half}")
        for i in range(3):
            events.where(f"day(ts) % 3 = {i}").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in{half}/{i}")
            prefetch.follow(event_stream(spark, f"{tmp_path}/in{half}/*"), base, half, 24 * 3600)
        got = {(r["chat_id"], r["hour"]): r["weight"] for r in prefetch.latest(spark, base, "hours", "chat_id long, hour int, weight double").collect()}
        want = {(r["chat_id"], r["hour"]): r["weight"] for r in prefetch.hour_weights(one, half).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        recent = {(r["chat_id"], r["id"]) for r in prefetch.latest(spark, base, "recent", "chat_id long, id long, date timestamp").collect()}
        rows = one.collect()
        last = {r["chat_id"]: max(x["date"] for x in rows if x["chat_id"] == r["chat_id"]) for r in rows}
        assert recent == {(r["chat_id"], r["id"]) for r in rows if (last[r["chat_id"]] - r["date"]).total_seconds() < 24 * 3600}
    assert prefetch.latest(spark, str(tmp_path / "none"), "hours", "chat_id long, hour int, weight double").count() == 0


def test_time_of_day(spark):
    rows = [(1, 23, 4.0), (1, 0, 2.0), (2, 0, 3.0), (3, 0, 1.0), (4, 1, 40.0), (5, 12, 1.5)]
    got = {(r["hour"], r["chat_id"]): (r["score"], r["confidence"]) for r in prefetch.time_of_day(spark.createDataFrame(rows, "chat_id long, hour int, weight double")).collect()}
    assert got[0, 4] == (20.0, 0.9) and got[0, 1] == (4.0, 0.2) and got[0, 2] == (3.0, 0.15)
    assert (0, 3) not in got and got[23, 1] == (5.0, 0.25) and got[1, 4] == (40.0, 0.9) and got[2, 4] == (20.0, 0.9)
    assert not any(c == 5 for _, c in got)


def test_continuation(spark):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(1, at - dt.timedelta(seconds=s)) for s in (0, 60, 1000, 1799, 1800)] + [(2, at - dt.timedelta(seconds=600)), (3, at - dt.timedelta(seconds=1700)), (4, None)]
    got = {(r["at"], r["chat_id"]): (r["n"], r["confidence"], r["priority"]) for r in prefetch.continuation(spark.createDataFrame(rows, "chat_id long, date timestamp")).collect()}
    assert got[at, 1] == (4, 0.7 + 0.12, "high")
    assert got[at, 2] == (1, round((1 - 1 / 3) * 0.7 + 0.03, 6), "medium")
    assert (at, 3) not in got and not any(c == 4 for _, c in got)
