"""Threads that are bounded in time, against a plain scan; no group of a thread or a chat is gathered."""

import datetime as dt
import random

from threadlake.operators import sequences


def test_as_a_plain_scan_across_batches(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, *range(12)]), None if i % 97 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(400_000))) for i in range(3000)]
    want, last = {}, {}
    for i, c, t in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2] is not None, x[2] or dt.datetime.min, x[0])):
        if c not in last:
            last[c] = (t, t, 1)
        else:
            began, before, k = last[c]
            cut = t is None or before is None or (t - before).total_seconds() > 1800 or (t - began).total_seconds() > 7200
            last[c] = (t if cut else began, t, k + cut)
        want[i] = (c, last[c][2])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = sequences.bounded_threads(spark.createDataFrame(rows, "id long, chat_id long, date timestamp"), 30, 120)
        assert {x["id"]: (x["chat_id"], x["thread"]) for x in df.collect()} == want
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
