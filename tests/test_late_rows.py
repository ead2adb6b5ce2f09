"""Rows of one run of a stream are not late for each other."""

import datetime as dt

from threadlake.streaming import messages as st


def test_files_of_a_run_in_any_order(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double"
    out = str(tmp_path / "out")
    days = [(20, 19, 3, 12), (25, 9, 21)]
    for run, files in enumerate(days):
        for k, day in enumerate(files):
            rows = [(run * 100 + k * 10 + i, 1, dt.datetime(2024, 1, day, i), "click", 1.0) for i in range(3)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows = st.sliding(st.event_stream(spark, str(tmp_path / "in"), None), "1 day", "1 day", "1 day")
        st.drain(windows, "update", lambda df, batch: st.put(df, f"{out}/rows", batch), out)
    newest = {r["day"]: r["n"] for r in spark.read.parquet(f"{out}/rows").selectExpr("day(start) AS day", "n").groupBy("day").max("n").toDF("day", "n").collect()}
    # the ninth comes in the second run, later than the first run's watermark
    assert newest == {20: 3, 19: 3, 3: 3, 12: 3, 25: 3, 21: 3}
