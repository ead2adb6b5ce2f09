"""Versioned vector tables: runs that add nothing, batches that broke off, activation while others read, odd rows."""

import datetime as dt
import os
import threading

import pytest

from threadlake.sources import vectorstore as vs

AT = dt.datetime(2024, 1, 1)
SCHEMA = "id long, chat_id long, text string, sender string, date timestamp, is_from_me boolean, embedding array<float>"


def message(i, text="abc", chat=1, v=None):
    return (i, chat, text, "me", AT, False, v if v is not None else [0.5, -0.5, 0.0, (i or 0) / 100])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_only_new_messages_are_written(spark, tmp_path):
    base = str(tmp_path)
    vs.add_version(spark, base, "v1", "m", 4)
    assert vs.read(spark, base, "messages", "v1").count() == 0
    rows = [message(1), message(2, "x" * 500), message(3, " ab "), message(4, None), message(5, ""), message(6, v=[1.0]), message(7, v=[1.0, None, 0.0, 0.0]), message(None), message(8, chat=None), message(8, chat=None)]
    assert vs.index_messages(frame(spark, rows), base, "v1", 4) == 3
    assert vs.index_messages(frame(spark, rows), base, "v1", 4) == 0
    assert vs.batches(spark, base, "v1", "messages") == [0]
    assert vs.index_messages(frame(spark, [*rows, message(9), message(1, "changed")]), base, "v1", 4) == 1
    got = {r["id"]: r for r in vs.read(spark, base, "messages", "v1").collect()}
    assert sorted(got) == [1, 2, 8, 9] and got[9]["batch"] == 1 and got[1]["preview"] == "abc"
    assert len(got[2]["preview"]) == 200 and got[2]["timestamp"] == int(AT.replace(tzinfo=dt.UTC).timestamp())
    assert (list(got[1]["embedding"]), bytes(got[1]["bits"])) == ([63, -63, 0, 1], bytes([0b10010000]))


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    base = str(tmp_path)
    vs.add_version(spark, base, "v1", "m", 4)
    vs.index_messages(frame(spark, [message(1)]), base, "v1", 4)
    vs.index_messages(frame(spark, [message(2), message(3)]), base, "v1", 4)
    os.remove(f"{base}/versions/v1/messages/batch=1/_SUCCESS")
    assert {r["id"] for r in vs.read(spark, base, "messages", "v1").collect()} == {1}
    assert vs.index_messages(frame(spark, [message(1), message(2), message(4)]), base, "v1", 4) == 2
    assert {r["id"]: r["batch"] for r in vs.read(spark, base, "messages", "v1").collect()} == {1: 0, 2: 1, 4: 1}


def test_readers_see_one_active_version(spark, tmp_path):
    base = str(tmp_path)
    assert vs.active(spark, base) is None and vs.versions(spark, base).count() == 0
    with pytest.raises(ValueError):
        vs.read(spark, base, "messages")
    for v in ("v1", "v2"):
        vs.add_version(spark, base, v, "m", 4)
        vs.index_messages(frame(spark, [message(int(v[1]))]), base, v, 4)
    assert not vs.activate(spark, base, "v3") and vs.active(spark, base) is None
    vs.activate(spark, base, "v1")
    seen, done = set(), []

    def watch():
        while not done:
            seen.add(vs.active(spark, base))

    t = threading.Thread(target=watch)
    t.start()
    for k in range(10):
        vs.activate(spark, base, "v2" if k % 2 == 0 else "v1")
    vs.activate(spark, base, "v2")
    done.append(1)
    t.join()
    assert seen <= {"v1", "v2"}
    assert [r["id"] for r in vs.read(spark, base, "messages").collect()] == [2]
    assert {(r["version"], r["vectors"], r["is_active"]) for r in vs.versions(spark, base).collect()} == {("v1", 1, False), ("v2", 1, True)}
    with pytest.raises(Exception, match="exists"):
        vs.add_version(spark, base, "v1", "m", 4)


def test_search_reads_the_buckets_of_a_chat(spark, tmp_path):
    base = str(tmp_path)
    vs.add_version(spark, base, "v1", "m", 4)
    vs.index_messages(frame(spark, [message(i, chat=i % 7) for i in range(1, 40)]), base, "v1", 4)
    vs.activate(spark, base, "v1")
    near = vs.search(spark, base, [0.5, -0.5, 0.0, 0.2], 3)
    assert [r["id"] for r in near.collect()] == [20, 19, 21]
    own = vs.search(spark, base, [0.5, -0.5, 0.0, 0.2], 2, "3")
    assert [r["id"] for r in own.collect()] == [17, 24]
    assert "PartitionFilters: [isnotnull(bucket" in own._jdf.queryExecution().toString()


def test_passages(spark):
    rows = [("s", 1, i, AT + dt.timedelta(seconds=i), i % 2 == 0, t) for i, t in enumerate(["mine", "a" * 600, "", "b" * 600, None, "c" * 600, "my end"])] + [("t", 2, 9, AT, True, "only mine"), ("u", 3, 10, AT, False, None)]
    (r,) = vs.passages(spark.createDataFrame(rows, "segment_id string, chat_id long, id long, date timestamp, is_from_me boolean, text string")).collect()
    assert (r["segment_id"], r["n"], r["context"], r["reply"]) == ("s", 7, "a" * 600 + "\n" + "b" * 399, "mine\nmy end")


def test_line_break_at_the_end_of_a_passage(spark):
    rows = [("s", 1, 1, dt.datetime(2024, 1, 1, 1), False, "x" * (vs.PASSAGE - 1)), ("s", 1, 2, dt.datetime(2024, 1, 1, 2), False, "y"), ("s", 1, 3, dt.datetime(2024, 1, 1, 3), False, "z")]
    (r,) = vs.passages(spark.createDataFrame(rows, "segment_id string, chat_id long, id long, date timestamp, is_from_me boolean, text string")).collect()
    assert r["context"] == "x" * (vs.PASSAGE - 1) + "\n"
