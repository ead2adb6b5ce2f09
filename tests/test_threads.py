"""Hand-built threads: topic, state, role and action items."""

import datetime as dt

from threadlake.functions import threads as th

AT = dt.datetime(2024, 1, 1)


def test_thread_contexts(spark):
    said = {
        1: [(True, "let's plan the schedule"), (False, "I'll bring the big tent. please call me"), (True, "need to call me, thanks")],
        2: [(False, "are you free?")],
        3: [(False, "congrats!! so happy for you, well done"), (False, "hm"), (True, "where are you?")],
        4: [(False, None), (False, ""), (False, "kk")],
        5: [(False, f"word {i}") for i in range(12)] + [(True, "could you send me the very long list please send ME the very long list")],
        6: [(False, "hm"), (True, "hm"), (True, "hm"), (True, "hm")],
        None: [(False, "zzz")],
    }
    rows = [(chat, i, AT + dt.timedelta(minutes=i), mine, text) for chat, own in said.items() for i, (mine, text) in enumerate(own)]
    df = spark.createDataFrame(rows, "chat_id long, id long, date timestamp, is_from_me boolean, text string")
    got = {r["chat_id"]: r for r in th.thread_contexts(df).collect()}
    pick = lambda c: (got[c]["n"], got[c]["topic"], got[c]["confidence"], got[c]["state"], got[c]["role"])
    assert pick(1) == (3, "planning", 0.7, "concluded", "initiator")
    assert got[1]["items"] == ["bring the big tent", "call me", "call me, thanks"]
    assert pick(2) == (1, "planning", 0.4, "open_question", "responder")
    assert pick(3) == (3, "celebration", 0.8, "awaiting_response", "participant")
    assert pick(4) == (3, "quick_exchange", 0.4, "concluded", "responder")
    assert pick(5)[0] == 13 and pick(5)[3:] == ("awaiting_response", "responder") and got[5]["items"] == ["send me the very long list please send ME the very long list", "send ME the very long list"]
    assert pick(6)[4] == "initiator" and pick(6)[1:3] == ("unknown", 0.0)
    assert pick(None) == (1, "unknown", 0.0, "in_discussion", "responder")
    assert th.thread_contexts(df.where("false")).count() == 0


def test_relationships(spark):
    from threadlake.functions import relationships as re

    day = dt.datetime(2024, 3, 1)

    def chat(c, texts, hours, step=1):
        return [(c, day + dt.timedelta(days=i * step, hours=hours[i % len(hours)]), t) for i, t in enumerate(texts)]

    rows = chat(1, ["meeting about the project deadline, please review"] * 12, [10, 11], 3)
    rows += chat(2, ["dude lol party tonight 🎉🎉, gonna be at the bar"] * 12, [22, 23])
    rows += chat(3, ["hm"] * 12, [12])
    rows += chat(4, ["love you mom"] * 9, [12]) + [(4, day, None), (4, day, "")]
    rows += chat(5, ["ok"] * 10, [0, 12])
    names = spark.createDataFrame([(3, "Gopal Mama"), (5, "my-Babe"), (1, "Moma")], "chat_id long, name string")
    got = {r["chat_id"]: r for r in re.relationships(spark.createDataFrame(rows, "chat_id long, date timestamp, text string"), names).collect()}
    assert {c: r["relationship"] for c, r in got.items()} == {1: "coworker", 2: "close friend", 3: "family", 4: "unknown", 5: "romantic partner"}
    assert got[1]["scores"]["coworker"] == 0.9 and got[1]["scores"]["family"] < 0.2
    assert (got[4]["confidence"], got[4]["n"], got[4]["scores"]) == (0.0, 9, None)
    assert got[3]["scores"]["family"] >= 0.5 and got[2]["confidence"] == 1.0
    assert re.relationships(spark.createDataFrame([], "chat_id long, date timestamp, text string")).count() == 0
