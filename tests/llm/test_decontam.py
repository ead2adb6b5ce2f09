"""Benchmark items that templates alone do not protect."""

from threadlake.llm import decontam


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, i).collect()}


def test_items_without_plain_windows(spark):
    items = ["If 3 pens cost 7 dollars and 5 cups cost 9 dollars, find 2 pens.", "Solve 3 x + 5 y = 12 and 2 x - 7 y = 4.", "Who wrote Hamlet and in what year?", "Name it: 5", "?!", ""]
    docs = [*items[:3], *(f"We saw this today: {t} And then more." for t in items[:4]), "If 4 pens cost 8 dollars and 6 cups cost 3 dollars, find 9 pens.", "Who wrote Hamlet and in what month?", "Take 1 2 3 4 5 of it", "?!", "", None]
    got = found(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (5, 2), (6, 3)}
    assert {(r["kind"], r["coverage"], r["n_changed"]) for r in got.values()} == {("exact", 1.0, 0)}
    assert [got[k]["n_windows"] for k in ((2, 2), (6, 3))] == [1, 1] and got[0, 0]["n_slots"] > 0


def test_few_words_by_chance(spark):
    """Numbers count once, with or without a unit: a row of five is no copy of an item that holds it."""
    got = found(spark, ["count 1 2 3 4 5 and stop", "take 1 2 3 4 5 6 7 8 9 10 here"], ["Put the cards 1 2 3 4 5 6 7 8 9 10 in order of size and colour"])
    assert set(got) == {(1, 0)}


def test_other_case(spark):
    item = "Yesterday, Anna met Boris, Carla, Dmitri, Elena, Fatima, Goran, Hana, Igor and Jana"
    assert set(found(spark, [item.lower(), item.upper(), item], [item])) == {(0, 0), (1, 0), (2, 0)}


def test_copies_apart(spark):
    """Values are compared within a copy, not over all copies of a document or over equal windows of an item."""
    train = "A train travels {} km in {} hours and then on to the next big town in {} hours. How far is it from there?"
    box = "A box holds {} eggs and a second box holds {} eggs in it. A box holds {} eggs and a second box holds {} eggs in it. Sum?"
    twice = "A train leaves at {} mph and goes on to a town at {} mph again today"
    items = [train.format(60, 2, 3), box.format(12, 30, 15, 40), twice.format(60, 60)]
    docs = [train.format(70, 4, 6) + " " + train.format(80, 5, 7), items[0] + " " + train.format(60, 2, 5), items[1], twice.format(75, 80), twice.format(75, 75)]
    got = found(spark, docs, items)
    assert {k: r["kind"] for k, r in got.items()} == {(0, 0): "reparameterised", (1, 0): "exact", (2, 1): "exact", (4, 2): "reparameterised"}
    assert got[0, 0]["n_changed"] == 2 and got[1, 0]["n_changed"] == 0 and got[2, 1]["n_changed"] == 0  # 60 stands in no window of five plain words
