"""Hand-built border cases of the fact chain and of category features."""

import pytest
from pyspark.sql import functions as F

from threadlake.functions import categories as ca
from threadlake.operators import factchain as fc

CASES = [
    ("my sister Sarah lives in Austin", [("relationship", "is_family_of", "Sarah", 0.8, None), ("location", "lives_in", "Austin", 0.85, None), ("location", "lives_in", "Austin", 0.7, "repeated")]),
    ("I love it in August", [("preference", "likes", "it in August", 0.6, "vague_pronoun")]),
    ("I hate that!", [("preference", "dislikes", "that", 0.42, "vague_pronoun")]),
    ("loved how you did that", [("preference", "likes", "how you did that", 0.66, "clause")]),
    ("I enjoy hiking.", [("preference", "likes", "hiking", 0.42, "doubtful")]),
    ("we love spicy ramen noodles and beer", [("preference", "likes", "spicy ramen noodles", 0.6, None)]),
    ("obsessed with me", [("preference", "likes", "me", 0.42, "vague")]),
    ("love to see you", [("preference", "likes", "to see you", 0.6, "incomplete")]),
    ("hate at night", [("preference", "dislikes", "at night", 0.42, "incomplete")]),
    ("prefer ofmetalThings over wood", [("preference", "likes", "ofmetalThings over wood", 0.6, "malformed")]),
    ("I enjoy xo ab cd efg", [("preference", "likes", "xo ab cd efg", 0.66, "malformed")]),
    ("dislike it, it feels like a chore", [("preference", "likes", "it", 0.42, "filler")]),
    ("allergic to peanut butter cookies is", [("preference", "dislikes", "peanut butter cookies", 0.6, None)]),
    ("moved to Berlin, then moved to Berlin", [("location", "lives_in", "Berlin", 0.7, None), ("location", "lives_in", "Berlin", 0.7, "repeated")]),
    ("my best friend John Smith joined Big Corp", [("relationship", "is_friend_of", "John Smith", 0.8, None), ("work", "works_at", "Big Corp", 0.7, None)]),
    ("my boss Anna", [("relationship", "is_associated_with", "Anna", 0.8, None)]),
    ("grew up in Texas", [("location", "lived_in", "Texas", 0.5, None)]),
    ("Loved “my sister Sarah”", []),
    ("k", []),
    (None, []),
    ("", []),
]


def test_fact_chain(spark):
    rows = [(i, 1, t) for i, (t, _) in enumerate(CASES)]
    got = {}
    for r in fc.judged(spark.createDataFrame(rows, "id long, chat_id long, text string")).orderBy("id", "rule", "pos").collect():
        got.setdefault(r["id"], []).append((r["category"], r["predicate"], r["subject"], r["confidence"], r["reason"]))
    for i, (text, want) in enumerate(CASES):
        assert got.get(i, []) == want, text


def test_funnel_adds_up(spark):
    df = spark.createDataFrame([(i, i % 2, t) for i, (t, _) in enumerate(CASES)], "id long, chat_id long, text string")
    for r in fc.funnel(df).collect():
        assert r["raw"] == r["kept"] + sum(r[x] for x in fc.REASONS)
    assert fc.funnel(df.where("false")).count() == 0
    kept = {(i % 2, c, s.lower(), p) for i, (_, w) in enumerate(CASES) for c, p, s, _, reason in w if reason is None}
    assert {(r["chat_id"], r["category"], r["subject"].lower(), r["predicate"]) for r in fc.facts(df).collect()} == kept


FEATURE_CASES = [
    ("", [], {"n_chars": 0, "n_words": 0, "no_context": 1, "emotional_position": 1, "context_overlap": 0}),
    (None, None, {"n_chars": 0, "no_context": 1}),
    ("ok but if you can't, tell me", ["a bc"], {"clause_after_agreement": 1, "n_context": 1, "context_chars": 4, "no_context": 0, "n_words": 7}),
    ("lol that is fr so LOL lol", ["so", "that that"], {"abbreviated": 1, "abbreviation_share": 4 / 7, "n_emotional": 3, "ends_emotional": 1, "emotional_position": 0, "context_overlap": 2 / 5, "capital_share": 1 / 6}),
    ("can you send it? right?", ["x"] * 5, {"polite_modal": 1, "asks_first": 1, "tag_question": 1, "n_questions": 2, "n_context": 5, "context_overlap": 0}),
    ("nooo yaasss!!", [], {"elongated_share": 1.0, "exclaims": 1, "ends_exclaiming": 1, "n_exclamations": 2}),
    ("OMG", [], {"exclaims": 1, "brief_agreement": 0, "n_emotional": 1}),
    ("yeah sure", [], {"brief_agreement": 1, "exclaims": 0}),
    ("Laughed at “x”", [], {"reaction": 1}),
    ("please send the invoice asap, thx 🙏😊😢🤔", [], {"please": 1, "professional": 1, "urgency": 1, "thanks": 1, "positive_emoji": 2, "negative_emoji": 1, "neutral_emoji": 1, "n_emoji": 4, "closing_emoji": 1}),
    ("I need you to help, if you could, let's go. gotta run, ttyl", [], {"implicit_request": 1, "needs_you": 1, "conditional": 1, "proposal": 1, "hurried": 1, "goodbye": 1}),
    ("hey there, sorry, later", [], {"greeting": 1, "apology": 1, "future": 1, "goodbye": 1}),
    ("Élan Vital été", [], {"capital_share": 0.5, "n_words": 3}),
]


@pytest.mark.parametrize("pressure,kind", [("high", "emotional"), (None, None)])
def test_category_features(spark, pressure, kind):
    df = spark.createDataFrame([(i, t, c, pressure, kind) for i, (t, c, _) in enumerate(FEATURE_CASES)], "id long, text string, ctx array<string>, p string, k string")
    f = ca.category_features(*map(F.col, ("text", "ctx", "p", "k")))
    assert list(f) == ca.FEATURES and len(set(ca.FEATURES)) == 49
    rows = df.select("id", *[c.alias(n) for n, c in f.items()], ca.category_vector(*map(F.col, ("text", "ctx", "p", "k"))).alias("v")).orderBy("id").collect()
    for r, (text, _, want) in zip(rows, FEATURE_CASES, strict=True):
        assert {n: r[n] for n in want} == pytest.approx(want), text
        assert r["v"] == [r[n] for n in ca.FEATURES]
        assert (r["pressure_high"], r["pressure_none"], r["kind_emotional"], r["kind_answer"]) == ((1, 0, 1, 0) if pressure else (0, 1, 0, 1))


DATES = [
    ("Dinner on March 3rd at 7pm", "named", "2024-03-03", "2024-03-03 19:00", False),
    ("Meeting 2025-2-7 10:30", "iso", "2025-02-07", "2025-02-07 10:30", False),
    ("doctor Sept 9, 2026", "named", "2026-09-09", "2026-09-09 09:00", True),
    ("lunch on the 3rd of May 2025 at 1 pm", "day_first", "2025-05-03", "2025-05-03 13:00", False),
    ("coffee 12/24/24 at 9am", "numeric", "2024-12-24", "2024-12-24 09:00", False),
    ("call on the 31st", "ordinal", "2024-01-31", "2024-01-31 09:00", True),
    ("party on Feb 30", None, None, None, None),
    ("trip 13/45", None, None, None, None),
    ("lunch tomorrow at noon, not on March 5", "named", "2024-03-05", "2024-03-05 09:00", True),
    ("lunch tomorrow at 1pm, not on March 5", "named", "2024-03-05", "2024-01-04 13:00", False),
    ("dinner next weekend", None, None, "2024-01-13 09:00", True),
    ("see you March 3rd", "named", "2024-03-03", None, None),
    (None, None, None, None, None),
]


def test_dates_that_are_written_out(spark):
    from threadlake.functions import dates as da

    now = F.lit("2024-01-03 15:00:00").cast("timestamp")
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(DATES)], "i int, t string")
    rows = df.select("i", da.free_date(F.col("t"), now).alias("d"), F.get(da.events(F.col("t"), now), F.lit(0)).alias("e")).orderBy("i").collect()
    for r, (text, form, day, start, all_day) in zip(rows, DATES, strict=True):
        assert (r["d"] and r["d"]["form"], r["d"] and str(r["d"]["day"])) == (form, day), text
        assert (r["e"] and f"{r['e']['start']:%Y-%m-%d %H:%M}", r["e"] and r["e"]["all_day"]) == (start, all_day), text


def test_owners(spark):
    rows = [("my sister Anna lives in Oslo", "location", False, "third_party"), ("I live in Oslo", "location", True, "user"), ("I live in Oslo", "location", False, "contact"), ("Anna is her boss", "relationship", True, "third_party"), ("Anna is her boss", "work", True, "user"), (None, "work", True, "contact"), ("", "work", True, "contact"), ("hi", "work", None, "contact")]
    df = spark.createDataFrame(rows, "t string, c string, m boolean, want string")
    assert all(r[0] == r[1] for r in df.select(fc.owner(F.col("t"), F.col("c"), F.col("m")), "want").collect())
