"""Queries over orders told as messages: category features, the chain of fact rules."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlake.functions import categories as ca
from threadlake.functions import dates as da
from threadlake.functions import normal as no
from threadlake.functions import relationships as rel
from threadlake.functions import threads as th
from threadlake.functions import tone as to
from threadlake.operators import factchain as fc
from threadlake.operators import facts as of
from threadlake.operators import messages as ops
from threadlake.operators import suggestions as su
from threadlake.plans.registry import query
from threadlake.sources.spoken import SP, spoken_messages
from threadlake.sources.tables import table


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


def _signs(signs: str) -> str:
    return f"(length(t) - length(translate(t, {_q(signs)}, '')))"


_RUNS = "(" + "|".join(c + "{3,}" for c in string.ascii_letters + string.digits + "_") + ")"
_N = "greatest(len(w), 1)"
_SHORT = "len(regexp_extract_all(t, '(?i)\\b(" + "|".join(ca.ABBREVIATIONS) + ")\\b'))"
FEATURE_SQL = {
    "n_chars": "length(t)",
    "n_words": "len(w)",
    "n_questions": "length(t) - length(replace(t, '?', ''))",
    "n_exclamations": "length(t) - length(replace(t, '!', ''))",
    "n_emoji": f"len(regexp_extract_all(t, '{ca.EMOJI}'))",
    **{f"pressure_{p}": f"pressure = '{p}'" for p in ca.PRESSURES},
    **{f"kind_{k}": f"kind = '{k}'" for k in ca.KINDS},
    "professional": "regexp_matches(t, '(?i)\\b(" + "|".join(ca.PROFESSIONAL) + ")\\b')",
    "abbreviated": f"{_SHORT} > 0",
    "n_context": "len(ctx)",
    "context_chars": "coalesce(list_avg(list_transform(ctx, lambda x: length(x))), 0)",
    "no_context": "len(ctx) = 0",
    "abbreviation_share": f"{_SHORT} / {_N}",
    "capital_share": "CASE WHEN len(w) > 1 THEN len(list_filter(w[2:], lambda x: x[1] <> lower(x[1]))) / (len(w) - 1) ELSE 0 END",
    "reaction": "(" + " OR ".join(f"starts_with(t, '{r}')" for r in ca.REACTIONS) + ")",
    "n_emotional": " + ".join(f"(length(low) - length(replace(low, '{m}', ''))) // {len(m)}" for m in ca.EMOTIONAL),
    "ends_emotional": f"coalesce(list_contains({_list(ca.EMOTIONAL)}, lw[-1]), false)",
    "asks_first": f"coalesce(list_contains({_list(ca.QUESTION_STARTERS)}, lw[1]), false)",
    "orders_first": f"coalesce(list_contains({_list(ca.IMPERATIVES)}, lw[1]), false)",
    "brief_agreement": f"len(w) <= 3 AND list_has_any(lw, {_list(ca.BRIEF_AGREEMENTS)})",
    "exclaims": "(ends_with(t, '!') OR (upper(t) = t AND low <> t)) AND len(w) <= 5",
    "clause_after_agreement": f"regexp_matches(low, {_q(ca.CLAUSE_AFTER_AGREEMENT)})",
    "emotional_position": f"CASE WHEN list_has_any(lw, {_list(ca.EMOTIONAL)}) THEN (list_position(list_transform(lw, lambda x: list_contains({_list(ca.EMOTIONAL)}, x)), true) - 1) / {_N} ELSE 1 END",
    "implicit_request": f"regexp_matches(low, {_q(ca.IMPLICIT_REQUEST)})",
    "greeting": f"regexp_matches(low, {_q(ca.GREETING)})",
    "elongated_share": f"len(regexp_extract_all(t, '{_RUNS}')) / {_N}",
    "proposal": f"regexp_matches(low, {_q(ca.PROPOSAL)})",
    "context_overlap": "CASE WHEN len(w) > 0 THEN len(list_intersect(list_distinct(lw), list_filter(regexp_split_to_array(lower(array_to_string(ctx[-2:], ' ')), '\\s+'), lambda x: x <> ''))) / len(list_distinct(lw)) ELSE 0 END",
    "tag_question": f"ends_with(t, '?') AND {_any('array_to_string(lw[-3:], chr(32))', ca.TAGS)}",
    "thanks": _any("low", ca.THANKS),
    "apology": _any("low", ca.APOLOGY),
    "urgency": _any("low", ca.URGENCY),
    "future": _any("low", ca.FUTURE),
    "positive_emoji": _signs(ca.POSITIVE_EMOJI),
    "negative_emoji": _signs(ca.NEGATIVE_EMOJI),
    "neutral_emoji": _signs(ca.NEUTRAL_EMOJI),
    "goodbye": _any("low", ca.GOODBYE),
    "closing_emoji": _signs(ca.CLOSING_EMOJI) + " > 0",
    "hurried": _any("low", ca.HURRIED),
    "ends_exclaiming": "ends_with(rtrim(t), '!')",
    "polite_modal": f"regexp_matches(low, {_q(ca.POLITE_MODAL)})",
    "please": f"regexp_matches(low, {_q(ca.PLEASE)})",
    "conditional": f"regexp_matches(low, {_q(ca.CONDITIONAL)})",
    "needs_you": f"regexp_matches(low, {_q(ca.NEED_YOU)})",
}
_CONTEXT = f"""
WITH m AS (SELECT id, coalesce(text, '') AS t, coalesce(list(text) OVER (PARTITION BY chat_id ORDER BY date, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS ctx,
  {_list(ca.PRESSURES)}[id % 4 + 1] AS pressure, {_list(ca.KINDS)}[id % 3 + 1] AS kind FROM {SP}),
n AS (SELECT *, lower(t) AS low, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM m), x AS (SELECT *, list_transform(w, lambda v: lower(v)) AS lw FROM n)"""


@query("scl24_category_features", f"{_CONTEXT} SELECT id, " + ", ".join(f"({FEATURE_SQL[f]})::DOUBLE AS {f}" for f in ca.FEATURES) + " FROM x")
def category_features(spark, sf_dir):
    """The named features of every message, with the three before it as context; pressures and kinds go by its number."""
    m = spoken_messages(spark, sf_dir)
    context = F.collect_list("text").over(Window.partitionBy("chat_id").orderBy("date", "id").rowsBetween(-3, -1))
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.col("id") % k + 1).cast("int"))
    x = m.select("id", "text", context.alias("context"), pick(ca.PRESSURES, 4).alias("pressure"), pick(ca.KINDS, 3).alias("kind"))
    return x.select("id", *[c.alias(n) for n, c in ca.category_features(F.col("text"), F.col("context"), F.col("pressure"), F.col("kind")).items()])


_RULES = [(0, "relationship", "''", of.RELATIONS, 2, 0.8)]
_RULES += [(i, c, f"'{p}'", r, 1, k) for i, (c, p, k, r) in enumerate(of.PATTERNS[:3], 1)]
_RULES += [(4, "location", "'lives_in'", fc.LEGACY, 1, 0.7), (5, of.PATTERNS[3][0], f"'{of.PATTERNS[3][1]}'", of.PATTERNS[3][3], 1, of.PATTERNS[3][2]), (6, "preference", "''", fc.PREFERENCE, 1, 0.6)]
_CLEAN = "trim({})"
for _p in fc.TRAILING:
    _CLEAN = f"regexp_replace({_CLEAN}, {_q(_p)}, '', 'g')"
_CLEAN = f"trim({_CLEAN})"
_FOUND = " UNION ALL ".join(
    f"SELECT id, chat_id, text, {i} AS rule, unnest(range(len(regexp_extract_all(text, {_q(r)}, 0)))) AS pos, '{c}' AS category, unnest(regexp_extract_all(text, {_q(r)}, 0)) AS match, unnest(regexp_extract_all(text, {_q(r)}, {g})) AS raw, "
    + (f"lower(unnest(regexp_extract_all(text, {_q(r)}, 1)))" if i == 0 else "''")
    + f" AS value, {k}::DOUBLE AS base, {p} AS predicate FROM s"
    for i, c, p, r, g, k in _RULES
)
CHAIN = f"""
WITH s AS (SELECT * FROM (SELECT *, trim(coalesce(text, '')) AS tr FROM {SP}) WHERE NOT (length(tr) < 5 OR regexp_matches(tr, '^(Loved|Liked|Disliked|Laughed at|Emphasized|Questioned) ["“]') OR regexp_matches(tr, '^[0-9]{{4,8}}$') OR regexp_matches(tr, '^https?://\\S+$'))),
found AS ({_FOUND}),
c AS (SELECT *, CASE WHEN category = 'relationship' THEN trim(raw) ELSE {_CLEAN.format('raw')} END AS subject, CASE WHEN contains(lower(match), 'like') THEN lower(substring(text, greatest(position(match IN text) - {fc.AROUND}, 1), position(match IN text) + length(match) + {fc.AROUND} - greatest(position(match IN text) - {fc.AROUND}, 1))) END AS context FROM found),
w AS (SELECT *, lower(subject) AS low, list_filter(regexp_split_to_array(subject, '\\s+'), lambda x: x <> '') AS words FROM c),
e AS (SELECT *, CASE WHEN subject = '' THEN 'empty' WHEN category = 'preference' AND coalesce({" OR ".join(f"regexp_matches(context, {_q(p)})" for p in fc.FILLERS)}, false) THEN 'filler'
  WHEN category = 'preference' AND (regexp_matches(subject, {_q(fc.CLAUSE_STARTS)}) OR regexp_matches(subject, {_q(fc.CLAUSE_VERBS)})) THEN 'clause'
  WHEN list_contains({_list(fc.VAGUE_WORDS)}, low) OR regexp_matches(low, {_q(fc.VAGUE_START)}) THEN 'vague_pronoun' WHEN regexp_matches(low, {_q(fc.INFINITIVE)}) OR regexp_matches(low, {_q(fc.BARE)}) THEN 'incomplete'
  WHEN (len(words) > 1 AND len(list_filter(words, lambda x: length(x) <= 2 AND NOT list_contains({_list(fc.SHORT_KEPT)}, lower(x)))) / len(words) > 0.5) OR regexp_matches(subject, {_q(fc.RUN_TOGETHER)}) OR length(subject) < 2 OR NOT regexp_matches(subject, '\\p{{L}}') THEN 'malformed'
  WHEN list_contains({_list(fc.VAGUE_SUBJECTS)}, low) THEN 'vague' END AS early, CASE WHEN category = 'preference' AND len(words) < 3 THEN base * 0.7 ELSE base END AS k FROM w),
n AS (SELECT *, round(CASE WHEN len(words) >= 4 THEN least(k * 1.1, 1) ELSE k END, 4) AS confidence, row_number() OVER (PARTITION BY id, chat_id, category, low ORDER BY early IS NOT NULL, rule, pos) AS nth FROM e),
judged AS (SELECT id, chat_id, rule, pos, category, CASE WHEN category = 'relationship' THEN CASE WHEN list_contains({_list(fc.FAMILY)}, value) THEN 'is_family_of' WHEN contains(value, 'friend') THEN 'is_friend_of' ELSE 'is_associated_with' END
  WHEN category = 'preference' THEN CASE WHEN {_any('lower(match)', fc.DISLIKES)} THEN 'dislikes' ELSE 'likes' END ELSE predicate END AS predicate, subject, value, confidence,
  CASE WHEN early IS NOT NULL THEN early WHEN rule >= 4 AND nth > 1 THEN 'repeated' WHEN confidence < 0.5 THEN 'doubtful' END AS reason FROM n)"""


@query("scl17_fact_chain", CHAIN + " SELECT id, chat_id, rule, pos, category, predicate, subject, value, confidence, reason FROM judged")
def fact_chain(spark, sf_dir):
    """Every candidate with what becomes of it."""
    return fc.judged(spoken_messages(spark, sf_dir))


@query("scl17_chain_facts", CHAIN + " SELECT * EXCLUDE (reason, nth) FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, category, lower(subject), predicate ORDER BY id, rule, pos) AS nth FROM judged WHERE reason IS NULL) WHERE nth = 1")
def chain_facts(spark, sf_dir):
    return fc.facts(spoken_messages(spark, sf_dir))


@query("scl26_fact_owners", CHAIN + f""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, category, lower(subject), predicate ORDER BY id, rule, pos) AS nth FROM judged WHERE reason IS NULL) WHERE nth = 1)
SELECT f.id, f.category, f.subject, CASE WHEN regexp_matches(m.text, {_q(fc.RELATED)}) OR (f.category = 'relationship' AND regexp_matches(m.text, {_q(fc.THIRD)})) THEN 'third_party' WHEN m.is_from_me THEN 'user' ELSE 'contact' END AS owner FROM f JOIN {SP} m ON m.id = f.id""")
def fact_owners(spark, sf_dir):
    m = spoken_messages(spark, sf_dir)
    return fc.owned(fc.facts(m), m).select("id", "category", "subject", "owner")


@query("agg50_rejections", CHAIN + " SELECT chat_id, count(*) AS raw, count(*) FILTER (reason IS NULL) AS kept, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in fc.REASONS) + " FROM judged GROUP BY chat_id")
def rejections(spark, sf_dir):
    """The funnel of each chat: candidates, facts, and how many each reason took out."""
    return fc.funnel(spoken_messages(spark, sf_dir))


_E = f"(SELECT id, lag(text) OVER (PARTITION BY chat_id ORDER BY date, id) AS suggestion, text AS edited FROM {SP})"


def edits(spark, sf_dir):
    """Each message of a chat as the edited form of the one before it."""
    before = F.lag("text").over(Window.partitionBy("chat_id").orderBy("date", "id"))
    return spoken_messages(spark, sf_dir).select("id", before.alias("suggestion"), F.col("text").alias("edited")).where("suggestion IS NOT NULL")


def _tone_sql(c: str) -> dict[str, str]:
    """The parts of the tone of a column, as SQL."""
    t, low = f"coalesce({c}, '')", f"lower(coalesce({c}, ''))"
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    count = lambda s: f"(length({t}) - length(replace({t}, '{s}', '')))"
    emoji = f"len(regexp_extract_all({t}, '{to.EMOJI}'))"
    sizes = f"list_filter(list_transform(regexp_split_to_array({t}, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))), lambda n: n > 0)"
    mean = f"coalesce(list_avg({sizes}), 0)"
    casual = f"len(list_filter({words(low)}, lambda w: list_contains({_list(to.CASUAL)}, regexp_replace(w, '^[.,!?]+|[.,!?]+$', '', 'g'))))"
    formal = "(" + " + ".join(f"contains({low}, {_q(p)})::INT" for p in to.FORMAL) + f" + ({mean} > 15)::INT)"
    score = f"({formal} / ({casual} + {emoji} + {count('!')} + {formal} + 1))"
    score = f"CASE WHEN {mean} > 20 THEN least({score} + 0.2, 1) WHEN {mean} < 5 THEN greatest({score} - 0.2, 0) ELSE {score} END"
    n = f"greatest(len({sizes}), 1)"
    parts = {"formality": (score, 3, 0.5), "emoji_density": (f"{emoji} / length({t}) * 100", 3, 0), "exclamation_rate": (f"{count('!')} / {n}", 3, 0), "question_rate": (f"{count('?')} / {n}", 3, 0), "sentence_words": (mean, 2, 0), "n_casual": (casual, 0, 0)}
    return {k: f"CASE WHEN trim({t}, E' \\t\\n\\r') = '' THEN {b} ELSE round({x}, {d}) END" for k, (x, d, b) in parts.items()}


_TONE, _TONE2 = _tone_sql("edited"), _tone_sql("suggestion")
_NATURAL = "CASE WHEN len(w) = 0 THEN 0 ELSE greatest(0, least(1, 1.0 - CASE WHEN len(list_distinct(w)) / len(w) < 0.5 THEN 0.2 ELSE 0 END - least(0.3, 0.1 * len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2]))) - 0.15 * ({robotic}) - CASE WHEN len(regexp_extract_all(t, '[.,!?;:]')) / length(t) > 0.15 THEN 0.1 ELSE 0 END + CASE WHEN {short} THEN 0.1 ELSE 0 END)) END".format(
    robotic=" + ".join(f"contains(low, {_q(p)})::INT" for p in to.ROBOTIC), short=_any("low", to.CONTRACTIONS)
)


@query("scl20_tone", f"WITH m AS (SELECT id, text AS edited FROM {SP}) SELECT id, " + ", ".join(f"({x})::DOUBLE AS {k}" for k, x in _TONE.items()) + " FROM m")
def reply_tone(spark, sf_dir):
    return spoken_messages(spark, sf_dir).select("id", to.tone(F.col("text")).alias("t")).select("id", "t.*")


@query("scl20_reply_scores", f"""
WITH e AS (SELECT *, edited AS t, lower(edited) AS low FROM {_E} WHERE suggestion IS NOT NULL), x AS (SELECT *, list_filter(regexp_split_to_array(low, '\\s+'), lambda v: v <> '') AS w, """ + ", ".join(f"({_TONE[k]})::DOUBLE AS a_{k}, ({_TONE2[k]})::DOUBLE AS b_{k}" for k in ("formality", "emoji_density", "exclamation_rate", "sentence_words")) + f""" FROM e),
m AS (SELECT m.chat_id, m.id, count(length(u.text)) AS n, avg(length(u.text)) AS mean, stddev_samp(length(u.text)) AS dev FROM {SP} m LEFT JOIN (SELECT * FROM {SP} WHERE is_from_me AND trim(text) <> '') u USING (chat_id) GROUP BY 1, 2)
SELECT id, round(greatest(0, least(1, 1 - (0.4 * abs(a_formality - b_formality) + 0.2 * abs(a_emoji_density - b_emoji_density) / 10 + 0.2 * abs(a_exclamation_rate - b_exclamation_rate) + 0.2 * abs(a_sentence_words - b_sentence_words) / 30))), 6) AS tone, round({_NATURAL}, 6)::DOUBLE AS naturalness,
  round(CASE WHEN n = 0 THEN CASE WHEN length(t) < 10 THEN 0.5 WHEN length(t) <= 200 THEN 1.0 WHEN length(t) <= 500 THEN 0.8 ELSE 0.5 END ELSE exp(-0.5 * abs(length(t) - mean * 1.2) / greatest(CASE WHEN n > 1 THEN dev ELSE 50 END, 30)) END, 6) AS length FROM x JOIN m USING (id)""")
def reply_scores(spark, sf_dir):
    """Each message as a reply to the one before: how alike the tones are, how natural it is, how near its length is to that of the user's own messages in the chat."""
    m = spoken_messages(spark, sf_dir)
    own = m.where("is_from_me AND trim(text) <> ''").groupBy("chat_id").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean"), F.stddev_samp(F.length("text")).alias("dev"))
    # the tone of a message is worked out once, though it is compared with the one before and the one after
    toned = spoken_messages(spark, sf_dir, even=True).withColumn("own", to.tone(F.col("text"))).withColumn("natural", to.naturalness(F.col("text")))
    w = Window.partitionBy("chat_id").orderBy("date", "id")
    e = toned.select("id", "chat_id", F.length("text").alias("size"), "own", "natural", F.lag("own").over(w).alias("before"), F.lag("text").over(w).isNotNull().alias("replies")).where("replies").join(own, "chat_id", "left")
    length = to.length_score(F.col("size"), F.col("mean"), F.col("dev"), F.col("n"))
    return e.select("id", F.round(to.tone_similarity(F.col("own"), F.col("before")), 6).alias("tone"), F.round("natural", 6).alias("naturalness"), F.round(length, 6).alias("length"))


_SETS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
_CHANGES = """
d AS (SELECT unnest(list_filter(a, lambda w: NOT list_contains(b, w))) AS word, 1 AS gone FROM s UNION ALL SELECT unnest(list_filter(b, lambda w: NOT list_contains(a, w))), 0 FROM s),
c AS (SELECT word, sum(gone)::BIGINT AS removed, (count(*) - sum(gone))::BIGINT AS added FROM d GROUP BY 1)"""


@query("agg22_word_shift", f"WITH s AS (SELECT {_SETS.format('suggestion')} AS a, {_SETS.format('edited')} AS b FROM {_E} WHERE suggestion IS NOT NULL), {_CHANGES} SELECT * FROM c")
def word_shift(spark, sf_dir):
    return su.word_changes(su.recent(edits(spark, sf_dir), None))


@query("agg22_improvements", f"""
WITH e AS (SELECT * FROM {_E} WHERE suggestion IS NOT NULL ORDER BY id DESC LIMIT 100), s AS (SELECT {_SETS.format('suggestion')} AS a, {_SETS.format('edited')} AS b FROM e), {_CHANGES},
t AS (SELECT count(*) AS n, avg(length(edited) / length(suggestion)) AS share, avg(({_TONE2['formality']})::DOUBLE) AS before, avg(({_TONE['formality']})::DOUBLE) AS after FROM e),
r AS (SELECT word, removed AS k FROM c WHERE removed > 0 ORDER BY k DESC, word LIMIT 5), i AS (SELECT word, added AS k FROM c WHERE added > 0 ORDER BY k DESC, word LIMIT 5)
SELECT 'length' AS type, CASE WHEN share < 0.7 THEN 'Generate shorter responses' ELSE 'Generate longer, more detailed responses' END AS suggestion, 'Users typically ' || CASE WHEN share < 0.7 THEN 'shorten' ELSE 'expand' END || ' suggestions by ' || round(abs(share - 1) * 100)::INT || '%' AS detail, least(0.9, n / 20)::DOUBLE AS confidence FROM t WHERE share < 0.7 OR share > 1.3
UNION ALL SELECT 'tone', CASE WHEN after < before THEN 'Use more casual language' ELSE 'Use more formal language' END, 'Users often make responses ' || CASE WHEN after < before THEN 'less' ELSE 'more' END || ' formal', least(0.9, n / 20) FROM t WHERE abs(after - before) > 0.15
UNION ALL SELECT 'vocabulary', 'Avoid certain words/phrases', 'Frequently removed: ' || string_agg(word, ', ' ORDER BY k DESC, word), least(0.8, max(k) / 10) FROM r HAVING max(k) >= 3
UNION ALL SELECT 'vocabulary', 'Include certain words/phrases more often', 'Frequently added: ' || string_agg(word, ', ' ORDER BY k DESC, word), least(0.8, max(k) / 10) FROM i HAVING max(k) >= 3""")
def improvements(spark, sf_dir):
    """What the last hundred edits ask for."""
    return su.improvements(edits(spark, sf_dir))


def _form_sql(form: str, pattern: str, groups: tuple[int, int, int]) -> str:
    """The day that a form gives, as SQL."""
    part = lambda k: f"nullif(regexp_extract(low, {_q(pattern)}, {k}), '')"
    y, m, d = groups
    year = f"coalesce(CASE WHEN length({part(y)}) = 2 THEN '20' || {part(y)} ELSE {part(y)} END, '2024')" if y else "'2024'"
    month = part(m) if m else "'1'"
    if form in ("named", "day_first"):
        month = f"nullif(list_position({_list([x[:3] for x in da.MONTHS])}, substr({month}, 1, 3)), 0)::VARCHAR"
    return f"try_strptime({year} || '-' || {month} || '-' || {part(d)}, '%Y-%m-%d')::DATE"


_DAYS = [(f, _form_sql(f, p, g)) for f, p, g in da.FORMS]


@query("scl19_free_dates", f"WITH m AS (SELECT id, lower(text) AS low FROM {SP}), d AS (SELECT id, " + ", ".join(f"{x} AS {f}" for f, x in _DAYS) + " FROM m) SELECT id, CASE " + " ".join(f"WHEN {f} IS NOT NULL THEN '{f}'" for f, _ in _DAYS) + " END AS form, coalesce(" + ", ".join(f for f, _ in _DAYS) + ")::VARCHAR AS day FROM d")
def free_dates(spark, sf_dir):
    """The date that each message writes out, read in January 2024."""
    d = da.free_date(F.col("text"), F.lit("2024-01-03 15:00:00").cast("timestamp"))
    return spoken_messages(spark, sf_dir).select("id", d.alias("d")).select("id", "d.form", F.col("d.day").cast("string").alias("day"))


_SCORES = ", ".join(f"{{'n': {' + '.join(f'contains(low, {_q(p.lower())})::INT' for p in ps)}, 'i': {-i}, 'topic': '{t}'}}" for i, (t, ps) in enumerate(th.TOPICS.items()))
_ITEMS = "list_concat(" + ", ".join(f"regexp_extract_all(text, {_q(p)}, 1)" for p in th.ACTIONS) + ")"


def _some(patterns) -> str:
    return "regexp_matches(last, " + _q("|".join(f"(?:{p})" for p in patterns)) + ")"


@query("scl18_thread_contexts", f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY date DESC, id DESC) AS r FROM {SP}),
h AS (SELECT chat_id, string_agg(lower(text), ' ' ORDER BY date, id) FILTER (text <> '') AS low, lower(arg_max(text, (date, id))) AS last, arg_max(is_from_me, (date, id)) AS mine, flatten(list(list_filter(list_transform({_ITEMS}, lambda x: trim(x)), lambda x: length(x) > 5 AND length(x) < 100) ORDER BY date, id)) AS items FROM m WHERE r <= 10 GROUP BY 1),
x AS (SELECT *, list_max([{_SCORES}]) AS best, list_transform(items, lambda v: lower(v)) AS lows FROM h),
w AS (SELECT chat_id, count(*) AS n, arg_min(is_from_me, (date, id)) AS first, count(*) FILTER (is_from_me) / count(*) AS share FROM m GROUP BY 1)
SELECT chat_id, n, CASE WHEN best.n > 0 THEN best.topic ELSE 'unknown' END AS topic, CASE WHEN best.n >= 2 THEN least(0.9, 0.5 + best.n * 0.1) WHEN best.n = 1 THEN 0.4 ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN {_some(th.ASKS)} THEN CASE WHEN mine THEN 'awaiting_response' ELSE 'open_question' END WHEN {_some(th.ENDS)} THEN 'concluded' ELSE 'in_discussion' END AS state,
  CASE WHEN first OR share > 0.6 THEN 'initiator' WHEN share < 0.3 THEN 'responder' ELSE 'participant' END AS role, array_to_string(list_filter(items, lambda v, i: list_position(lows, lower(v)) = i)[:5], '|') AS items
FROM x JOIN w USING (chat_id)""")
def thread_contexts(spark, sf_dir):
    """Each chat as one thread."""
    return th.thread_contexts(spoken_messages(spark, sf_dir)).withColumn("items", F.array_join("items", "|"))


@query("flt15_smart_folders", f"SELECT id, (contains(lower(text), 'meeting') OR contains(lower(text), 'report')) AS work, (contains(lower(text), 'love') AND is_from_me AND chat_id > 100) AS fond FROM {SP} WHERE contains(lower(text), 'meeting') OR contains(lower(text), 'report') OR (contains(lower(text), 'love') AND is_from_me AND chat_id > 100)")
def smart_folders(spark, sf_dir):
    """Two folders, one that any and one that all of its rules must put a message into."""
    work = ops.rules([("text", "contains", "Meeting"), ("text", "contains", "report")], "any")
    fond = ops.rules([("text", "contains", "love"), ("is_from_me", "equals", True), ("chat_id", "greater_than", 100)])
    return spoken_messages(spark, sf_dir).where(work | fond).select("id", work.alias("work"), fond.alias("fond"))


_LABELS = ("Mom", "Gopal Mama", "anna-babe", "Boss", "Loveday", "uncle_bob", "Ben", "Dr. Smith", "HONEY", "Jo")
_NAMED = f"{_list(_LABELS)}[chat_id % {len(_LABELS)} + 1]"
_WORTH = {"work_hours": "CASE WHEN hour BETWEEN 9 AND 17 AND spread < 10 THEN 0.2 ELSE 0 END", "any_hour": "least(spread / 30, 1) * 0.15", "late": "CASE WHEN hour >= 20 OR hour <= 2 THEN 0.15 ELSE 0 END", "many_emoji": "least(emoji * 50, 1) * 0.15", "few_emoji": "(1 - least(emoji * 50, 1)) * 0.15", "formal": "formal * 0.15", "casual": "(1 - formal) * 0.15", "very_often": "least(often / 5, 1) * 0.1", "medium": "CASE WHEN often BETWEEN 0.5 AND 3 THEN 1 WHEN often < 0.5 THEN often / 0.5 ELSE greatest(1 - (often - 3) / 3, 0) END * 0.1", "seldom": "CASE WHEN often < 0.5 THEN 0.1 ELSE 0 END"}
_BONUS = {c: f"CASE WHEN list_has_any(regexp_split_to_array(lower(name), '[\\s\\-_]+'), {_list(ws)}) THEN 0.5 ELSE 0 END" for c, ws in rel.NAMES.items()}
_SCORED = ", ".join(
    f"{{'score': round(greatest(least(kw_{i} / greatest(n / 50, 5), 1) * 0.4 - least(anti_{i} / 5, 0.3) + {' + '.join(_WORTH[t] for t in traits)}, 0) + {_BONUS.get(c, '0')}, 9)::DOUBLE, 'o': {-i}, 'category': '{c}'}}" for i, (c, (_, _, traits)) in enumerate(rel.CATEGORIES.items())
)
_COUNTED = ", ".join(f"sum(len(regexp_extract_all(low, {_q(rel.pattern(w))}))) AS {k}_{i}" for i, (kw, anti, _) in enumerate(rel.CATEGORIES.values()) for k, w in (("kw", kw), ("anti", anti)))


@query("scl16_relationships", f"""
WITH m AS (SELECT chat_id, date + (id % 24) * INTERVAL 1 HOUR AS date, text, lower(text) AS low FROM {SP} WHERE text <> ''),
f AS (SELECT chat_id, count(*) AS n, avg(hour(date)) AS hour, var_pop(hour(date)) AS spread, sum(len(regexp_extract_all(text, '{rel.EMOJI}'))) / sum(length(text)) AS emoji, count(*) FILTER ({_any('low', rel.FORMAL)}) AS fo, count(*) FILTER ({_any('low', rel.INFORMAL)}) AS inf,
  CASE WHEN count(*) >= 2 THEN floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000.0) ELSE 1 END AS days, {_COUNTED} FROM m GROUP BY 1),
x AS (SELECT *, CASE WHEN fo + inf > 0 THEN fo / (fo + inf) ELSE 0.5 END AS formal, n / greatest(days, 1) AS often, {_NAMED} AS name FROM f), s AS (SELECT chat_id, n, list_max([{_SCORED}]) AS best FROM x)
SELECT chat_id, CASE WHEN n >= 10 THEN best.category ELSE 'unknown' END AS relationship, CASE WHEN n >= 10 THEN round(least(best.score / 0.6, 1), 2) ELSE 0 END::DOUBLE AS confidence, n FROM s""")
def relationships(spark, sf_dir):
    """Chats by their words, their hours (one for each number) and the contact's name."""
    m = spoken_messages(spark, sf_dir, even=True).withColumn("date", F.col("date") + F.make_interval(hours=(F.col("id") % 24).cast("int")))
    names = m.select("chat_id").distinct().withColumn("name", F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("chat_id") % len(_LABELS) + 1).cast("int")))
    return rel.relationships(m, names).drop("scores")


_LINES = "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, {inv}, '', 'g'), {sig}, '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10))".format(inv=_q(no.INVISIBLE), sig=_q(no.SIGNATURES))
_MASKED = f"regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(u, {_q(no.CODE_CONTEXT)}) THEN regexp_replace(u, {_q(no.CODE)}, '<CODE>', 'g') ELSE u END, {_q(no.EMAIL)}, '<EMAIL>', 'g'), {_q(no.PHONE)}, '<PHONE>', 'g'), {_q(no.HANDLE)}, '<PERSON>', 'g')"
for _kind, _p in no.CONTEXTS:
    _MASKED = f"regexp_replace({_MASKED}, {_q(_p)}, '\\1 <{_kind}>', 'g')"
for _sign, _name in no.EMOJI_TOKENS.items():
    _MASKED = f"replace({_MASKED}, '{_sign}', '<EMOJI_{_name}>')"
#: Messages with what there is to mask: an address, a number, a code, a signature, by the row's number.
_TAILS = ("", " mail {name}@Example.org or @{name}", " the code is 48213", "\nSent from my iPhone", " +1 555 123 4567", "  two   spaces\t\n\n here", " play Lions with Anna Lee")
_TAILED = f"concat(text, replace({_list(_TAILS).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}[id % {len(_TAILS)} + 1], '{{name}}', 'u' || chat_id))"


@query("scl09_masked", f"""
WITH m AS (SELECT id, {_TAILED} AS t FROM {SP}), x AS (SELECT *, {_LINES} AS u FROM m)
SELECT id, CASE WHEN regexp_matches(trim(t), {_q(no.REACTION)}) OR regexp_matches(t, {_q(no.GARBAGE)}) THEN '' ELSE trim({_MASKED}) END AS clean FROM x""")
def masked(spark, sf_dir):
    """Messages with codes, entities and emoji as placeholders."""
    tail = F.replace(F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("id") % len(_TAILS) + 1).cast("int")), F.lit("{name}"), F.concat(F.lit("u"), "chat_id"))
    t = F.concat("text", tail)
    return spoken_messages(spark, sf_dir).select("id", no.normalise(t, garbage=True, codes=True, entities=True, collapse=False, emoji_tokens=True).alias("clean"))


@query("scl09_link_domains", f"SELECT page_id, 'see <URL:' || lower(regexp_extract(url, {_q(no.DOMAIN)}, 1)) || '> now' AS clean FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/?#\\s]+\\S*$')")
def link_domains(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"(?i)^https?://[^/?#\s]+\S*$"))
    return p.select("page_id", no.url_domains(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("clean"))


@query("scl10_predicates", f"""
WITH m AS (SELECT id, text AS t, trim(lower(text)) AS low FROM {SP})
SELECT id, regexp_matches(trim(t), {_q(no.REACTION)}) AS reaction, list_contains({_list(no.ACKNOWLEDGMENTS)}, regexp_replace(low, '[.!?,;]+$', '')) OR list_contains({_list(no.ACKNOWLEDGMENTS)}, low) AS acknowledgment, regexp_matches(trim(t), '{no.EMOJI_ONLY}') AS emoji_only,
  ({" OR ".join(f"starts_with(low, '{x}')" for x in no.TOPIC_SHIFTS)}) AS new_topic, ends_with(trim(t), '?') OR list_contains({_list(no.QUESTION_WORDS)}, regexp_extract(low, '^(\\S+)', 1)) AS question, array_to_string(regexp_extract_all(t, {_q(no.TEMPORAL)}, 0), '|') AS times FROM m""")
def predicates(spark, sf_dir):
    t = F.col("text")
    return spoken_messages(spark, sf_dir).select("id", no.is_reaction(t).alias("reaction"), no.is_acknowledgment(t).alias("acknowledgment"), no.is_emoji_only(t).alias("emoji_only"), no.starts_new_topic(t).alias("new_topic"), no.is_question(t).alias("question"), F.array_join(no.temporal_refs(t), "|").alias("times"))
