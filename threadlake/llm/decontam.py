"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are brought to templates: numbers, units behind numbers and names inside sentences become typed placeholders that
keep their values aside; case and punctuation go. Windows of WINDOW template words are hashed and joined with
those of the benchmark items. Where the matched windows have placeholders, values are lined up: a text that
repeats an item with other values must use the same value wherever the item does. Such re-parameterised
copies are told from exact ones, and matches that contradict themselves are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.session import ship, stored

WINDOW = 8
#: Matched windows of an item that make a match (all, of an item with fewer): WINDOW + LEAST - 1 words in a row, or more apart.
LEAST = 3
#: Words in a window that are not placeholders, at least.
PLAIN = 5
#: Benchmark windows and matched documents up to these counts are broadcast (under 40 bytes a row); beyond, both sides are shuffled.
MOST_SENT = 1_000_000
UNITS = "percent|mm|cm|km|m|mg|kg|g|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|inch(?:es)?|pounds?|euros?|dollars?|usd|eur|mph|kmh"

#: Steps from text to marked words; they mean the same to Java's and to RE2 expressions.
STEPS = (
    ("[¤_]+", " "),
    ("([0-9])[.,]([0-9])", "$1_$2"),
    ("([0-9])[.,]([0-9])", "$1_$2"),
    ("([0-9]) ?%", "$1 percent "),
    (rf"([0-9][0-9_]*)(?:[ -]?({UNITS})\b)?", " ¤n$1 ¤u$2 "),
    (r"([\p{Ll},;] )(\p{Lu}\p{L}+)", "$1¤p$2"),
    (r"(¤p\p{L}+ )(\p{Lu}\p{L}+)", "$1¤p$2"),
    (r"[^\p{L}\p{N}¤_]+", " "),
)


#: The first of STEPS is for these signs only, the next four for digits.
SIGNS, WITH_DIGITS = ("¤", "_"), slice(1, 5)


def _stepped(text: Column, steps: tuple) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def marked(text: Column) -> Column:
    """The text's words, lower case, one blank between; placeholders are ¤n, ¤u and ¤p with their value. Steps that cannot change a text are left out for it."""
    plain = F.when(F.contains(text, F.lit(SIGNS[0])) | F.contains(text, F.lit(SIGNS[1])), _stepped(text, STEPS[:1])).otherwise(text)
    numbered = F.when(text.rlike("[0-9]"), _stepped(plain, STEPS[WITH_DIGITS])).otherwise(plain)
    return F.trim(F.lower(_stepped(numbered, STEPS[5:])))


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    """key, typed, bare: word hashes of rows(key, marked), placeholders without their values and as nothing but their values."""
    words = rows.select(key, F.split("marked", " ").alias("words"))
    typed = F.transform("words", lambda x: F.xxhash64(F.when(x.startswith("¤"), F.substring(x, 1, 2)).otherwise(x)))
    bare = F.transform("words", lambda x: F.xxhash64(F.when(x.startswith("¤"), F.substring(x, F.lit(3), F.length(x))).otherwise(x)))
    return words.select(key, typed.alias("typed"), bare.alias("bare"))


def windows(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, window (hash), bare of every window of rows(key, marked); a window with placeholders comes twice, once by its bare words."""
    # words are hashed once, windows are hashes of slices of hashes; a filter on sizes would be pushed down and repeat the expressions
    n = F.size("typed") - (WINDOW - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n))
    cut = lambda h, i: F.slice(F.col(h), i, F.lit(WINDOW))
    typed = F.transform(at, lambda i: F.xxhash64(cut("typed", i)))
    bare = F.transform(at, lambda i: F.when(cut("typed", i) != cut("bare", i), F.xxhash64(cut("bare", i))))
    both = F.when(F.col("typed") == F.col("bare"), typed).otherwise(F.concat(typed, bare))
    found = _hashed(rows, key).select(key, n.alias("n"), F.posexplode(both).alias("p", "window")).where("window IS NOT NULL")
    return found.select(key, F.expr("CASE WHEN p < n THEN p ELSE p - n END").alias("pos"), "window", F.expr("p >= n").alias("bare"))


def _whole(items: DataFrame, rows: DataFrame) -> DataFrame | None:
    """doc_id, item_id of the rows(doc_id, marked) that hold all words of an item with fewer than WINDOW, in a row; None without such items."""
    short = _hashed(items.where("marked <> ''"), "item_id").where(F.size("bare") < WINDOW).select("item_id", F.size("bare").alias("n"), F.xxhash64("bare").alias("window"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
    if not lengths:
        return None
    size = F.size("bare")

    def runs(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(F.col("bare"), i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))

    return stored(_hashed(rows, "doc_id").select("doc_id", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("window")).join(_sent(short.drop("n")), "window").select("doc_id", "item_id").distinct(), "whole")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, n_changed, kind: every pair of a document and an item that it repeats.

    n_windows counts the item's windows that the document has, coverage is their share of all of the item's. Windows count
    that have PLAIN plain words. kind is 'exact' where all lined-up values are the item's, 'reparameterised' where each value
    of the item stands for one of the document's. Where one stands for several the pair is left out, unless LEAST
    windows match that have no placeholder ('partial'), or one copy (windows at one distance from the item's) alone has LEAST windows
    and does not contradict itself; n_slots, n_changed and kind are then that copy's. Pairs not found so far are found by bare words ('exact'): LEAST windows,
    with however few plain words, that match with their values, apart from case, and hold WINDOW + LEAST - 1 words of the item (all, of a
    shorter one). Here n_windows and coverage are of all windows; an item with fewer than WINDOW words is one window.
    Null texts and items without a word match nothing; rows with a null doc_id or item_id are left out; rows of one doc_id
    (or item_id) are taken together. Other columns are ignored. Empty tables give an empty result.
    """
    ship(docs.sparkSession)
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), marked(F.col("text").cast("string")).alias("marked")).where("item_id IS NOT NULL AND marked IS NOT NULL"), "items")
    words = items.select("item_id", F.posexplode(F.split("marked", " ")).alias("ipos", "word"))
    cut = stored(windows(items, "item_id").select("item_id", F.col("pos").alias("ipos"), "window", "bare").distinct(), "cut")
    own = cut.where("NOT bare").drop("bare")
    plain = own.join(words.select("item_id", F.col("ipos").alias("at"), (~F.col("word").startswith("¤")).cast("int").alias("plain")), "item_id").where(f"at BETWEEN ipos AND ipos + {WINDOW - 1}")
    own = stored(plain.groupBy("item_id", "ipos", "window").agg(F.sum("plain").alias("plain"), F.count("*").alias("n")).select("item_id", "ipos", "window", F.expr(f"plain >= {PLAIN}").alias("typed"), F.expr("plain = n").alias("bare"), F.expr("plain < n").alias("slotted")), "windows")
    own = own.where("typed").unionByName(cut.where("bare").withColumns({"typed": F.lit(False), "slotted": F.lit(False)}))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = texts.select("doc_id", marked(F.col("text")).alias("marked"))
    seen = windows(rows, "doc_id").withColumnRenamed("bare", "by_words")
    found = stored(seen.join(_sent(own), "window").select("doc_id", "item_id", "pos", "ipos", "slotted", F.expr("typed AND NOT by_words").alias("typed"), "bare"), "hits")
    hits = found.where("typed")
    total = own.where("typed").groupBy("item_id").agg(F.countDistinct("ipos").alias("total"))
    pairs = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("ipos").alias("n_windows"), F.countDistinct(F.when(~F.col("slotted"), F.col("ipos"))).alias("n_plain")).join(total, "item_id").where(F.col("n_windows") >= F.least(F.lit(LEAST), F.col("total")))
    pairs = stored(pairs, "pairs")
    # values line up in windows that have placeholders
    lined = hits.where("slotted").join(pairs.select("doc_id", "item_id"), ["doc_id", "item_id"]).select("doc_id", "item_id", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("k"), "pos", "ipos")
    lined = stored(lined.select("doc_id", "item_id", (F.col("pos") + F.col("k")).alias("pos"), (F.col("ipos") + F.col("k")).alias("ipos")).distinct(), "lined")
    need = stored(lined.select("doc_id").distinct(), "need")
    slots = texts.join(_sent(need), "doc_id").select("doc_id", F.posexplode(F.split(marked(F.col("text")), " ")).alias("pos", "value")).where(F.col("value").startswith("¤"))
    islots = words.where(F.col("word").startswith("¤")).select("item_id", "ipos", F.col("word").alias("ivalue"))
    values = lined.join(islots, ["item_id", "ipos"]).join(slots, ["doc_id", "pos"])
    kinds = values.groupBy("doc_id", "item_id", "ivalue").agg(F.min("value").alias("low"), F.max("value").alias("top"))
    checks = kinds.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_slots"), F.count_if(F.expr("low <> ivalue OR top <> ivalue")).alias("n_changed"), F.count_if(F.expr("low <> top")).alias("n_against"))
    checked = stored(pairs.join(checks, ["doc_id", "item_id"], "left"), "checked")
    out = checked.where(f"coalesce(n_against, 0) = 0 OR n_plain >= {LEAST}")
    out = stored(out.select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("total")).alias("coverage"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"), F.expr("CASE WHEN coalesce(n_against, 0) > 0 THEN 'partial' WHEN coalesce(n_changed, 0) = 0 THEN 'exact' ELSE 'reparameterised' END").alias("kind")), "typed")
    out = stored(out.unionByName(_by_copy(checked.where(f"n_against > 0 AND n_plain < {LEAST}").select("doc_id", "item_id", "n_windows", "total"), hits, values)), "copies")
    return out.unionByName(_by_words(items, words, own, found, out, rows))


def _by_copy(crossed: DataFrame, hits: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of the crossed pairs that have a copy, at one distance between places, which alone matches and does not contradict itself; of several an exact one, then the longest."""
    copy = ["doc_id", "item_id", "off"]
    off = (F.col("pos") - F.col("ipos")).alias("off")
    long = hits.join(crossed, ["doc_id", "item_id"]).select(*copy[:2], off, "ipos", "n_windows", "total").groupBy(*copy, "n_windows", "total").agg(F.countDistinct("ipos").alias("n")).where(F.col("n") >= F.least(F.lit(LEAST), F.col("total")))
    kinds = values.join(crossed.select("doc_id", "item_id"), ["doc_id", "item_id"]).select(*copy[:2], off, "ivalue", "value").groupBy(*copy, "ivalue").agg(F.min("value").alias("low"), F.max("value").alias("top"))
    checks = kinds.groupBy(*copy).agg(F.count("*").alias("n_slots"), F.count_if(F.expr("low <> ivalue OR top <> ivalue")).alias("n_changed"), F.count_if(F.expr("low <> top")).alias("n_against"))
    good = long.join(checks, copy, "left").fillna(0, ["n_slots", "n_changed", "n_against"]).where("n_against = 0")
    best = good.groupBy("doc_id", "item_id", "n_windows", "total").agg(F.expr("max(struct(n_changed = 0 AS same, n, -off AS off, n_slots, n_changed))").alias("best"))
    return best.select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("total")).alias("coverage"), "best.n_slots", "best.n_changed", F.expr("CASE WHEN best.same THEN 'exact' ELSE 'reparameterised' END").alias("kind"))


def _by_words(items: DataFrame, words: DataFrame, own: DataFrame, found: DataFrame, out: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the pairs, but for those in out, whose windows match by bare words."""
    alike = found.where("bare").select("doc_id", "item_id", "ipos")
    every = own.where("bare").select("item_id", "ipos")
    whole = _whole(items, rows)
    if whole is not None:
        alike = alike.unionByName(whole.withColumn("ipos", F.lit(0)))
        every = every.unionByName(whole.select("item_id", F.lit(0).alias("ipos")))
    total = every.groupBy("item_id").agg(F.countDistinct("ipos").alias("total"))
    held = words.where("word <> '¤u'").groupBy("item_id").agg(F.countDistinct("ipos").alias("held"))
    alike = alike.distinct().join(out.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    pairs = alike.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows")).join(total, "item_id").where(F.col("n_windows") >= F.least(F.lit(LEAST), F.col("total")))
    pairs = stored(pairs, "alike")
    spans = alike.join(pairs.select("doc_id", "item_id"), ["doc_id", "item_id"]).select("doc_id", "item_id", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + (WINDOW - 1))).alias("ipos")).distinct()
    sums = spans.join(words, ["item_id", "ipos"]).groupBy("doc_id", "item_id").agg(F.countDistinct(F.expr("CASE WHEN word <> '¤u' THEN ipos END")).alias("n_words"), F.countDistinct(F.expr("CASE WHEN startswith(word, '¤') THEN word END")).alias("n_slots"))
    kept = pairs.join(sums, ["doc_id", "item_id"]).join(held, "item_id").where(F.col("n_words") >= F.least(F.lit(WINDOW + LEAST - 1), F.col("held")))
    return kept.select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("total")).alias("coverage"), "n_slots", F.lit(0).cast("long").alias("n_changed"), F.lit("exact").alias("kind"))


def _sql() -> str:
    def chain(col: str) -> str:
        for pattern, to in STEPS:
            col = f"regexp_replace({col}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        return f"trim(lower({col}))"

    def base(table: str, key: str) -> str:
        return f"SELECT {key}, m, string_split(m, ' ') AS raw, string_split(regexp_replace(m, '(¤[nup])[^ ]*', '\\1', 'g'), ' ') AS w FROM (SELECT {key}, {chain('text')} AS m FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)"

    span = WINDOW - 1
    return f"""
WITH d AS ({base('documents', 'doc_id')}), i AS ({base('benchmark', 'item_id')}),
dw AS (SELECT doc_id, p - 1 AS pos, array_to_string(w[p:p + {span}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {span - 1})) AS p FROM d)),
iw AS (SELECT item_id, p - 1 AS ipos, array_to_string(w[p:p + {span}], ' ') AS win, len(list_filter(w[p:p + {span}], lambda x: NOT starts_with(x, '¤'))) AS plain
  FROM (SELECT item_id, w, unnest(range(1, len(w) - {span - 1})) AS p FROM i)),
own AS (SELECT * FROM iw WHERE plain >= {PLAIN}),
hits AS (SELECT DISTINCT doc_id, item_id, pos, ipos, plain FROM dw JOIN own USING (win)),
total AS (SELECT item_id, count(DISTINCT ipos) AS total FROM own GROUP BY 1),
pairs AS (SELECT doc_id, item_id, count(DISTINCT ipos) AS n_windows, count(DISTINCT ipos) FILTER (plain = {WINDOW}) AS n_plain FROM hits GROUP BY 1, 2),
kept AS (SELECT * FROM pairs JOIN total USING (item_id) WHERE n_windows >= least({LEAST}, total)),
lined AS (SELECT DISTINCT doc_id, item_id, pos + k AS pos, ipos + k AS ipos FROM hits JOIN kept USING (doc_id, item_id), range(0, {WINDOW}) r(k) WHERE plain < {WINDOW}),
vals AS (SELECT l.doc_id, l.item_id, i.raw[l.ipos + 1] AS ivalue, d.raw[l.pos + 1] AS value FROM lined l JOIN i USING (item_id) JOIN d ON d.doc_id = l.doc_id WHERE starts_with(i.raw[l.ipos + 1], '¤')),
kinds AS (SELECT doc_id, item_id, ivalue, min(value) AS low, max(value) AS top FROM vals GROUP BY 1, 2, 3),
checks AS (SELECT doc_id, item_id, count(*) AS n_slots, count(*) FILTER (low <> ivalue OR top <> ivalue) AS n_changed, count(*) FILTER (low <> top) AS n_against FROM kinds GROUP BY 1, 2)
SELECT k.doc_id, k.item_id, k.n_windows, k.n_windows / k.total AS coverage, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed,
  CASE WHEN coalesce(n_against, 0) > 0 THEN 'partial' WHEN coalesce(n_changed, 0) = 0 THEN 'exact' ELSE 'reparameterised' END AS kind
FROM kept k LEFT JOIN checks c USING (doc_id, item_id) WHERE coalesce(n_against, 0) = 0 OR n_plain >= {LEAST}
"""


SQL = _sql()
