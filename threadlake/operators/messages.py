"""Filters, joins, top-k and set operations over message tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import stored


def between(date: str, after: object = None, before: object = None) -> Column:
    """after < date < before, both ends open; a missing end does not bound."""
    cond = F.lit(True)
    if after is not None:
        cond = cond & (F.col(date) > after)
    if before is not None:
        cond = cond & (F.col(date) < before)
    return cond


def contains_text(text: str, needle: str) -> Column:
    """Substring search that takes the needle literally and A-Z as a-z."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def sent_by(sender: str, name: str, mine: str = "is_from_me") -> Column:
    """Messages of a handle; 'me' stands for one's own."""
    return (F.col(sender) == name) | (F.col(mine) & F.lit(name == "me"))


def search(messages: DataFrame, needle: str, sender: str | None = None, after: object = None, before: object = None, chat: object = None, limit: int = 50) -> DataFrame:
    """Newest messages with the text; ties by id."""
    m = messages.where(contains_text("text", needle)).where(between("date", after, before))
    if sender is not None:
        m = m.where(sent_by("sender", sender))
    if chat is not None:
        m = m.where(F.col("chat_id") == chat)
    return m.orderBy(F.desc("date"), F.desc("id")).limit(limit)


def having(messages: DataFrame, attachments: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Messages with (or without) a row in attachments."""
    return messages.join(attachments.select(key).distinct(), key, "left_semi" if present else "left_anti")


def mime_category(mime: str) -> Column:
    m = F.col(mime)
    documents = ["application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/rtf", "application/rtf", "application/vnd.ms-excel"]
    return F.when(m.startswith("image/"), "images").when(m.startswith("video/"), "videos").when(m.startswith("audio/"), "audio").when(m.isin(documents), "documents").otherwise("other")


def name_lookup(chats: DataFrame, name: str, wanted: str, participants: str | None = None, digits: str | None = None, recency: str = "date") -> DataFrame:
    """The best chat for a name: exact, then substring, then participant, then seven or more digits; newest first within a pass."""
    want = wanted.lower()
    numbers = "".join(c for c in wanted if c.isdigit())
    step = F.when(F.lower(name) == want, 1).when(F.contains(F.lower(name), F.lit(want)), 2)
    if participants:
        step = step.when(F.exists(participants, lambda p: F.contains(F.lower(p), F.lit(want))), 3)
    if digits and len(numbers) >= 7:
        step = step.when(F.contains(F.regexp_replace(digits, "[^0-9]", ""), F.lit(numbers)), 4)
    return chats.withColumn("pass", step).where("pass IS NOT NULL").orderBy("pass", F.desc(recency)).limit(1)


#: Operators that a rule may use.
RULES = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "contains": lambda c, v: F.contains(F.lower(c.cast("string")), F.lit(str(v).lower())),
    "starts_with": lambda c, v: c.startswith(v),
    "greater_than": lambda c, v: c > v,
    "less_than": lambda c, v: c < v,
    "is_empty": lambda c, v: c.isNull() | (c.cast("string") == ""),
}


def rules(conditions: list[tuple[str, str, object]], match: str = "all") -> Column:
    """Smart-folder conditions (field, operator, value) folded into one condition; an empty list keeps all."""
    parts = [RULES[op](F.col(field), value) for field, op, value in conditions]
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a & b if match == "all" else a | b, parts)


def latest_per_chat(messages: DataFrame, n: int = 1, key: str = "chat_id", date: str = "date", tie: str = "id") -> DataFrame:
    """Up to n newest messages of each chat, with their rank rn; ties by id, larger first. Ranks are filtered early, before the shuffle where Spark can."""
    w = Window.partitionBy(key).orderBy(F.desc(date), F.desc(tie))
    return messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def capped_stream(messages: DataFrame, per_chat: int, total: int) -> DataFrame:
    """Newest per_chat messages of each chat, chats by their newest message, until total is reached by whole chats."""
    rows = latest_per_chat(messages, per_chat)
    chats = rows.groupBy("chat_id").agg(F.max("date").alias("newest"), F.count("*").alias("n"))
    # one row a chat, no more than are needed to fill the total
    first = chats.orderBy(F.desc("newest"), "chat_id").limit(total)
    running = F.sum("n").over(Window.orderBy(F.desc("newest"), "chat_id").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("before", F.coalesce(running, F.lit(0))).where(F.col("before") < total).select("chat_id")
    return rows.join(kept, "chat_id", "left_semi")


def around(messages: DataFrame, message_id: int, context: int) -> DataFrame:
    """The 2 * context + 1 messages nearest by id, in order of date."""
    return messages.orderBy(F.abs(F.col("id") - message_id), "id").limit(2 * context + 1).orderBy("date", "id")


def last_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the last row: what an upsert in that order leaves."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_row(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key existing lacks, one a key."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def contact_dimension(phones: DataFrame, emails: DataFrame) -> DataFrame:
    """identifier, name of both tables, identifiers normalised; phones win over emails, then the first name."""
    both = phones.select(normal_phone("identifier").alias("identifier"), "name", F.lit(0).alias("p")).unionByName(emails.select(F.lower(F.trim("identifier")).alias("identifier"), "name", F.lit(1).alias("p")))
    return first_row(both.where("identifier IS NOT NULL"), ["identifier"], ["p", "name"]).drop("p")


def normal_phone(value: str | Column) -> Column:
    """Emails pass trimmed and lower; ten digits get +1, eleven from 1 get +; a leading + keeps its digits; else digits only."""
    v = F.trim(value)
    d = F.regexp_replace(v, "[^0-9]", "")
    return F.when(v.isNull() | (v == ""), None).when(F.contains(v, F.lit("@")), F.lower(v)).when(v.startswith("+"), F.concat(F.lit("+"), d)).when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d)).otherwise(d)


def _token_sets(df: DataFrame, text: str) -> Column:
    """The distinct tokens of the lowered text, sorted and joined by blanks."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != ""))), " ")


def _rarest(sets: DataFrame, other: str, least: Column) -> DataFrame:
    """sets(u, tokens, n) by the tokens one of which each set of overlap least or more must share: tok and, as other, the other set's size.

    Sets of n and m tokens with this overlap share least / (1 + least) * (n + m) tokens, o, so the n - o + 1 first of one
    and the m - o + 1 first of the other meet, whatever the order; here rare ones come first.
    """
    sized = sets.withColumn("t", least - 1e-9).withColumn(other, F.explode(F.sequence(F.ceil(F.col("t") * F.col("n")).cast("int"), F.floor(F.col("n") / F.col("t")).cast("int"))))
    share = F.ceil(F.col("t") / (1 + F.col("t")) * (F.col("n") + F.col(other))).cast("int")
    return sized.withColumn("tok", F.explode(F.slice("tokens", F.lit(1), F.greatest(F.col("n") - share + 1, F.lit(0)))))


def fuzzy_names(people: DataFrame, contacts: DataFrame, least: float = 0.7, gap: float = 0.2) -> DataFrame:
    """person, contact_id, score: people resolved to a contact by token overlap, where the runner-up is clearly behind.

    Each distinct set of tokens is matched once. Sets meet on their rarest tokens only, as many as an overlap that counts needs: first of
    least, for the best contact, then of the best less gap, for others that come near it. So tokens that all names have make no pairs.
    """
    if not 0 < gap < least <= 1:
        raise ValueError("0 < gap < least <= 1")
    p = people.select("person", _token_sets(people, "person").alias("u")).where("u <> ''").distinct()
    c = contacts.select("contact_id", _token_sets(contacts, "name").alias("u")).where("u <> ''").distinct()
    own = c.groupBy("u").agg(F.min("contact_id").alias("contact_id"), F.least(F.count("*"), F.lit(2)).alias("held"))
    known = own.select("u", "contact_id", "held", F.lit(False).alias("asks")).unionByName(p.select("u").distinct().withColumn("asks", F.lit(True)), allowMissingColumns=True)
    words = stored(known.select("*", F.explode(F.split("u", " ")).alias("tok")), "names")
    seen = words.where("NOT asks").groupBy("tok").agg(F.count("*").alias("df"))
    sets = words.join(seen, "tok", "left").groupBy("u", "asks", "contact_id", "held").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok"))).alias("s"))
    sets = stored(sets.select("u", "asks", "contact_id", "held", F.col("s.tok").alias("tokens"), F.size("s").alias("n")), "names")
    answers = _rarest(sets.where("NOT asks"), "m", F.lit(least - gap)).select("tok", F.col("m").alias("n"), F.col("n").alias("m"), F.col("u").alias("v"), "contact_id", "held")

    def scored(asked: DataFrame, least: Column) -> DataFrame:
        pairs = _rarest(asked, "m", least).select("tok", "n", "m", "u").join(answers, ["tok", "n", "m"]).drop("tok").distinct()
        k = F.size(F.array_intersect(F.split("u", " "), F.split("v", " ")))
        return pairs.withColumn("score", k / (F.col("n") + F.col("m") - k))

    asked = sets.where("asks").select("u", "tokens", "n")
    best = scored(asked, F.lit(least)).where(F.col("score") >= least).groupBy("u").agg(F.min_by(F.struct("contact_id", "score"), F.struct(-F.col("score"), "contact_id")).alias("b"))
    best = stored(best.select("u", "b.contact_id", F.col("b.score").alias("best")), "names")
    near = scored(asked.join(best.select("u", "best"), "u"), F.col("best") - gap).join(best.select("u", "best"), "u").where(F.col("best") - F.col("score") < gap)
    alone = near.groupBy("u").agg(F.sum("held").alias("held")).where("held = 1").select("u")
    return p.join(best, "u").join(alone, "u").select("person", "contact_id", F.round("best", 6).alias("score"))

