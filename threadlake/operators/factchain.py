"""Facts by rules, with every rejection told: candidates, cleaned subjects, an ordered chain of reasons, confidences, and what each step leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import junk_reason
from threadlake.operators.facts import PATTERNS, RELATIONS

# Patterns and word lists must equal the studied definitions.
LEGACY = r"\b(?:[Mm]oved?\s+to|[Ll]ive[sd]?\s+in|[Ll]iving\s+in|[Bb]ased\s+in|[Rr]elocated\s+to)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
PREFERENCE = r"(?i)\b(?:hate[sd]?|love[sd]?|can't\s+stand|allergic\s+to|obsessed\s+with|addicted\s+to|favorite\s+(?:food|thing|person|place|movie|band)\s+is|dislike[sd]?|enjoy[s]?|prefer)\s+([A-Za-z\s]+?)(?:\s+(?:and|but|or|because|when|if|since)\b|\.|\,|!|\?|$)"
FAMILY = ("sister", "brother", "mom", "mother", "dad", "father", "wife", "husband", "daughter", "son", "cousin", "aunt", "uncle", "grandma", "grandmother", "grandpa", "grandfather")
DISLIKES = ("hate", "hates", "hated", "can't stand", "allergic")
FILLERS = (
    r"(it’s|it's|that’s|that's|feels?|looks?|sounds?)\s+like\b",
    r"\blike\s+(okay|yeah|yeah?|what|so|you know|omg|lol)",
    r"(?:^|[,;])\s+like\s+",
    r"^i\s+was\s+like\b",
    r"\blike\s+(how|when|where|why|if|a\b|an?\b|the\b)",
    r"\bi\s+like\s+(just|already|really|literally|actually|basically)",
    r"\blike\s+\d",
    r"\b(not|isn't|wasn't|ain't|don't|doesn't)\s+like\b",
)
CLAUSE_STARTS = r"(?i)^(how|when|where|why|if|what|i|he|she|they|we|you)\b"
CLAUSE_VERBS = r"(?i)\b(was|were|did|gonna|going to|realized|thought|said|told|know|knew)\b"
VAGUE_WORDS = ("it", "that", "this", "them", "there", "those", "these", "what", "when", "where", "why", "how")
VAGUE_START = r"^(it|that|this|them|there)\s+(in|at|on|for|to)"
INFINITIVE = r"^to\s+\w+\s+(this|that|these|those|me|you|him|her|it)$"
BARE = r"^(in|at|on)\s+(august|spring|summer|winter|night|day|morning|afternoon)$"
RUN_TOGETHER = r"[a-z]{2,}[A-Z][a-z]+"
SHORT_KEPT = ("i", "a", "to", "of", "in", "at", "on")
VAGUE_SUBJECTS = ("me", "you", "that", "this", "it", "them", "he", "she")
TRAILING = (r"(?i)\s+(and|but|or|because|when|if|since|unless|while|though|although)$", r"(?i)\s+(is|are|was|were|be|been)$")
RELATED = r"\b[Mm]y\s+(?:sister|brother|mom|mother|dad|father|wife|husband|girlfriend|boyfriend|partner|daughter|son|cousin|aunt|uncle|[Gg]randma|[Gg]randmother|[Gg]randpa|[Gg]randfather|friend|best friend|roommate|fiancée?|boss|coworker|colleague|neighbor)\s+"
THIRD = r"(?i)\b(he|she|they|his|her|their|him|them)\b"
# End of fixed values.

#: Reasons in the order in which they are asked; repeated and doubtful come after all others.
REASONS = ("empty", "filler", "clause", "vague_pronoun", "incomplete", "malformed", "vague", "repeated", "doubtful")
AROUND = 50


def cleaned(subject: Column) -> Column:
    """Trimmed, without one trailing conjunction and then one trailing form of be."""
    out = F.trim(subject)
    for p in TRAILING:
        out = F.regexp_replace(out, p, "")
    return F.trim(out)


def candidates(messages: DataFrame) -> DataFrame:
    """id, chat_id, rule (its place), pos (the match's), category, predicate, subject (cleaned), value, base, context: what the rules find in messages(id, chat_id, text) that are no junk.

    The context is the lowered text around the first place of the match. Null and junk texts give nothing.
    """
    t = F.col("text")
    rules = [(i, c, F.lit(p), r, 1, F.lit(""), k) for i, (c, p, k, r) in enumerate(PATTERNS[:3], 1)]
    rules += [(4, "location", F.lit("lives_in"), LEGACY, 1, F.lit(""), 0.7), (5, PATTERNS[3][0], F.lit(PATTERNS[3][1]), PATTERNS[3][3], 1, F.lit(""), PATTERNS[3][2])]
    found = []

    def add(rule: int, category: str, predicate, pattern: str, group: int, value, base: float) -> None:
        all_of = lambda g: F.regexp_extract_all(t, F.lit(pattern), F.lit(g))
        kind = all_of(1) if category == "relationship" else F.transform(all_of(0), lambda x: F.lit(""))
        zipped = F.arrays_zip(all_of(0).alias("m"), all_of(group).alias("s"), kind.alias("k"))
        found.append(F.transform(zipped, lambda z, i: F.struct(F.lit(rule).alias("rule"), i.alias("pos"), F.lit(category).alias("category"), z["m"].alias("match"), z["s"].alias("subject"), F.lower(z["k"]).alias("value"), F.lit(base).alias("base"), predicate.alias("predicate"))))

    add(0, "relationship", F.lit(""), RELATIONS, 2, None, 0.8)
    for r in rules:
        add(*r)
    add(6, "preference", F.lit(""), PREFERENCE, 1, None, 0.6)
    rows = messages.where(F.col("text").isNotNull() & junk_reason("text").isNull()).select("id", "chat_id", "text", F.explode(F.concat(*found)).alias("f")).select("id", "chat_id", "text", "f.*")
    friend = F.when(F.col("value").isin(list(FAMILY)), "is_family_of").when(F.contains("value", F.lit("friend")), "is_friend_of").otherwise("is_associated_with")
    low = F.lower("match")
    dislikes = F.lit(False)
    for w in DISLIKES:
        dislikes = dislikes | F.contains(low, F.lit(w))
    predicate = F.when(F.col("category") == "relationship", friend).when(F.col("category") == "preference", F.when(dislikes, "dislikes").otherwise("likes")).otherwise(F.col("predicate"))
    start = F.expr("position(match IN text)")
    begin = F.greatest(start - AROUND, F.lit(1))
    context = F.lower(F.substring(F.col("text"), begin, start + F.length("match") + AROUND - begin))
    subject = F.when(F.col("category") == "relationship", F.trim("subject")).otherwise(cleaned(F.col("subject")))
    return rows.select("id", "chat_id", "rule", "pos", "category", predicate.alias("predicate"), subject.alias("subject"), "value", "base", F.when(F.contains(low, F.lit("like")), context).alias("context"))


def judged(messages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every candidate with confidence and reason: null for a fact, else the first of REASONS that holds.

    Preferences are asked for filler words and clauses; all for pronouns, cut phrases and malformed subjects. Short preferences lose 0.3 of their confidence, subjects of four words or more
    gain a tenth. Of a message, the older location rule, work and preferences repeat nothing that came before with the same category and subject.
    """
    s, low = F.col("subject"), F.lower("subject")
    preference = F.col("category") == "preference"
    filler = F.lit(False)
    for p in FILLERS:
        filler = filler | F.col("context").rlike(p)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    n = F.size(words)
    short = F.size(F.filter(words, lambda w: (F.length(w) <= 2) & ~F.lower(w).isin(list(SHORT_KEPT))))
    malformed = ((n > 1) & (short / n > 0.5)) | s.rlike(RUN_TOGETHER) | (F.length(s) < 2) | ~s.rlike(r"\p{L}")
    reason = (
        F.when(s == "", "empty")
        .when(preference & F.coalesce(filler, F.lit(False)), "filler")
        .when(preference & (s.rlike(CLAUSE_STARTS) | s.rlike(CLAUSE_VERBS)), "clause")
        .when(low.isin(list(VAGUE_WORDS)) | low.rlike(VAGUE_START), "vague_pronoun")
        .when(low.rlike(INFINITIVE) | low.rlike(BARE), "incomplete")
        .when(malformed, "malformed")
        .when(low.isin(list(VAGUE_SUBJECTS)), "vague")
    )
    brief = preference & (n < 3)
    confidence = F.col("base") * F.when(brief, 0.7).otherwise(1.0)
    confidence = F.round(F.when(n >= 4, F.least(confidence * 1.1, F.lit(1.0))).otherwise(confidence), 4)
    rows = candidates(messages).withColumn("early", reason).withColumn("confidence", confidence)
    # what is out already stands behind
    order = Window.partitionBy("id", "chat_id", "category", F.lower("subject")).orderBy(F.col("early").isNotNull(), "rule", "pos")
    rows = rows.withColumn("nth", F.row_number().over(order))
    why = F.when(F.col("early").isNotNull(), F.col("early")).when((F.col("rule") >= 4) & (F.col("nth") > 1), "repeated").when(F.col("confidence") < threshold, "doubtful")
    return rows.select("id", "chat_id", "rule", "pos", "category", "predicate", "subject", "value", "confidence", why.alias("reason"))


def facts(messages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The candidates without a reason; of one chat, category, lowered subject and predicate the first message's."""
    own = judged(messages, threshold).where("reason IS NULL")
    first = Window.partitionBy("chat_id", "category", F.lower("subject"), "predicate").orderBy("id", "rule", "pos")
    return own.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "reason")


def funnel(messages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """chat_id, raw, kept and a count for each of REASONS: a row for each chat that has candidates."""
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return judged(messages, threshold).groupBy("chat_id").agg(F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("kept"), *counts)


def owner(text: Column, category: Column, mine: Column) -> Column:
    """Whom a fact is about: a third party if its text names someone of the speaker's, or if it is of a relationship and speaks of others; else the speaker, user or contact. Null and empty texts: contact."""
    t = F.coalesce(text, F.lit(""))
    other = t.rlike(RELATED) | ((category == "relationship") & t.rlike(THIRD))
    return F.when(t == "", "contact").when(other, "third_party").when(F.coalesce(mine, F.lit(False)), "user").otherwise("contact")


def owned(found: DataFrame, messages: DataFrame) -> DataFrame:
    """found with the owner of each fact, by the message that it is from; one whose message is not there is the contact's."""
    m = messages.select("id", "text", "is_from_me")
    return found.join(m, "id", "left").withColumn("owner", owner(F.col("text"), F.col("category"), F.col("is_from_me"))).drop("text", "is_from_me")
