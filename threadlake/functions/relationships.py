"""What a contact is to the user: scores of categories from words, hours, emoji, formality and frequency, and from the contact's name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, their words and traits, and the names must equal the studied definitions. Of equal scores the first category counts.
CATEGORIES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "family": (
        ("mom", "dad", "mother", "father", "sister", "brother", "grandma", "grandpa", "aunt", "uncle", "cousin", "family", "love you", "miss you", "thanksgiving", "christmas", "birthday", "come home", "dinner at home", "parents", "son", "daughter", "kid", "kids"),
        ("meeting", "deadline", "project", "sprint", "standup"),
        ("any_hour", "many_emoji", "medium"),
    ),
    "close friend": (
        ("dude", "bro", "lol", "lmao", "haha", "omg", "hangout", "drinks", "party", "weekend", "chill", "wanna", "gonna", "miss you", "bestie", "squad", "crew", "yo", "bruh", "bar", "club", "concert", "game", "watch the game"),
        ("deadline", "sprint", "standup", "sync", "meeting"),
        ("casual", "late", "many_emoji"),
    ),
    "romantic partner": (
        ("love you", "miss you so much", "baby", "babe", "honey", "sweetheart", "date night", "can't wait to see you", "thinking of you", "good morning", "good night", "sleep well", "dream of me", "❤️", "😘", "💕", "💗", "💞", "xoxo", "kisses"),
        (),
        ("very_often", "any_hour", "many_emoji"),
    ),
    "coworker": (
        ("meeting", "deadline", "project", "office", "presentation", "client", "slack", "zoom", "standup", "sprint", "manager", "boss", "team", "eod", "eow", "fyi", "asap", "sync", "review", "pr", "merge", "deploy"),
        ("love you", "miss you", "party", "drinks", "hangout"),
        ("work_hours", "formal", "few_emoji"),
    ),
    "acquaintance": (("long time", "nice to meet", "good seeing you", "let's catch up"), (), ("seldom", "formal")),
}
NAMES = {
    "family": ("mom", "dad", "mother", "father", "mama", "papa", "sis", "bro", "brother", "sister", "grandma", "grandpa", "grandmother", "grandfather", "aunt", "uncle", "cousin", "wife", "husband", "nana", "nani", "dadi", "dada", "masi", "mausi", "chacha", "bua", "taya"),
    "romantic partner": ("babe", "baby", "bae", "love", "honey", "sweetheart", "hubby", "wifey"),
}
FORMAL, INFORMAL = ("please", "thank you", "regards", "sincerely"), ("lol", "lmao", "haha", "omg", "u ", " ur ", "gonna", "wanna")
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F000}-\x{1F02F}]"
# End of fixed values.


def pattern(words: tuple[str, ...]) -> str:
    """One alternation of words between borders and of emoji as they are; matches nothing without words."""
    parts = [re.escape(w) if re.search("[\U0001f300-\U0001f9ff☀-➿]", w) else rf"\b{re.escape(w).replace(chr(92) + ' ', ' ')}\b" for w in words]
    return "|".join(parts) if parts else r"[^\s\S]"


def _quick(words: tuple[str, ...]) -> str:
    """Matches as pattern(words) does, but looks for words only where one can begin."""
    plain = [w for w in words if not re.search("[\U0001f300-\U0001f9ff☀-➿]", w)]
    signs = [re.escape(w) for w in words if w not in plain]
    firsts = "".join(sorted({w[0] for w in plain}))
    own = [rf"\b(?=[{firsts}])(?:{'|'.join(re.escape(w).replace(chr(92) + ' ', ' ') for w in plain)})\b"] if plain else []
    return "|".join(own + signs) if words else pattern(words)


def _contains(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def features(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """chat, n, hour, spread, emoji, formal, often and the counts kw_i and anti_i of each category, of messages(chat, date, text) with text."""
    t, low = F.col("text"), F.lower("text")
    count = lambda p: F.sum(F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0))))
    words = [count(_quick(w)).alias(f"{name}_{i}") for i, (kw, anti, _) in enumerate(CATEGORIES.values()) for name, w in (("kw", kw), ("anti", anti))]
    g = messages.where("text <> ''").groupBy(chat).agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.hour("date")), F.lit(12.0)).alias("hour"),
        F.coalesce(F.var_pop(F.hour("date")), F.lit(0.0)).alias("spread"),
        (F.sum(F.size(F.regexp_extract_all(t, F.lit(EMOJI), F.lit(0)))) / F.sum(F.length(t))).alias("emoji"),
        F.count_if(_contains(low, FORMAL)).alias("formal_n"),
        F.count_if(_contains(low, INFORMAL)).alias("informal_n"),
        F.when(F.count("date") >= 2, F.floor((F.unix_micros(F.max("date")) - F.unix_micros(F.min("date"))) / 86_400_000_000.0)).otherwise(1).alias("days"),
        *words,
    )
    both = F.col("formal_n") + F.col("informal_n")
    return g.withColumn("formal", F.when(both > 0, F.col("formal_n") / both).otherwise(0.5)).withColumn("often", F.col("n") / F.greatest("days", F.lit(1)))


def _scores() -> list[Column]:
    n, hour, spread, emoji, formal, often = (F.col(c) for c in ("n", "hour", "spread", "emoji", "formal", "often"))
    one = lambda x: F.least(x, F.lit(1.0))
    out = []
    for i, (_, _, traits) in enumerate(CATEGORIES.values()):
        worth = {
            "work_hours": F.when(hour.between(9, 17) & (spread < 10), 0.2).otherwise(0.0),
            "any_hour": one(spread / 30) * 0.15,
            "late": F.when((hour >= 20) | (hour <= 2), 0.15).otherwise(0.0),
            "many_emoji": one(emoji * 50) * 0.15,
            "few_emoji": (1 - one(emoji * 50)) * 0.15,
            "formal": formal * 0.15,
            "casual": (1 - formal) * 0.15,
            "very_often": one(often / 5) * 0.1,
            "medium": F.when(often.between(0.5, 3.0), 1.0).when(often < 0.5, often / 0.5).otherwise(F.greatest(1 - (often - 3) / 3, F.lit(0.0))) * 0.1,
            "seldom": F.when(often < 0.5, 0.1).otherwise(0.0),
        }
        score = one(F.col(f"kw_{i}") / F.greatest(n / 50, F.lit(5.0))) * 0.4 - F.least(F.col(f"anti_{i}") / 5, F.lit(0.3))
        for trait in traits:
            score = score + worth[trait]
        out.append(F.greatest(score, F.lit(0.0)))
    return out


def relationships(messages: DataFrame, names: DataFrame | None = None, chat: str = "chat_id", least: int = 10) -> DataFrame:
    """chat, relationship, confidence, n, scores: the category of each chat by messages(chat, date, text) and names(chat, name).

    A name that holds a known word adds 0.5 to its category. Chats with fewer than least messages with text are unknown, without scores; chats without any are left out.
    """
    f = features(messages, chat)
    if names is not None:
        f = f.join(names.select(chat, F.lower("name").alias("name")), chat, "left")
    else:
        f = f.withColumn("name", F.lit(None).cast("string"))
    parts = F.split(F.coalesce("name", F.lit("")), r"[\s\-_]+")
    rows = []
    for i, (category, score) in enumerate(zip(CATEGORIES, _scores(), strict=True)):
        known = NAMES.get(category)
        bonus = F.when(F.exists(parts, lambda w: w.isin(list(known))), 0.5).otherwise(0.0) if known else F.lit(0.0)  # noqa: B023
        rows.append(F.struct(F.round(score + bonus, 9).alias("score"), F.lit(-i).alias("order"), F.lit(category).alias("category")))
    enough = F.col("n") >= least
    x = f.withColumn("all", F.array(*rows)).withColumn("best", F.array_max("all"))
    return x.select(
        chat,
        F.when(enough, F.col("best.category")).otherwise("unknown").alias("relationship"),
        F.when(enough, F.round(F.least(F.col("best.score") / 0.6, F.lit(1.0)), 2)).otherwise(0.0).alias("confidence"),
        "n",
        F.when(enough, F.map_from_arrays(F.array(*[F.lit(c) for c in CATEGORIES]), F.transform("all", lambda s: F.round(s["score"], 6)))).alias("scores"),
    )
