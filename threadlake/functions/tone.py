"""Tone, naturalness and length of replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.text import once

# Word lists and ranges must equal the studied definitions.
CASUAL = ("lol", "lmao", "omg", "btw", "idk", "tbh", "imo", "ngl", "rn", "ty", "thx", "np", "pls", "plz", "u", "ur", "r", "k", "ok", "ya", "yea", "yeah", "nah", "gonna", "wanna", "gotta", "kinda", "sorta", "cuz", "bc", "tho", "nvm", "brb", "ttyl", "ily", "omw")
FORMAL = ("would you", "could you", "please", "thank you", "appreciate", "regards", "sincerely", "unfortunately", "furthermore", "however", "therefore", "additionally", "accordingly", "consequently")
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"
ROBOTIC = ("as an ai", "i cannot", "i don't have", "i apologize", "certainly!", "absolutely!", "i'd be happy to", "let me")
CONTRACTIONS = ("'m", "'re", "'ll", "'ve", "'d", "n't", "'s")
# End of fixed values.

PARTS = ("formality", "emoji_density", "exclamation_rate", "question_rate", "sentence_words", "n_casual")


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def _contained(low: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + F.contains(low, F.lit(p)).cast("int")
    return out


def tone(text: Column) -> Column:
    """struct of PARTS: formality (0 casual to 1 formal), emoji a hundred characters, marks a sentence, words a sentence, casual words. Null and blank texts are neutral, 0.5."""

    # in steps, as what one step has worked out is a value to the next and not worked out again
    def seen(t: Column) -> Column:
        low = F.lower(t)
        count = lambda sign: F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))
        casual = F.size(F.filter(_words(low), lambda w: F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", "").isin(list(CASUAL))))
        return F.struct(
            F.length(t).alias("length"),
            count("!").alias("bangs"),
            count("?").alias("questions"),
            F.size(F.regexp_extract_all(t, F.lit(EMOJI), F.lit(0))).alias("emoji"),
            F.filter(F.transform(F.split(t, "[.!?]+"), lambda s: F.size(_words(s))), lambda n: n > 0).alias("sizes"),
            casual.alias("casual"),
            _contained(low, FORMAL).alias("formal"),
            (F.size(_words(t)) == 0).alias("blank"),
        )

    def mean(g: Column) -> Column:
        return F.when(F.size(g["sizes"]) > 0, F.aggregate(g["sizes"], F.lit(0), lambda a, b: a + b) / F.size(g["sizes"])).otherwise(0.0)

    def scored(g: Column, mean: Column) -> Column:
        n = F.greatest(F.size(g["sizes"]), F.lit(1))
        formal = g["formal"] + (mean > 15).cast("int")
        score = formal / (g["casual"] + g["emoji"] + g["bangs"] + formal + 1)
        score = F.when(mean > 20, F.least(score + 0.2, F.lit(1.0))).when(mean < 5, F.greatest(score - 0.2, F.lit(0.0))).otherwise(score)
        parts = (score, g["emoji"] / g["length"] * 100, g["bangs"] / n, g["questions"] / n, mean, g["casual"].cast("double"))
        digits = (3, 3, 3, 3, 2, 0)
        rest = (0.5, 0.0, 0.0, 0.0, 0.0, 0.0)
        return F.struct(*[F.when(g["blank"], F.lit(b)).otherwise(F.round(p, d)).alias(name) for name, p, d, b in zip(PARTS, parts, digits, rest, strict=True)])

    return once(F.coalesce(text, F.lit("")), lambda t: once(seen(t), lambda g: once(mean(g), lambda m: scored(g, m))))


def tone_similarity(a: Column, b: Column) -> Column:
    """1 less 0.4 of the difference in formality and 0.2 each of emoji, exclamations and sentence length; between 0 and 1."""
    apart = lambda c, by: F.abs(a[c] - b[c]) / by
    total = 0.4 * apart("formality", 1) + 0.2 * apart("emoji_density", 10) + 0.2 * apart("exclamation_rate", 1) + 0.2 * apart("sentence_words", 30)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total))


def naturalness(text: Column) -> Column:
    """1 less what sounds made: repeated words, set phrases, many marks; a tenth more with contractions. Between 0 and 1; 0 for null and blank texts."""
    return once(F.coalesce(text, F.lit("")), lambda t: once(F.lower(t), lambda low: once(_words(low), lambda w: _natural(t, low, w))))


def _natural(t: Column, low: Column, w: Column) -> Column:
    n = F.size(w)
    again = F.size(F.filter(F.zip_with(F.slice(w, F.lit(2), F.greatest(n, F.lit(1))), F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
    marks = F.size(F.regexp_extract_all(t, F.lit("[.,!?;:]"), F.lit(0)))
    score = F.lit(1.0) - F.when(F.size(F.array_distinct(w)) / n < 0.5, 0.2).otherwise(0.0) - F.least(again * 0.1, F.lit(0.3)) - _contained(low, ROBOTIC) * 0.15
    score = score - F.when(marks / F.length(t) > 0.15, 0.1).otherwise(0.0) + F.when(_contained(low, CONTRACTIONS) > 0, 0.1).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def length_score(length: Column, mean: Column, deviation: Column, n: Column) -> Column:
    """How near a reply's length is to a fifth more than the user's mean: exp of half the difference in deviations, 30 at least (50 for one text). Without texts by ranges."""
    apart = F.abs(length - mean * 1.2) / F.greatest(F.when(n > 1, deviation).otherwise(50.0), F.lit(30.0))
    alone = F.when(length < 10, 0.5).when(length <= 200, 1.0).when(length <= 500, 0.8).otherwise(0.5)
    return F.when(F.coalesce(n, F.lit(0)) == 0, alone).otherwise(F.exp(-0.5 * apart))
