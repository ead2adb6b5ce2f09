"""What edits of suggestions say: lengths, tone, words taken out and put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.tone import tone

#: Mean shares of length beyond which edits shorten or lengthen, and the shift of formality that counts.
SHORTER, LONGER, SHIFT = 0.7, 1.3, 0.15


def _word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def recent(edits: DataFrame, last: int | None) -> DataFrame:
    """The last edits by id; edits without an edited text are none."""
    own = edits.where("coalesce(edited, '') <> ''")
    return own if last is None else own.orderBy(F.desc("id")).limit(last)


def word_changes(edits: DataFrame) -> DataFrame:
    """word, removed, added: in how many of edits(id, suggestion, edited) a word is only in the suggestion, or only in the edited text. Each edit counts once for a word."""
    a, b = _word_set(F.col("suggestion")), _word_set(F.col("edited"))
    sides = F.concat(F.transform(F.array_except(a, b), lambda w: F.struct(w.alias("word"), F.lit(1).alias("out"))), F.transform(F.array_except(b, a), lambda w: F.struct(w.alias("word"), F.lit(0).alias("out"))))
    return edits.select(F.explode(sides).alias("s")).groupBy(F.col("s.word").alias("word")).agg(F.sum("s.out").alias("removed"), (F.count("*") - F.sum("s.out")).alias("added"))


def shifts(edits: DataFrame) -> DataFrame:
    """One row: n, the mean share of length kept (1 for empty suggestions), mean formality before and after."""
    share = F.when(F.length("suggestion") > 0, F.length("edited") / F.length("suggestion")).otherwise(1.0)
    rows = edits.select(share.alias("share"), tone(F.col("suggestion"))["formality"].alias("before"), tone(F.col("edited"))["formality"].alias("after"))
    return rows.agg(F.count("*").alias("n"), F.avg("share").alias("share"), F.avg("before").alias("before"), F.avg("after").alias("after"))


def improvements(edits: DataFrame, last: int | None = 100, top: int = 5, least: int = 3) -> DataFrame:
    """type, suggestion, detail, confidence: what the last edits ask for, where they agree; no edits, no rows.

    Words are told if the most frequent one was taken out (or put in) in at least least edits; of equals the first in the alphabet.
    """
    own = recent(edits, last)
    s = shifts(own).where("n > 0")
    sure = F.least(F.lit(0.9), F.col("n") / 20)
    percent = F.format_string("%.0f", F.abs(F.col("share") - 1) * 100)
    length = F.when(F.col("share") < SHORTER, F.struct(F.lit("length").alias("type"), F.lit("Generate shorter responses").alias("suggestion"), F.concat(F.lit("Users typically shorten suggestions by "), percent, F.lit("%")).alias("detail"), sure.alias("confidence")))
    length = length.when(F.col("share") > LONGER, F.struct(F.lit("length").alias("type"), F.lit("Generate longer, more detailed responses").alias("suggestion"), F.concat(F.lit("Users typically expand suggestions by "), percent, F.lit("%")).alias("detail"), sure.alias("confidence")))
    told = lambda what, how: F.struct(F.lit("tone").alias("type"), F.lit(what).alias("suggestion"), F.lit(how).alias("detail"), sure.alias("confidence"))
    mood = F.when(F.col("after") < F.col("before") - SHIFT, told("Use more casual language", "Users often make responses less formal")).when(F.col("after") > F.col("before") + SHIFT, told("Use more formal language", "Users often make responses more formal"))
    rows = s.select(F.explode(F.filter(F.array(length, mood), lambda x: x.isNotNull())).alias("r")).select("r.*")
    words = word_changes(own)
    for side, what, how in (("removed", "Avoid certain words/phrases", "Frequently removed: "), ("added", "Include certain words/phrases more often", "Frequently added: ")):
        best = words.where(F.col(side) > 0).orderBy(F.desc(side), "word").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col(side)).alias("minus"), "word"))).alias("w"))
        most = -F.get("w", F.lit(0))["minus"]
        rows = rows.unionByName(best.where(most >= least).select(F.lit("vocabulary").alias("type"), F.lit(what).alias("suggestion"), F.concat(F.lit(how), F.array_join(F.transform("w", lambda x: x["word"]), ", ")).alias("detail"), F.least(F.lit(0.8), most / 10).alias("confidence")))
    return rows.withColumn("confidence", F.round("confidence", 6))
