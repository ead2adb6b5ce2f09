"""Text aggregates and keyword search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import small

#: Words that are no keywords of topics.
TOPIC_STOP_WORDS = (
    "i me my we our you your he she it they them the a an is are was were be been being have has had do does did will would could should can may might shall to of in for on with at by "
    "from and but or not no so if that this what which who how when where why just like get got go going know think want yeah yes ok okay oh lol haha im dont its thats too about up out one all "
    "been more some than then also back there here now well still really right good much very said"
).split()

WORDS = r"[a-z0-9]{2,}"


def word_array(text: str | Column) -> Column:
    """Runs of two or more of a-z and 0-9 in the lowered text; runs that touch other letters are left out, as word borders have it."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){WORDS}(?![\p{{L}}\p{{N}}_])"), F.lit(0))


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word of every word of the text."""
    return docs.select(key, F.explode(word_array(text)).alias("word"))


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return tokens(docs, key, text).groupBy(key, "word").agg(F.count("*").alias("tf"))


def occurrences(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def bm25(docs: DataFrame, query: str, key: str, limit: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, text: str = "text") -> DataFrame:
    """key, score of the best documents for the query's words (Okapi, k1, b; words in more than half of all documents get epsilon times the mean idf).

    One pass counts documents, their lengths and the query's words, a second scores the documents that hold one. The mean idf of all words
    is worked out only where a word of the query needs it. One row of numbers for the query's words comes to the driver.
    """
    import math
    import re

    words = list(dict.fromkeys(asked := re.findall(WORDS, query.lower())))
    d = docs.select(key, word_array(text).alias("w")).where(F.size("w") > 0)
    seen = d.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"), *[F.count_if(F.array_contains("w", x)).alias(f"d{k}") for k, x in enumerate(words)]).first()
    n = seen["n"]
    idf = {x: math.log((n - seen[f"d{k}"] + 0.5) / (seen[f"d{k}"] + 0.5)) for k, x in enumerate(words) if seen[f"d{k}"]}
    if any(v < 0 for v in idf.values()):
        # each document counts once for a word: partial counts are made before the shuffle
        df = d.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
        mean = df.agg(F.avg(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0]
        idf = {x: epsilon * mean if v < 0 else v for x, v in idf.items()}
    score = F.lit(0.0)
    for x, v in idf.items():
        tf = occurrences("w", x)
        score = score + asked.count(x) * v * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("w") / F.lit(seen["avgdl"])))
    # texts without any of the words are not cut into words
    holds = F.lit(False)
    for x in idf:
        holds = holds | F.contains(F.lower(text), F.lit(x))
    hits = docs.where(holds).select(key, word_array(text).alias("w"))
    return hits.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def topic_word_array(text: str | Column) -> Column:
    """Runs of three or more of a-z in the lowered text that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(TOPIC_STOP_WORDS))


def tfidf_keywords(docs: DataFrame, cluster: str, key: str, top: int, words: Callable[[str], Column] = word_array) -> DataFrame:
    """cluster, word, weight: the top words of each cluster by share in the cluster times ln(N / df) (ties by word)."""
    several = docs.groupBy(F.col(key).alias("several")).count().where("count > 1").select("several")
    rest = docs
    found = None
    if not several.isEmpty():
        # rows of one key are one document
        own = docs.join(small(several), F.col(key).eqNullSafe(F.col("several"))).drop("several")
        tf = own.select(cluster, key, F.explode(words("text")).alias("word")).groupBy(cluster, key, "word").agg(F.count("*").alias("tf"))
        found = tf.groupBy(cluster, "word").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        rest = docs.join(small(several), F.col(key).eqNullSafe(F.col("several")), "left_anti")
    # each document counts its words and its distinct words, which add up before they are shuffled
    one = lambda w, tf, df: F.struct(w.alias("word"), F.lit(tf).cast("long").alias("tf"), F.lit(df).cast("long").alias("df"))
    both = F.concat(F.transform("w", lambda w: one(w, 1, 0)), F.transform(F.array_distinct("w"), lambda w: one(w, 0, 1)))
    counts = rest.select(cluster, words("text").alias("w")).select(cluster, F.explode(both).alias("x")).select(cluster, "x.*").groupBy(cluster, "word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    counts = counts if found is None else counts.unionByName(found).groupBy(cluster, "word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    in_cluster = counts.select(cluster, "word", "tf")
    size = docs.groupBy(cluster).agg(F.count("*").alias("size"))
    df = counts.groupBy("word").agg(F.sum("df").alias("df"))
    n = docs.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    w = in_cluster.join(df, "word").join(size, cluster).withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    w = w.withColumn("weight", F.round(F.col("tf") / F.col("size") * F.log(F.col("n") / F.col("df")), 6))
    r = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("weight"), "word"))
    return w.withColumn("rn", r).where(F.col("rn") <= top).select(cluster, "word", "weight", "rn")


def word_frequency(messages: DataFrame, top: int, stop: list[str]) -> DataFrame:
    clean = messages.select(F.regexp_replace(F.lower("text"), r"https?://\S+", " ").alias("text"), F.lit(1).alias("k"))
    return tokens(clean, "k").where(~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def bigrams(messages: DataFrame, key: str, least: int, top: int) -> DataFrame:
    """key, phrase, n: word pairs that recur in a key's texts."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_']+"), lambda x: x != "")
    m = messages.select(key, words.alias("w")).where(F.size("w") > 1)
    pairs = m.select(key, F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("phrase"))
    g = pairs.groupBy(key, "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return g.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "phrase"))).where(F.col("rn") <= top)
