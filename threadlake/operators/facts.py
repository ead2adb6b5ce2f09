"""Facts from messages: extraction, de-duplication, conflicts, matching against gold, topic segments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.operators.vectors import dot
from threadlake.session import stored

# The extraction patterns must equal the studied definitions.
NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
PATTERNS = (
    ("location", "lives_in", 0.85, r"\b(?:[Ll]ive[sd]?\s+in|[Ll]iving\s+in|[Bb]ased\s+in|[Cc]urrently\s+in)\s+" + NAME),
    ("location", "moving_to", 0.6, r"\b(?:[Mm]oving\s+to|[Rr]elocating\s+to)\s+" + NAME),
    ("location", "lived_in", 0.5, r"\b(?:[Mm]oved?\s+from|[Gg]rew\s+up\s+in|[Ww]as\s+based\s+in|[Ll]ived\s+in)\s+" + NAME),
    ("work", "works_at", 0.7, r"\b(?:work(?:s|ing|ed)?\s+(?:at|for)|job\s+(?:at|with)|started\s+(?:at|with)|joined|hired\s+(?:at|by|with)|employed\s+(?:at|by))\s+" + NAME),
)
RELATIONS = r"\b[Mm]y\s+(sister|brother|mom|mother|dad|father|wife|husband|girlfriend|boyfriend|partner|daughter|son|cousin|aunt|uncle|[Gg]randma|[Gg]randmother|[Gg]randpa|[Gg]randfather|friend|best friend|roommate|fiancée?|boss|coworker|colleague|neighbor)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(name: str) -> Callable:
    """Register a function from messages(id, chat_id, text) to facts; extract() can then be asked for it by name."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        EXTRACTORS[name] = f
        return f

    return put


@extractor("patterns")
def by_patterns(messages: DataFrame) -> DataFrame:
    """id, chat_id, category, predicate, subject, value, confidence; subjects under three letters lose 0.3 of theirs, those of four words or more gain a tenth."""
    def facts(category: str, predicate: str, base: float, pattern: str) -> Column:
        fact = lambda s: F.struct(F.lit(category).alias("category"), F.lit(predicate).alias("predicate"), s.alias("subject"), F.lit("").alias("value"), F.lit(base).alias("base"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), fact)

    found = [facts(*p) for p in PATTERNS]
    who = F.regexp_extract_all("text", F.lit(RELATIONS), F.lit(2))
    what = F.regexp_extract_all("text", F.lit(RELATIONS), F.lit(1))
    related = F.zip_with(who, what, lambda s, v: F.struct(F.lit("relationship").alias("category"), F.lit("is_family_of").alias("predicate"), s.alias("subject"), F.lower(v).alias("value"), F.lit(0.8).alias("base")))
    rows = messages.where("text IS NOT NULL").select("id", "chat_id", F.explode(F.concat(related, *found)).alias("f")).select("id", "chat_id", "f.*")
    words = F.size(F.split("subject", r"\s+"))
    conf = F.least(F.col("base") * F.when(F.length("subject") < 3, 0.7).when(words >= 4, 1.1).otherwise(1.0), F.lit(1.0))
    return rows.select("id", "chat_id", "category", "predicate", "subject", "value", F.round(conf, 4).alias("confidence"))


def extract(messages: DataFrame, name: str = "patterns", threshold: float = 0.5) -> DataFrame:
    """Facts of a registered extractor above threshold; of one chat, category, lowered subject and predicate the first message's."""
    f = EXTRACTORS[name](messages).where(F.col("confidence") >= threshold)
    w = Window.partitionBy("chat_id", "category", F.lower("subject"), "predicate").orderBy("id", "subject", "value")
    return f.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def hypothesis(category: str, subject: str, predicate: str, value: str) -> Column:
    """A sentence that states a fact."""
    p, s, v = F.replace(F.lower(predicate), F.lit("_"), F.lit(" ")), F.col(subject), F.col(value)
    return (
        F.when(F.col(category) == "relationship", F.when(v != "", F.concat(s, F.lit(" is my "), v)).otherwise(F.concat(s, F.lit(" and I are related"))))
        .when(F.col(category) == "location", F.concat(F.lit("I "), p, F.lit(" in "), s))
        .when(F.col(category) == "work", F.concat(F.lit("I work at "), s))
        .when(F.col(category) == "preference", F.concat(F.lit("I "), p, F.lit(" "), s))
        .otherwise(F.concat(s, F.lit(" "), p))
    )


#: Rows of a group that one task compares with as many others.
BLOCK = 1024


def _near_rows(facts: DataFrame, keys: list[str], order: str, threshold: float, vector: str) -> DataFrame:
    """keys, a, b: rows of a group (by order, a before b) whose dot product reaches threshold. Groups are compared block against block, so no task holds one."""
    import numpy as np

    size = Window.partitionBy(*keys)
    rows = facts.where(F.col(vector).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(vector).alias("_v"))
    rows = rows.withColumn("_parts", (F.count("*").over(size) / F.lit(BLOCK)).cast("int") + 1).withColumn("_part", F.pmod(F.xxhash64("_o"), F.col("_parts")).cast("int"))
    both = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    both = both.select(*keys, F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"), "_part", "_o", "_v")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["_part"] == pdf["_lo"].iloc[0]]
        right = left if pdf["_lo"].iloc[0] == pdf["_hi"].iloc[0] else pdf[pdf["_part"] == pdf["_hi"].iloc[0]]
        out = pd.DataFrame({k: pdf[k].iloc[:0] for k in keys} | {"a": pdf["_o"].iloc[:0], "b": pdf["_o"].iloc[:0]})
        if len(left) and len(right):
            i, j = np.nonzero(np.stack(left["_v"].to_list()).astype(float) @ np.stack(right["_v"].to_list()).astype(float).T >= threshold)
            x, y = left["_o"].to_numpy()[i], right["_o"].to_numpy()[j]
            pair = x != y if right is not left else x < y
            out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"a": np.minimum(x, y)[pair], "b": np.maximum(x, y)[pair]})
        return out

    schema = T.StructType([*(facts.schema[k] for k in keys), T.StructField("a", facts.schema[order].dataType), T.StructField("b", facts.schema[order].dataType)])
    return both.groupBy(*keys, "_lo", "_hi").applyInPandas(meet, schema)


def semantic_dedup(facts: DataFrame, keys: list[str], order: str, threshold: float = 0.85, vector: str = "embedding") -> DataFrame:
    """Greedy in order within keys: a row goes if its dot product with an accepted one reaches threshold. order is a number that no two rows of a group share.

    Near rows are found block against block. Then, in rounds, rows without an undecided earlier near row are accepted and their later
    near rows go, until all are decided: the same rows as a scan in order, as deep as the longest chain of near rows. Rows without a
    vector stay; rows with a null key are a group of their own; an empty table gives an empty result.
    """
    own = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = facts.select("*", *own)
    open_pairs = stored(_near_rows(keyed, names, order, threshold, vector), "near")
    gone = None
    while not open_pairs.isEmpty():
        waits = open_pairs.select(*names, F.col("b").alias("a")).distinct()
        first = open_pairs.join(waits, [*names, "a"], "left_anti")
        lost = stored(first.select(*names, "b").distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        kept = open_pairs.join(lost, [*names, "b"], "left_anti").join(lost.withColumnRenamed("b", "a"), [*names, "a"], "left_anti")
        # pairs whose earlier row is accepted are settled with it
        open_pairs = stored(kept, "near")
    if gone is None:
        return facts
    return keyed.join(gone.withColumnRenamed("b", order), [*names, order], "left_anti").select(facts.columns)


def conflicts(facts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """older, newer: facts (fact_id, contact_id, subject, predicate, value, embedding) of one contact that say different things of the same key, or of near ones.

    Same keys meet on the key; near ones within a contact's predicate.
    """
    a, b = facts.select([F.col(c).alias(f"a_{c}") for c in facts.columns]), facts.select([F.col(c).alias(f"b_{c}") for c in facts.columns])
    j = a.join(b, (F.col("a_contact_id") == F.col("b_contact_id")) & (F.col("a_predicate") == F.col("b_predicate")) & (F.col("a_fact_id") < F.col("b_fact_id")) & (F.col("a_value") != F.col("b_value")))
    near = (F.col("a_subject") == F.col("b_subject")) | (dot("a_embedding", "b_embedding") >= threshold)
    return j.where(near).select(F.col("a_fact_id").alias("older"), F.col("b_fact_id").alias("newer"))


def retire(facts: DataFrame, pairs: DataFrame, as_of: Column) -> DataFrame:
    """facts with the older side of each conflict at half its confidence and valid until as_of."""
    old = pairs.select(F.col("older").alias("fact_id")).distinct().withColumn("_old", F.lit(True))
    x = facts.join(old, "fact_id", "left")
    return x.withColumn("confidence", F.when(F.col("_old"), F.col("confidence") * 0.5).otherwise(F.col("confidence"))).withColumn("valid_until", F.when(F.col("_old"), as_of)).drop("_old")


def passive_feedback(sent: DataFrame, suggestions: DataFrame, minutes: int = 10, same: float = 0.98, edited: float = 0.55) -> DataFrame:
    """id, suggestion_id, action: outgoing messages against the chat's suggestions of the last minutes, by dot product; the nearest decides.

    Rows meet on chat and time slot; a message looks into its own slot and the one before, so a busy chat is dealt over slots.
    """
    slot = lambda c: F.floor(F.unix_seconds(c) / (minutes * 60))
    m = sent.select("id", "chat_id", "date", F.col("embedding").alias("v"), F.explode(F.array(slot("date"), slot("date") - 1)).alias("slot"))
    s = suggestions.select("suggestion_id", "chat_id", F.col("date").alias("made"), F.col("embedding").alias("w"), slot("date").alias("slot"))
    j = m.join(s, ["chat_id", "slot"]).where((F.col("made") <= F.col("date")) & (F.unix_seconds("date") - F.unix_seconds("made") <= minutes * 60))
    best = j.withColumn("sim", dot("v", "w")).groupBy("id").agg(F.max_by("suggestion_id", F.struct("sim", -F.col("suggestion_id"))).alias("suggestion_id"), F.max("sim").alias("sim"))
    return best.where(F.col("sim") > edited).select("id", "suggestion_id", F.when(F.col("sim") > same, "sent").otherwise("edited").alias("action"))


def match_boundaries(detected: DataFrame, gold: DataFrame, tolerance: int = 1) -> DataFrame:
    """conv_id, tp, n_detected, n_gold: boundaries matched one to one in order, at most tolerance apart."""

    def matched(detected: pa.Array, gold: pa.Array) -> pa.Array:
        out = []
        for d, g in zip(detected.to_pylist(), gold.to_pylist(), strict=True):
            i = j = tp = 0
            while i < len(d) and j < len(g):
                if abs(d[i] - g[j]) <= tolerance:
                    tp, i, j = tp + 1, i + 1, j + 1
                elif d[i] < g[j]:
                    i += 1
                else:
                    j += 1
            out.append(tp)
        return pa.array(out, pa.int64())

    both = detected.select("conv_id", F.col("pos").alias("d"), F.lit(None).cast("long").alias("g")).unionByName(gold.select("conv_id", F.lit(None).cast("long").alias("d"), F.col("pos").alias("g")))
    # conversations are short: many go to Python at once, each a row
    own = both.groupBy("conv_id").agg(F.sort_array(F.collect_list("d")).alias("d"), F.sort_array(F.collect_list("g")).alias("g"))
    return own.select("conv_id", F.arrow_udf(matched, "long")("d", "g").alias("tp"), F.size("d").cast("long").alias("n_detected"), F.size("g").cast("long").alias("n_gold"))


def match_facts(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn of exact matches one to one: the nth equal prediction meets the nth equal gold fact, by counts."""
    p, g = predicted.groupBy(*keys).agg(F.count("*").alias("p")), gold.groupBy(*keys).agg(F.count("*").alias("g"))
    j = p.join(g, keys, "full").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    return j.agg(F.sum(F.least("p", "g")).alias("tp"), F.sum(F.col("p") - F.least("p", "g")).alias("fp"), F.sum(F.col("g") - F.least("p", "g")).alias("fn"))


def topic_segments(messages: DataFrame, threshold: float = 0.35, gap_factor: float = 4.0, least_gap_hours: float = 0.25, shift_weight: float = 0.25, markers: tuple[str, ...] = ("btw", "by the way", "anyway", "speaking of", "on another note", "side note", "quick question")) -> DataFrame:
    """id, chat_id, segment of messages(id, chat_id, date, text, embedding): a segment ends where drift, new names, pause and markers add up, or at a long pause.

    The pause limit is gap_factor times the chat's median gap. A pause beyond it begins anew, so chats are cut there by windows, and
    only the stretch between two long pauses, in which what counts as new depends on the segment so far, is scanned in order.
    """
    import re

    import numpy as np

    name = re.compile(r"\b[A-Z][a-z]{2,}\b")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["date", "id"]).reset_index(drop=True)
        seg, out = 0, [0]
        texts = pdf["text"].fillna("").tolist()
        anchors = set(name.findall(texts[0]))
        for i in range(1, len(pdf)):
            a, b = np.asarray(pdf["embedding"][i - 1], float), np.asarray(pdf["embedding"][i], float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            drift = 1 - float(a @ b) / norm if norm else 1.0
            own = set(name.findall(texts[i]))
            shared = len(own & anchors) / len(own | anchors) if own and anchors else 0.0
            score = 0.4 * drift + 0.3 * (1 - shared) + (shift_weight if any(m in texts[i].lower() for m in markers) else 0.0)
            anchors |= own
            if score >= threshold + 0.3:
                seg += 1
                anchors = own
            out.append(seg)
        return pd.DataFrame({"id": pdf["id"], "chat_id": pdf["chat_id"], "stretch": pdf["stretch"], "seg": out})

    in_order = Window.partitionBy("chat_id").orderBy("date", "id")
    m = messages.select("id", "chat_id", "date", "text", "embedding").withColumn("hours", (F.unix_micros("date") - F.unix_micros(F.lag("date").over(in_order))) / F.lit(3.6e9))
    limits = m.groupBy("chat_id").agg(F.greatest(gap_factor * F.coalesce(F.percentile("hours", 0.5), F.lit(0.0)), F.lit(least_gap_hours)).alias("limit"))
    m = m.join(limits, "chat_id").withColumn("stretch", F.sum(F.when(F.col("hours") > F.col("limit"), 1).otherwise(0)).over(in_order))
    cut = stored(m.select("id", "chat_id", "date", "text", "embedding", "stretch").groupBy("chat_id", "stretch").applyInPandas(scan, "id long, chat_id long, stretch long, seg long"), "stretches")
    ends = cut.groupBy("chat_id", "stretch").agg((F.max("seg") + 1).alias("n"))
    before = ends.select("chat_id", "stretch", (F.sum("n").over(Window.partitionBy("chat_id").orderBy("stretch")) - F.col("n")).alias("before"))
    return cut.join(before, ["chat_id", "stretch"]).select("id", "chat_id", (F.col("before") + F.col("seg")).alias("segment"))


#: Embedders by name: from a text column to its vector. A model can take the place of these stand-ins.
EMBEDDERS: dict[str, Callable[..., Column]] = {}


def embedder(name: str) -> Callable:
    """Register a function from the name of a text column to a vector column; embedded() can then be asked for it by name."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        EMBEDDERS[name] = f
        return f

    return put


def embedded(df: DataFrame, name: str, text: str = "text", normalize: bool = True) -> DataFrame:
    """df with embedding from a registered embedder, of unit length if asked (empty texts stay zero)."""
    from threadlake.operators.clusters import unit

    own = df.withColumn("embedding", EMBEDDERS[name](text))
    return own.withColumn("embedding", (unit("embedding") if normalize else F.col("embedding")).cast("array<float>"))


@embedder("letters")
def letter_embedding(text: str) -> Column:
    """How often each of a to z occurs in the lowered text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])


@embedder("hash")
def hash_embedding(text: str, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words; where they are all zero, in a text that is not empty, the text counts as one word.

    Words are cut and hashed once, by Spark; Python adds the signs up for a batch at a time.
    """

    def add_up(words: pa.Array, whole: pa.Array) -> pa.Array:
        flat, at = words.flatten().to_numpy(), words.value_lengths().to_numpy()
        n = len(at)
        sums = np.bincount(np.repeat(np.arange(n) * dim, at) + (flat >> 1), weights=(flat & 1) * 2.0 - 1, minlength=n * dim).reshape(n, dim)
        one = whole.fill_null(-1).to_numpy()
        gone = np.flatnonzero(~sums.any(axis=1) & (one >= 0))
        sums[gone, one[gone] >> 1] = (one[gone] & 1) * 2.0 - 1
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype="int32") * dim, pa.array(sums.ravel().astype("float32")))

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    code = lambda w: (F.pmod(F.xxhash64(w), F.lit(dim)) * 2 + (F.xxhash64(w) > 0).cast("int")).cast("int")
    words = F.transform(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""), code)
    return F.arrow_udf(add_up, "array<float>")(words, F.when(low != "", code(low)))


def decode_attributed_body(column: str) -> Column:
    """Text of a typed stream: the string behind the NSString marker and a plus sign, one byte of length; null where there is none."""
    from pyspark.sql import types as T

    def one(data: bytes | None) -> str | None:
        at = -1 if data is None else data.find(b"NSString")
        if at < 0:
            return None
        plus = data.find(b"+", at + 8)
        if plus < 0 or plus - at - 8 >= 20 or plus + 1 >= len(data):
            return None
        text = data[plus + 2 : plus + 2 + data[plus + 1]]
        if len(text) < data[plus + 1]:
            return None
        try:
            return text.decode()
        except UnicodeDecodeError:
            return None

    def many(col: pd.Series) -> pd.Series:
        return col.map(one)

    return F.pandas_udf(many, T.StringType())(column)
