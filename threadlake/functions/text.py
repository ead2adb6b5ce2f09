"""Scalar functions over message text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentiment lexicon, its emoji, and the pattern tables below must equal the studied definitions.
POSITIVE = {"love": 1.0, "amazing": 1.0, "awesome": 1.0, "wonderful": 1.0, "fantastic": 1.0, "excellent": 1.0, "perfect": 1.0, "beautiful": 1.0, "incredible": 1.0, "brilliant": 0.9, "great": 0.8, "good": 0.6, "nice": 0.6, "happy": 0.8, "glad": 0.7, "excited": 0.8, "thrilled": 0.9, "pleased": 0.7, "delighted": 0.9, "grateful": 0.8, "thankful": 0.8, "appreciate": 0.7, "thanks": 0.5, "thank": 0.5, "like": 0.4, "enjoy": 0.6, "fun": 0.6, "cool": 0.5, "sweet": 0.6, "cute": 0.5, "interesting": 0.4, "helpful": 0.6, "kind": 0.6, "friendly": 0.6, "welcome": 0.5, "sure": 0.3, "yes": 0.3, "okay": 0.2, "ok": 0.2, "fine": 0.2, "agreed": 0.4, "definitely": 0.5, "absolutely": 0.6, "exactly": 0.4, "congrats": 0.8, "congratulations": 0.8, "proud": 0.7, "miss": 0.5}
NEGATIVE = {"hate": -1.0, "terrible": -1.0, "horrible": -1.0, "awful": -1.0, "disgusting": -1.0, "worst": -1.0, "bad": -0.7, "sad": -0.7, "angry": -0.8, "upset": -0.7, "disappointed": -0.7, "frustrated": -0.7, "annoyed": -0.6, "annoying": -0.6, "boring": -0.5, "tired": -0.4, "sick": -0.5, "worried": -0.6, "anxious": -0.6, "stressed": -0.6, "sorry": -0.3, "unfortunately": -0.5, "problem": -0.4, "issue": -0.3, "wrong": -0.5, "mistake": -0.5, "fail": -0.6, "failed": -0.6, "no": -0.2, "not": -0.2, "never": -0.4, "cant": -0.3, "cannot": -0.3, "wont": -0.3, "dont": -0.2, "busy": -0.3, "late": -0.3, "cancel": -0.4, "cancelled": -0.4}
POSITIVE_EMOJI = "😀😁😂🤣😃😄😅😆😊😇🙂😉😌😍🥰😘😗😙😚🥲😋😛😜🤪😝🤗🤩🥳🧡💛💚💙💜🖤🤍🤎💖💗💓💕💞💘💝👍👏🙌🎉🎊✨⭐🌟💯🔥👌✅💪"
NEGATIVE_EMOJI = "😢😭😤😠😡🤬😈👿💀😰😥😓😩😫🥺😖😣😞😔😟😕🙁😬😵🤢🤮💔👎😱😨🥵🥶😳🤯"
QUESTION = (r"\?\s*$", r"(?:^|\s)(what|when|where|who|why|how|which|whose|whom)\s", r"(?:^|\s)(can|could|would|will|should|do|does|did|is|are|was|were|have|has|had)\s+(?:you|i|we|they|he|she|it)\b", r"(?:wondering|curious|asking)\s+(?:if|whether|about)", r"(?:let me know|lmk|tell me)\s+(?:if|whether|when|what)", r"(?:any idea|any thoughts|any chance)")
ACTION = (r"(?:^|\s)(please|pls|plz)\s+\w+", r"(?:^|\s)(can you|could you|would you|will you)\s+\w+", r"(?:^|\s)(need you to|want you to|need your|want your)\s+", r"(?:^|\s)(help me|help with)\s+", r"(?:^)(call|text|send|bring|get|pick up|grab|buy|check|confirm|reply|respond|answer)\s+", r"(?:send me|give me|share|forward)\s+(?:the|your|that|this)", r"(?:let me know|lmk|get back to me|reply)", r"(?:your turn|you're up|over to you|up to you|your call)")
TIME_SENSITIVE = (r"(?:^|\s)(urgent|urgently|asap|immediately|right now|right away)\b", r"(?:^|\s)(important|critical|crucial|essential|priority)\b", r"(?:by|before|until|no later than)\s+(?:today|tonight|tomorrow|\d{1,2}(?::\d{2})?)", r"(?:^|\s)(today|tonight|this morning|this afternoon|this evening)\b", r"(?:^|\s)(soon|quickly|fast)\b", r"(?:^|\s)(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", r"(?:deadline|due|expires|ends)\s+", r"(?:running out|last chance|final|closing)", r"what time|when (?:can|should|will|do)")
URGENT = ("urgent", "asap", "emergency", "important", "critical", "immediately", "help", "sos", "911", "need", "must", "hurry")
TAPBACKS = {2000: "love", 2001: "like", 2002: "dislike", 2003: "laugh", 2004: "emphasize", 2005: "question", 3000: "removed_love", 3001: "removed_like", 3002: "removed_dislike", 3003: "removed_laugh", 3004: "removed_emphasize", 3005: "removed_question"}
APPLE_EPOCH_MICROS = 978307200000000


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for each row: as the one entry of an array, where else each mention of it is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apple_timestamp(nanos: str) -> Column:
    """Nanoseconds since 2001-01-01 UTC to a timestamp; null counts as 0, fractions under a microsecond go."""
    n = F.coalesce(F.col(nanos).cast("long"), F.lit(0).cast("long"))
    # whole-number division: doubles lose microseconds of values this large
    micros = F.call_function("div", n - F.pmod(n, F.lit(1000)), F.lit(1000))
    return F.timestamp_micros(micros + F.lit(APPLE_EPOCH_MICROS))


def to_apple(ts: str) -> Column:
    return (F.unix_micros(ts) - F.lit(APPLE_EPOCH_MICROS)) * 1000


def tapback(code: str) -> Column:
    """Name of a reaction code; others are null."""
    return F.create_map(*[F.lit(x) for pair in TAPBACKS.items() for x in pair])[F.col(code)]


def lexicon_tokens(text: str | Column) -> Column:
    """Lowered words without apostrophes; what holds other signs or letters is in no lexicon and needs no filter."""
    return F.split(F.replace(F.lower(text), F.lit("'"), F.lit("")), r"[^\p{L}\p{N}_]+")


def _emoji(text: str | Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def sentiment_parts(text: str) -> Column:
    """struct(pos, neg, n_pos, n_neg): weights and counts of lexicon words and emoji."""
    words = lexicon_tokens(text)
    weight = F.create_map(*[F.lit(x) for pair in {**NEGATIVE, **POSITIVE}.items() for x in pair])
    # a hashed set picks the few lexicon words; only these are looked up in the map, which is searched in order
    w = F.transform(F.filter(words, lambda x: x.isin([*NEGATIVE, *POSITIVE])), lambda x: weight[x])
    pos, neg = F.filter(w, lambda x: x > 0), F.filter(w, lambda x: x < 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ep, en = _emoji(F.col(text), POSITIVE_EMOJI), _emoji(F.col(text), NEGATIVE_EMOJI)
    return F.struct((total(pos) + 0.5 * ep).alias("pos"), (0.5 * en - total(neg)).alias("neg"), (F.size(pos) + ep).alias("n_pos"), (F.size(neg) + en).alias("n_neg"))


def sentiment_score(parts: Column) -> Column:
    """(pos - neg) / (pos + neg + 1), to three places; 0 without any signal."""
    p, n = parts["pos"], parts["neg"]
    return F.coalesce(F.round((p - n) / (p + n + 1), 3), F.lit(0.0))


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.3, "positive").when(score <= -0.3, "negative").otherwise("neutral")


def boosted_sums(text: str, positive: list[str], negative: list[str], intensifiers: list[str], boost: float = 1.5) -> Column:
    """struct(p, n) of whitespace tokens: each listed token counts 1, boost right behind an intensifier; null for a text without tokens.

    White space and lower case are DuckDB's: a vertical tab is part of a word, and a capital dotted I becomes a plain i.
    """
    toks = F.filter(F.split(F.lower(F.replace(F.col(text), F.lit("\u0130"), F.lit("i"))), r"[\t\n\f\r ]+"), lambda x: x != "")
    weight = lambda b: F.when(b.isin(intensifiers), boost).otherwise(1.0)
    # listed tokens with their weights; all others are left out
    listed = lambda t: F.filter(F.transform(t, lambda x, i: F.when(x.isin([*positive, *negative]), F.struct(x.alias("t"), weight(F.when(i > 0, F.get(t, i - 1)).otherwise("")).alias("w")))), lambda x: x.isNotNull())
    total = lambda pairs, words: F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.when(x["t"].isin(words), x["w"]).otherwise(0.0))
    sums = lambda pairs: F.struct(total(pairs, positive).alias("p"), total(pairs, negative).alias("n"))
    # as the one entry of an array each step is worked out once, not wherever it is used
    return once(toks, lambda t: F.when(F.size(t) > 0, once(listed(t), sums)))


def polarity(p: Column, n: Column) -> Column:
    """(p - n) / (p + n); 0 without any listed token."""
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def boosted_polarity(text: str, positive: list[str], negative: list[str], intensifiers: list[str], boost: float = 1.5) -> Column:
    """Polarity of a text's boosted_sums."""
    return once(boosted_sums(text, positive, negative, intensifiers, boost), lambda s: polarity(s["p"], s["n"]))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found; one alternation, so that the text is scanned once."""
    return text.rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def priority_parts(text: str) -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    urgent = F.lower(t).rlike(r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(URGENT) + r")(?:$|[^\p{L}\p{N}_])")
    return {"question": F.when(any_of(t, QUESTION), 0.9).otherwise(0.0), "action": F.when(any_of(t, ACTION), 0.9).otherwise(0.0), "time": F.when(urgent, 0.95).when(any_of(t, TIME_SENSITIVE), 0.85).otherwise(0.0)}


def priority_score(parts: dict[str, Column], contact: Column, context: Column) -> Column:
    return F.least(0.25 * parts["question"] + 0.30 * parts["action"] + 0.20 * parts["time"] + 0.15 * contact + 0.10 * context, F.lit(1.0))


def priority_level(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def junk_reason(text: str, least: int = 5) -> Column:
    """Why a text is no content: short, reaction, code, link; null for content."""
    t = F.coalesce(F.trim(text), F.lit(""))
    return F.when(F.length(t) < least, "short").when(t.rlike(r'^(Loved|Liked|Disliked|Laughed at|Emphasized|Questioned) ["“]'), "reaction").when(t.rlike(r"^[0-9]{4,8}$"), "code").when(t.rlike(r"^https?://\S+$"), "link")


def reply_confidence(pressure: Column, similarity: Column, diversity: Column, words: Column, reply: Column, incoming: Column, uncertain: list[str], rerank: Column | None = None) -> Column:
    """Confidence of a reply: by pressure, then factors for weak retrieval, rerank, narrow examples, unsure short replies, parroting."""
    c = F.when(pressure == "high", 0.85).when(pressure == "medium", 0.65).when(pressure == "low", 0.45).otherwise(0.30)
    c = F.when(similarity < 0.5, c * 0.8).otherwise(c)
    if rerank is not None:
        c = F.when(rerank > 0.7, F.least(c * 1.1, F.lit(0.95))).otherwise(c)
    c = F.when(diversity < 0.3, c * 0.9).otherwise(c)
    r, i = F.trim(F.lower(reply)), F.trim(F.lower(incoming))
    c = F.when((words < 3) & (pressure == "high") & F.lower(reply).isin(uncertain), c * 0.7).otherwise(c)
    return F.when((r != "") & (i != "") & ((r == i) | ((F.length(r) > 5) & i.startswith(r))), c * 0.5).otherwise(c)


def variant_bucket(key: Column) -> Column:
    """sha256 of key, modulo 100: hex digits folded from the left."""
    digits = F.transform(F.split(F.sha2(key, 256), ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: ((a * 16 + d) % 100).cast("int"))


def bytes_text(n: str) -> Column:
    """A byte count in the largest unit that it fills, one decimal."""
    c = F.col(n).cast("double")
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1048576, F.format_string("%.1f KB", c / 1024)).when(c < 1073741824, F.format_string("%.1f MB", c / 1048576)).otherwise(F.format_string("%.1f GB", c / 1073741824))


def initials(name: str) -> Column:
    """First letters of the first two words, upper case; ? where there are none."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda x: x != "")
    return F.when(F.size(words) > 0, F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda x: F.substring(x, 1, 1)), ""))).otherwise("?")


def csv_safe(text: str) -> Column:
    """Line ends written as \\n, and a quote before what a spreadsheet would take for a formula."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n", r"\\n"), "\t", " ")
    return F.when(t.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def gate_features(text: str) -> dict[str, Column]:
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    n = F.length(t)
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda x: x != "")
    share = lambda p: F.when(n > 0, (n - F.length(F.regexp_replace(t, p, ""))) / n).otherwise(0.0)
    return {"n_chars": n, "n_words": F.size(words), "upper": share(r"\p{Lu}"), "digits": share(r"\p{Nd}"), "asks": F.contains(t, F.lit("?")), "shouts": F.contains(t, F.lit("!")), "first_person": F.arrays_overlap(F.slice(words, 1, 5), F.array(*[F.lit(w) for w in ("i", "i'm", "my", "me", "we")])), "brief": F.size(words) <= 3}


INVISIBLE = r"[\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{206F}\x{FEFF}\x{FFFC}]"
SIGNATURE = r"(?i)\s*\n\s*sent from my [^\n]*$"
REACTION = r'(?i)^\s*(Liked|Loved|Disliked|Laughed at|Emphasized|Questioned|Removed an? [a-z ]+ from)\s+["“]'


def normalised(text: str) -> Column:
    """Text for comparison: reactions become empty, invisible characters and a phone's signature go, white space is single, an emoji three times or more is twice. Null is empty; applying it twice changes nothing."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), INVISIBLE, "")
    t = F.regexp_replace(t, SIGNATURE, "")
    t = F.regexp_replace(t, r"([\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}])\1{2,}", "$1$1")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t.rlike(REACTION), "").otherwise(t)
