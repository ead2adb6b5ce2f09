"""Text cleaning by task: what a text is (reaction, garbage, acknowledgment, ...), placeholders for links, codes and entities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions import slang

# Phrases, patterns and profiles must equal the studied definitions.
QUOTED = ("Liked", "Loved", "Disliked", "Laughed at", "Emphasized", "Questioned", "Removed a like from", "Removed a heart from", "Removed a dislike from", "Removed a laugh from", "Removed an exclamation from")
ACKNOWLEDGMENTS = ("ok", "okay", "k", "kk", "yes", "yeah", "yep", "yup", "yea", "ya", "no", "nope", "nah", "na", "sure", "thanks", "thank you", "thx", "ty", "np", "yw", "alright", "aight", "sounds good", "got it", "gotcha", "heard", "bet", "word", "omw", "otw", "on my way", "be there soon", "see you", "bye", "later", "ttyl", "cya", "gn", "gm", "idk", "idc", "tbh", "nvm", "ight")
TOPIC_SHIFTS = ("btw", "by the way", "anyway", "anyways", "also", "oh also", "speaking of", "on another note", "random but", "unrelated", "unrelated but", "separately", "side note", "quick question", "actually", "oh wait")
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which", "whose")
EMOJI_ONLY = r"^[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F1E0}-\x{1F1FF}\s\x{200D}]+$"
SIGNATURES = r"(?is)\n--\s*\n.*$|\nSent from my iPhone.*$|\nSent from my iPad.*$|\nGet Outlook for iOS.*$|\nSent via.*$"
GARBAGE = r"(?i)__kIMFileTransferGUID|\b(verification|security)\s+code\b|\bRx\s+(is\s+)?ready\b|\b(has|have)\s+shipped\b|\btracking\s+(number|#)\b|^\d{4,6}$"
ARTIFACTS = r"(?i)zclassnamex\\$classes|NSAttributedString|NSValue"
URL_ONLY, URL = r"(?i)^https?://\S+$", r"(?i)https?://\S+"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b(?:\+?1[\s\-\.]?)?\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}\b"
HANDLE = r"@\w+"
CODE_CONTEXT, CODE = r"(?i)\b(code|otp|passcode|verification|security)\b", r"\b\d{4,8}\b"
CONTEXTS = (
    ("CITY", r"\b(in|at|to|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"),
    ("TEAM", r"\b(vs\.?|versus|against|beat|lost to|play(?:ing)?|game)\s+([A-Z][a-zA-Z]+)\b"),
    ("PERSON", r"\b(with|for|tell|ask|meet|saw|see|call)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"),
)
EMOJI_TOKENS = {"😭": "CRY", "😢": "CRY", "😂": "LAUGH", "🤣": "LAUGH", "😅": "LAUGH", "😡": "ANGRY", "😠": "ANGRY", "❤️": "LOVE", "😍": "LOVE", "🥳": "CELEBRATE", "🎉": "CELEBRATE", "🙏": "PRAY", "👍": "THUMBS_UP", "👎": "THUMBS_DOWN"}
REPEATED = r"([\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F1E0}-\x{1F1FF}])\1{2,}"
INVISIBLE = r"[\x{200B}-\x{200F}\x{FEFF}\x{00AD}\x00-\x08\x0B\x0C\x0E-\x1F]"
TEMPORAL = r"(?i)\b(?:today|tomorrow|yesterday|tonight|later|soon)\b|\b\d{1,2}:\d{2}\s*(?:am|pm)?\b|\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\b(?:this|next|last)\s+(?:week|month|weekend)\b|\bin\s+\d+\s+(?:minutes?|hours?|days?)\b|\bat\s+\d{1,2}\s*(?:am|pm|o'?clock)?\b"
#: Task: whether emoji become tokens, and the lengths that are kept.
PROFILES = {"extraction": (False, 1, 2000), "classification": (True, 1, 1000), "chunk_embedding": (True, 1, 2000), "topic_modeling": (True, 3, 1000)}
# End of fixed values.

REACTION = r'(?is)^(?:' + "|".join(QUOTED) + r')\s+["“].*["”]$'
#: An address at the start of a link, as one group.
DOMAIN = r"(?i)^https?://([^/?#\s]*)"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_reaction(text: Column) -> Column:
    return F.trim(_text(text)).rlike(REACTION)


def is_garbage(text: Column, url_only: bool = False) -> Column:
    """Alerts, codes, file names; with url_only also texts that are one link."""
    t = _text(text)
    return (t.rlike(GARBAGE) | F.trim(t).rlike(URL_ONLY)) if url_only else t.rlike(GARBAGE)


def is_acknowledgment(text: Column) -> Column:
    """A text that only says that it was heard, with or without marks behind it."""
    low = F.trim(F.lower(_text(text)))
    return low.isin(list(ACKNOWLEDGMENTS)) | F.regexp_replace(low, r"[.!?,;]+$", "").isin(list(ACKNOWLEDGMENTS))


def is_emoji_only(text: Column) -> Column:
    return F.trim(_text(text)).rlike(EMOJI_ONLY)


def starts_new_topic(text: Column) -> Column:
    low = F.trim(F.lower(_text(text)))
    out = F.lit(False)
    for marker in TOPIC_SHIFTS:
        out = out | F.startswith(low, F.lit(marker))
    return out


def is_question(text: Column) -> Column:
    t = F.trim(_text(text))
    return F.endswith(t, F.lit("?")) | F.lower(F.regexp_extract(t, r"^(\S+)", 1)).isin(list(QUESTION_WORDS))


def temporal_refs(text: Column) -> Column:
    """What a text says of time, whole, in order."""
    return F.regexp_extract_all(_text(text), F.lit(TEMPORAL), F.lit(0))


def url_domains(text: Column) -> Column:
    """Links as <URL:domain>, in lower case; one without an address is <URL>. Longer links first, as one may begin another."""
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    domain = lambda u: F.lower(F.regexp_extract(u, DOMAIN, 1))
    return F.aggregate(links, text, lambda t, u: F.replace(t, u, F.when(domain(u) == "", "<URL>").otherwise(F.concat(F.lit("<URL:"), domain(u), F.lit(">")))))


def codes_masked(text: Column) -> Column:
    """Numbers of four to eight digits as <CODE>, in texts that speak of codes."""
    return F.when(text.rlike(CODE_CONTEXT), F.regexp_replace(text, CODE, "<CODE>")).otherwise(text)


def entities_masked(text: Column) -> Column:
    """Addresses, numbers and handles, and capitalised names behind words that go before cities, teams and persons, as placeholders."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, "<EMAIL>"), PHONE, "<PHONE>"), HANDLE, "<PERSON>")
    for kind, pattern in CONTEXTS:
        t = F.regexp_replace(t, pattern, f"$1 <{kind}>")
    return t


def normalise(text: Column, garbage: bool = False, artifacts: bool = False, url_only: bool = False, domains: bool = False, codes: bool = False, entities: bool = False, collapse: bool = True, signatures: bool = True, emoji_tokens: bool = False) -> Column:
    """The cleaned text: empty for null, reactions and, as asked, garbage and artifacts; invisible signs and signatures go, white space is
    single in each line and empty lines go; then links, codes, entities and emoji become placeholders as asked. Named entities come from patterns, not from a model.
    """
    t = _text(text)
    drop = is_reaction(text)
    if garbage:
        drop = drop | is_garbage(text, url_only)
    if artifacts:
        drop = drop | t.rlike(ARTIFACTS)
    out = F.regexp_replace(t, INVISIBLE, "")
    if signatures:
        out = F.regexp_replace(out, SIGNATURES, "")
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    out = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    if domains:
        out = url_domains(out)
    if codes:
        out = codes_masked(out)
    if entities:
        out = entities_masked(out)
    if collapse:
        out = F.regexp_replace(out, REPEATED, "$1$1")
    if emoji_tokens:
        for sign, name in EMOJI_TOKENS.items():
            out = F.replace(out, F.lit(sign), F.lit(f"<EMOJI_{name}>"))
    return F.when(drop, "").otherwise(F.trim(out))


def normalise_for(text: str, task: str) -> Column:
    """A text column cleaned for a task: garbage, artifacts and lone links are empty, links and codes become placeholders, slang is written out; so are texts outside the task's lengths empty."""
    tokens, least, most = PROFILES[task]
    clean = normalise(F.col(text), garbage=True, artifacts=True, url_only=True, domains=True, codes=True, emoji_tokens=tokens)
    # as the entry of an array the clean text is worked out once
    long = F.transform(F.array(clean), lambda c: F.when(F.length(c).between(least, most), c).otherwise(""))
    return F.get(long, F.lit(0))


def written_for(df, text: str, task: str, to: str = "clean"):
    """df with the cleaned text of a task, slang written out."""
    return df.withColumn(to, normalise_for(text, task)).withColumn(to, slang.expanded(to))
