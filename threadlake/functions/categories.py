"""Named features of a message for category classifiers: what needs no parser, as columns of one fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns must equal the studied definitions.
ABBREVIATIONS = ("lol", "lmao", "omg", "wtf", "brb", "btw", "smh", "tbh", "imo", "idk", "ngl", "fr", "rn", "ong", "nvm", "wya", "hmu", "fyi", "asap", "dm", "irl", "fomo", "goat", "sus", "bet", "cap", "no cap")
PROFESSIONAL = ("meeting", "deadline", "project", "report", "schedule", "conference", "presentation", "budget", "client", "invoice", "proposal")
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}]"
REACTIONS = ("Laughed at", "Loved", "Liked", "Disliked", "Emphasized", "Questioned")
EMOTIONAL = ("lmao", "lol", "xd", "haha", "omg", "bruh", "rip", "lmfao", "rofl")
QUESTION_STARTERS = ("what", "why", "how", "when", "where", "who", "did", "do", "does", "can", "could", "would", "will", "should")
IMPERATIVES = ("send", "give", "take", "get", "call", "help", "come", "tell", "show", "make", "let")
BRIEF_AGREEMENTS = ("ok", "okay", "k", "yeah", "yep", "yup", "sure", "cool", "bet", "fs", "aight")
CLAUSE_AFTER_AGREEMENT = r"\b(ok|okay|sure|yeah|yep|yup|cool|bet|sounds good)\b.*\b(but|though|however|if|when|because|since|as long as|unless|after|before)\b"
IMPLICIT_REQUEST = r"\b(i need|i want|i wanna|i gotta|i have to)\b.*\b(you|your|help|know)\b"
GREETING = r"^(hey|hi|hello|yo|sup|what's up|wassup|heyy|hiya|heya)\b"
PROPOSAL = r"\b(how about|what about|should we|shall we|let's|lets|we could)\b"
TAGS = ("right?", "yeah?", "ok?", "no?", "yes?", "huh?", "eh?")
THANKS = ("thanks", "thank you", "thx", "ty", "tysm", "appreciate", "appreciated")
APOLOGY = ("sorry", "my bad", "apologize", "apologies", "oops", "whoops", "my fault")
URGENCY = ("asap", "urgent", "quick", "quickly", "hurry", "rush", "rushing", "now", "right now", "immediately")
FUTURE = ("later", "tomorrow", "tonight", "next week", "next time", "soon", "eventually")
POSITIVE_EMOJI = "😊😀😁😂🤣😃😄😆😉😍🥰😘💕💖👍👏🙌🎉🎊✨💯🔥😎🤩😇🥳💪🙏💗"
NEGATIVE_EMOJI = "😢😭😞😔😟😕🙁😣😖😫😩😤😠😡🤬💔😰😨😱😥😪🤦🤷💀😒🙄"
NEUTRAL_EMOJI = "🤔🙃😐😑🤨🧐😶👀💬👋"
GOODBYE = ("bye", "goodbye", "later", "ttyl", "talk to you later", "gotta go", "gtg", "see you", "see ya", "catch you", "peace", "cya", "l8r", "take care", "talk soon", "talk later", "goodnight", "gnight", "nite", "sleep well")
CLOSING_EMOJI = "👋✌💯✨🙏😴😊💤"
HURRIED = ("gotta run", "gtg", "g2g", "have to go", "running late", "in a hurry", "gotta jet", "about to leave")
POLITE_MODAL = r"^(can|could|would|will)\s+(you|u)\s+"
PLEASE = r"^(please\s+\w+|(\w+\s+)*please)"
CONDITIONAL = r"\b(if you (could|can|would)|when you (can|get a chance|have time)|whenever you)\b"
NEED_YOU = r"\b(i need you to|i want you to|i'd like you to|need you to|want you to)\b"
PRESSURES, KINDS = ("high", "medium", "low", "none"), ("commitment", "answer", "emotional")
# End of fixed values.

#: Names in the vector's order: the groups are structure, mobilisation, tone, context, style, reaction; error analysis and markers; closing and request.
FEATURES = (
    ["n_chars", "n_words", "n_questions", "n_exclamations", "n_emoji"]
    + [f"pressure_{p}" for p in PRESSURES]
    + [f"kind_{k}" for k in KINDS]
    + ["professional", "abbreviated", "n_context", "context_chars", "no_context", "abbreviation_share", "capital_share"]
    + ["reaction", "n_emotional", "ends_emotional", "asks_first", "orders_first", "brief_agreement", "exclaims"]
    + ["clause_after_agreement", "emotional_position", "implicit_request", "greeting", "elongated_share", "proposal"]
    + ["context_overlap", "tag_question", "thanks", "apology", "urgency", "future", "positive_emoji", "negative_emoji", "neutral_emoji"]
    + ["goodbye", "closing_emoji", "hurried", "ends_exclaiming", "polite_modal", "please", "conditional", "needs_you"]
)


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _any(lower: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases is in the text, inside words too."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(lower, F.lit(p))
    return out


def _signs(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def category_features(text: Column, context: Column, pressure: Column, kind: Column) -> dict[str, Column]:
    """FEATURES by name, as doubles, of a text, the texts before it (an array), and its pressure and kind. Null texts are empty, null contexts have no text.

    Words are what white space separates. Of the studied vector, what a syntax parser gives is left out.
    """
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    before = F.coalesce(context, F.array().cast("array<string>"))
    w = words(t)
    n = F.size(w)
    least = F.greatest(n, F.lit(1))
    lowered = F.transform(w, lambda x: F.lower(x))
    first = F.coalesce(F.get(lowered, F.lit(0)), F.lit(""))
    last = F.coalesce(F.get(lowered, n - 1), F.lit(""))
    count = lambda sign: F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))
    short = r"(?i)\b(" + "|".join(ABBREVIATIONS) + r")\b"
    n_short = _matches(t, short)
    at = F.array_position(F.transform(lowered, lambda x: x.isin(list(EMOTIONAL)).cast("int")), F.lit(1))
    recent = F.array_distinct(words(F.lower(F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2)), " "))))
    own = F.array_distinct(lowered)
    emotional = F.lit(0)
    for m in EMOTIONAL:
        emotional = emotional + ((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)).cast("int")
    chars = F.aggregate(before, F.lit(0), lambda s, x: s + F.length(x))
    elongated = _matches(t, r"(\w)\1{2,}")
    f: dict[str, Column] = {"n_chars": F.length(t), "n_words": n, "n_questions": count("?"), "n_exclamations": count("!"), "n_emoji": _matches(t, EMOJI)}
    f |= {f"pressure_{p}": F.coalesce(pressure, F.lit("none")) == p for p in PRESSURES} | {f"kind_{k}": F.coalesce(kind, F.lit("answer")) == k for k in KINDS}
    f |= {"professional": t.rlike(r"(?i)\b(" + "|".join(PROFESSIONAL) + r")\b"), "abbreviated": n_short > 0}
    f |= {"n_context": F.size(before), "context_chars": F.when(F.size(before) > 0, chars / F.size(before)).otherwise(0.0), "no_context": F.size(before) == 0}
    # a capital has another lower form
    capital = F.size(F.filter(F.slice(w, F.lit(2), F.greatest(n, F.lit(1))), lambda x: F.substring(x, 1, 1) != F.lower(F.substring(x, 1, 1))))
    f |= {"abbreviation_share": n_short / least, "capital_share": F.when(n > 1, capital / F.greatest(n - 1, F.lit(1))).otherwise(0.0)}
    begins = F.lit(False)
    for r in REACTIONS:
        begins = begins | F.startswith(t, F.lit(r))
    f |= {"reaction": begins, "n_emotional": emotional, "ends_emotional": last.isin(list(EMOTIONAL)), "asks_first": first.isin(list(QUESTION_STARTERS)), "orders_first": first.isin(list(IMPERATIVES))}
    f |= {"brief_agreement": (n <= 3) & F.exists(lowered, lambda x: x.isin(list(BRIEF_AGREEMENTS))), "exclaims": (F.endswith(t, F.lit("!")) | ((F.upper(t) == t) & (low != t))) & (n <= 5)}
    f |= {"clause_after_agreement": low.rlike(CLAUSE_AFTER_AGREEMENT), "emotional_position": F.when(at > 0, (at - 1) / least).otherwise(1.0), "implicit_request": low.rlike(IMPLICIT_REQUEST)}
    f |= {"greeting": low.rlike(GREETING), "elongated_share": elongated / least, "proposal": low.rlike(PROPOSAL)}
    f |= {"context_overlap": F.when(F.size(own) > 0, F.size(F.array_intersect(own, recent)) / F.size(own)).otherwise(0.0)}
    ending = F.array_join(F.slice(lowered, F.greatest(n - 2, F.lit(1)), F.lit(3)), " ")
    f |= {"tag_question": F.endswith(t, F.lit("?")) & _any(ending, TAGS), "thanks": _any(low, THANKS), "apology": _any(low, APOLOGY), "urgency": _any(low, URGENCY), "future": _any(low, FUTURE)}
    f |= {"positive_emoji": _signs(t, POSITIVE_EMOJI), "negative_emoji": _signs(t, NEGATIVE_EMOJI), "neutral_emoji": _signs(t, NEUTRAL_EMOJI)}
    f |= {"goodbye": _any(low, GOODBYE), "closing_emoji": _signs(t, CLOSING_EMOJI) > 0, "hurried": _any(low, HURRIED), "ends_exclaiming": F.endswith(F.rtrim(t), F.lit("!"))}
    f |= {"polite_modal": low.rlike(POLITE_MODAL), "please": low.rlike(PLEASE), "conditional": low.rlike(CONDITIONAL), "needs_you": low.rlike(NEED_YOU)}
    return {name: f[name].cast("double") for name in FEATURES}


def category_vector(text: Column, context: Column, pressure: Column, kind: Column) -> Column:
    """The features as one array of len(FEATURES) doubles, in their order."""
    return F.array(*category_features(text, context, pressure, kind).values())
