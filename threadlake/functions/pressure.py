"""Response pressure of a message: features as conditions, then ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.text import once

# Word and pattern tables must equal the studied definitions. Patterns read the lowered text.
WH = ("what", "where", "when", "who", "why", "how", "which", "whose")
AUX = ("do", "does", "did", "can", "could", "will", "would", "should", "shall", "is", "are", "was", "were", "have", "has", "had")
SUBJECTS = ("you", "u", "ya", "i", "we", "they", "he", "she", "it")
IMPERATIVES = ("send", "give", "take", "get", "call", "help", "come", "tell", "show", "make", "let", "bring", "grab", "pick", "text", "email", "check", "look", "go", "put", "find", "buy", "read", "watch", "meet", "try", "open")
SPEAKER = (r"^i wonder\b", r"^i'?m (wondering|curious)\b", r"^(kinda?|kind of|sort of) curious\b", r"^curious (how|what|if|whether)\b", r"^wonder (if|what|how|why|whether)\b", r"^i (think|guess|suppose|assume|imagine|bet)\b", r"^i (don'?t think|doubt)\b", r"^(maybe|perhaps|probably)\b")
RECIPIENT = (r"^(do|does|did|can|could|will|would|should) (you|u|ya)\b", r"^(are|is|were|was) (you|u|ya)\b", r"^(have|has) (you|u|ya)\b", r"^(you|u|ya) (free|available|busy|down|coming|going)\b", r"^do (you|u|ya) (know|think|want|need|have)\b")
COMMITMENT = (r"^(are|is) (you|u|ya) (coming|going|in|down|free|busy|available)\b",)
REQUEST = (r"^(wanna|down)\??$", r"^(can|could|would|will) (you|u|ya)\s+\w+", r"^(wanna|want to|down to|tryna)\s+", r"^(let'?s|lets)\s+", r"^(let me know|lmk)\b", r"^(text|call|send|tell|show|give|bring|get|grab|pick) me\b", r"\b(pick (me|us) up|give (me|us) a ride)\b", r"^(want me to|should i|shall i|can i)\b", r"^(anyone|anybody|any of y'?all|y'?all) (wanna|want to|down to)\b")
NEGATED = (r"^(do not|don't|dont)\s+(text|call|ping|message|dm)\s+me\b",)
INFO = (r"^(wya|wyd|hbu)\b", r"^what about (you|u)\b", r"^thoughts\??$", r"^what (time|day|is|are|was|were|did|does|do|happened)\b", r"^where (is|are|did|do|does|should|can|were|was|you|u|ya)\b", r"^when (is|are|did|do|does|should|can|will)\b", r"^who (is|are|did|was|were|does|do)\b", r"^how (much|many|long|far|often|do|did|does|is|are|can|should)\b", r"^which (one|is|are|do|does|did|should)\b")
SLANG = (r"^wya\??$", r"^wyd\??$", r"^hbu\??$", r"^thoughts\??$", r"^(you|u|ya) free\??$", r"^what about (you|u)\??$", r"^how about (you|u)\??$")
REACTIVE = (r"!!+", r"^(omg|oh my god|omfg|wow|whoa|yay|ugh|damn|shit|holy|wtf)\b", r"^i (got|just got|finally got) (the|a|an|my)\b", r"^(we|they|i) (won|lost|passed|failed|made it)\b", r"\b(i'?m so|that'?s so|so happy|so sad|so sorry|so excited)\b", r"\b(can'?t believe|love you|miss you|hate this)\b", r"^(congrats|congratulations)\b", r"\b(this sucks|that sucks|sucks that)\b", r"(😍|😭|🥳|😱|🎉|❤️|💕|🥰|😢){2,}")
OPINION = (r"^no (way|chance)\s+\w+", r"^(i don'?t think|doubt|not sure)\b", r"^(i think|i guess|i feel like|i bet)\b", r"^(probably|maybe|might be)\b")
TELLING = (r"^i (went|did|got|saw|had|made|took|came|finished|just)\b", r"^(the|my|our|his|her|their) \w+ (is|was|are|were|got|has)\b", r"^(it|that|this) (is|was|looks|seems|sounds)\b", r"^i'?m (going|heading|leaving|about to|gonna)\b", r"^i'?ll\s+", r"^(fyi|btw|by the way|just so you know)\b")
RHETORICAL = (r"^why (do|does|would|did) \w+ (even|always|never)\b", r"^how (do|does|did|can|could) \w+ (even|always)\b", r"^who (even|actually|really)\b", r"^(what|where|why|how) the (hell|heck|fuck)\b")
GREETING = (r"^(hey|hi|hello|yo|sup|hiya|howdy|what'?s up|wassup|whaddup)!*$", r"^(good morning|good afternoon|good evening|good night|gm|gn)\b")
BACKCHANNEL = ("ok", "okay", "k", "kk", "yes", "yeah", "yea", "yep", "yup", "ya", "no", "nope", "nah", "sure", "bet", "word", "true", "facts", "copy", "alright", "aight", "ight", "gotcha", "got it", "heard", "lol", "lmao", "haha", "hehe", "lolol", "😂", "🤣", "💀", "nice", "cool", "good", "great", "awesome", "dope", "fire", "lit", "thanks", "thx", "ty", "thank you", "np", "nw", "yw", "bye", "cya", "later", "ttyl", "gn", "gm", "see you", "see ya", "sounds good", "for sure", "of course", "no problem", "no worries", "all good", "you too", "same", "mood", "felt that", "fr", "real", "on my way", "omw", "be there soon", "almost there")

#: In order: feature, pressure, kind, confidence; the first that holds decides. A feature may ask that two hold.
RULES = (
    ("closing", "none", "closing", 0.98),
    ("greeting", "low", "optional", 0.90),
    ("asks_to_act", "high", "commitment", 0.95),
    ("slang_question", "high", "answer", 0.90),
    ("recipient_commitment", "high", "commitment", 0.90),
    ("recipient", "high", "answer", 0.90),
    ("rhetorical_question", "low", "optional", 0.80),
    ("open_question", "high", "answer", 0.90),
    ("question_mark", "high", "confirmation", 0.75),
    ("speaker", "low", "optional", 0.90),
    ("rhetorical", "low", "optional", 0.85),
    ("reactive", "medium", "emotional", 0.85),
    ("opinion", "low", "optional", 0.80),
    ("telling", "low", "optional", 0.80),
    ("info_question", "high", "answer", 0.80),
    ("wh_word", "low", "optional", 0.70),
)


def _alternation(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def response_pressure(text: str) -> Column:
    """struct(pressure, kind, confidence); blank text is none, closing, 0; what no rule takes is low, optional, 0.5."""
    raw = F.coalesce(F.col(text), F.lit(""))
    # the cleaned text is asked for by every feature, its words by some
    clean = lambda raw: F.trim(F.regexp_replace(F.lower(raw), r"\s+", " "))
    return once(raw, lambda raw: once(clean(raw), lambda t: once(F.split(t, " "), lambda words: _judged(raw, t, words))))


def _judged(raw: Column, t: Column, words: Column) -> Column:
    first = words[0]
    has = lambda patterns: t.rlike(_alternation(patterns))
    wh = F.regexp_replace(first, r"\?+$", "").isin(*WH)
    inverted = first.isin(*AUX) & F.coalesce(F.get(words, F.lit(1)).isin(*SUBJECTS), F.lit(False))
    mark = F.rtrim(raw).endswith("?")
    features = {
        "closing": has(NEGATED) | F.regexp_replace(t, "[!?.]+$", "").isin(*BACKCHANNEL),
        "greeting": has(GREETING),
        "asks_to_act": has(REQUEST) | first.isin(*IMPERATIVES),
        "slang_question": has(SLANG),
        "recipient_commitment": has(RECIPIENT) & has(COMMITMENT),
        "recipient": has(RECIPIENT),
        "rhetorical_question": mark & (wh | inverted) & has(RHETORICAL),
        "open_question": mark & (wh | inverted),
        "question_mark": mark,
        "speaker": has(SPEAKER),
        "rhetorical": has(RHETORICAL),
        "reactive": has(REACTIVE) | (F.length(raw) - F.length(F.replace(raw, F.lit("!"), F.lit(""))) >= 2),
        "opinion": has(OPINION),
        "telling": has(TELLING),
        "info_question": has(INFO),
        "wh_word": wh,
    }
    step = F.when(t == "", 0)
    for i, rule in enumerate(RULES, 1):
        step = step.when(features[rule[0]], i)
    table = [("none", "closing", 0.0), *[r[1:] for r in RULES], ("low", "optional", 0.5)]
    rows = F.array(*[F.struct(F.lit(p).alias("pressure"), F.lit(k).alias("kind"), F.lit(c).alias("confidence")) for p, k, c in table])
    return F.get(rows, step.otherwise(len(RULES) + 1))


def sql(source: str) -> str:
    """The same for DuckDB: id, pressure, kind, confidence over a relation with id and text."""
    q = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    has = lambda patterns: "regexp_matches(t, '" + _alternation(patterns).replace("'", "''") + "')"
    wh, inv, mark = f"regexp_replace(w[1], '\\?+$', '') IN ({q(WH)})", f"(w[1] IN ({q(AUX)}) AND coalesce(w[2] IN ({q(SUBJECTS)}), false))", "ends_with(rtrim(raw), '?')"
    f = {"closing": f"{has(NEGATED)} OR regexp_replace(t, '[!?.]+$', '') IN ({q(BACKCHANNEL)})", "greeting": has(GREETING), "asks_to_act": f"{has(REQUEST)} OR w[1] IN ({q(IMPERATIVES)})", "slang_question": has(SLANG), "recipient_commitment": f"{has(RECIPIENT)} AND {has(COMMITMENT)}", "recipient": has(RECIPIENT), "rhetorical_question": f"{mark} AND ({wh} OR {inv}) AND {has(RHETORICAL)}", "open_question": f"{mark} AND ({wh} OR {inv})", "question_mark": mark, "speaker": has(SPEAKER), "rhetorical": has(RHETORICAL), "reactive": f"{has(REACTIVE)} OR length(raw) - length(replace(raw, '!', '')) >= 2", "opinion": has(OPINION), "telling": has(TELLING), "info_question": has(INFO), "wh_word": wh}
    step = "CASE WHEN t = '' THEN 0 " + " ".join(f"WHEN {f[r[0]]} THEN {i}" for i, r in enumerate(RULES, 1)) + f" ELSE {len(RULES) + 1} END"
    table = [("none", "closing", 0.0), *[r[1:] for r in RULES], ("low", "optional", 0.5)]
    pick = lambda at: "[" + ", ".join(repr(r[at]) for r in table) + "][step + 1]"
    return f"SELECT id, {pick(0)} AS pressure, {pick(1)} AS kind, {pick(2)}::DOUBLE AS confidence FROM (SELECT id, {step} AS step FROM (SELECT *, string_split(t, ' ') AS w FROM (SELECT id, coalesce(text, '') AS raw, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM {source})))"
