"""Slang and abbreviations written out, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms and what they stand for must equal the studied table.
SLANG = {
    "u": "you", "ur": "your", "r": "are", "rn": "right now", "nvm": "never mind", "tbh": "to be honest", "imo": "in my opinion",
    "imho": "in my humble opinion", "lmk": "let me know", "idk": "I don't know", "idc": "I don't care", "omw": "on my way", "otw": "on the way",
    "btw": "by the way", "wya": "where you at", "wbu": "what about you", "hbu": "how about you", "ily": "I love you", "ilysm": "I love you so much",
    "brb": "be right back", "ttyl": "talk to you later", "jk": "just kidding", "np": "no problem", "ty": "thank you", "yw": "you're welcome",
    "pls": "please", "plz": "please", "thx": "thanks", "tho": "though", "bc": "because", "cuz": "because", "b4": "before", "2day": "today",
    "2morrow": "tomorrow", "2nite": "tonight", "tmrw": "tomorrow", "tmw": "tomorrow", "w/": "with", "w/o": "without", "wo": "without", "ya": "yeah",
    "yea": "yeah", "yep": "yes", "yup": "yes", "nah": "no", "nope": "no", "aight": "alright", "ight": "alright", "aite": "alright", "oki": "okay",
    "kk": "okay", "ofc": "of course", "def": "definitely", "obvi": "obviously", "prolly": "probably", "probs": "probably", "sry": "sorry",
    "srry": "sorry", "mb": "my bad", "wdym": "what do you mean", "wym": "what you mean", "hmu": "hit me up", "lmao": "laughing my ass off",
    "lmaoo": "laughing my ass off", "lmaooo": "laughing my ass off", "lmaoooo": "laughing my ass off", "lmfao": "laughing my fucking ass off",
    "lmfaoo": "laughing my fucking ass off", "lmfaooo": "laughing my fucking ass off", "lmfaoooo": "laughing my fucking ass off",
    "lol": "laughing out loud", "lool": "laughing out loud", "loool": "laughing out loud", "loooool": "laughing out loud",
    "lolol": "laughing out loud", "lololol": "laughing out loud", "lolololol": "laughing out loud", "rofl": "rolling on the floor laughing",
    "roflmao": "rolling on the floor laughing my ass off", "rly": "really", "rlly": "really", "v": "very", "sm": "so much",
    "fyi": "for your information", "iirc": "if I recall correctly", "afaik": "as far as I know", "asap": "as soon as possible", "omg": "oh my god",
    "omgg": "oh my god", "omggg": "oh my god", "omfg": "oh my god", "omfgg": "oh my god", "omfggg": "oh my god", "wtf": "what the fuck",
    "wtff": "what the fuck", "wtfff": "what the fuck", "wth": "what the hell", "smh": "shaking my head", "ngl": "not gonna lie",
    "ngll": "not gonna lie", "fr": "for real", "frr": "for real", "frfr": "for real for real", "frfrfr": "for real for real", "tbhh": "to be honest",
    "lowkey": "kind of", "highkey": "definitely", "bet": "definitely", "fam": "family", "bro": "brother", "sis": "sister", "finna": "going to",
    "gonna": "going to", "gotta": "got to", "wanna": "want to", "kinda": "kind of", "sorta": "sort of", "lemme": "let me", "gimme": "give me",
    "dunno": "don't know", "gotcha": "got you", "gn": "good night", "gm": "good morning", "cya": "see you", "ttys": "talk to you soon",
    "bbl": "be back later", "afk": "away from keyboard", "dm": "direct message", "irl": "in real life", "tmi": "too much information",
    "slay": "amazing", "bussin": "really good", "mid": "mediocre", "sus": "suspicious", "cap": "lie", "no cap": "no lie", "periodt": "period",
    "snatched": "looking good", "stan": "big fan", "simp": "overly devoted", "hits different": "feels unique",
    "main character": "protagonist energy", "understood the assignment": "did it perfectly", "rent free": "constantly thinking about",
    "its giving": "it resembles", "ate": "did exceptionally well", "bestie": "best friend", "girlie": "girl", "bffr": "be for real", "ong": "on god",
    "npc": "uninteresting person", "gyat": "exclamation of attraction", "rizz": "charisma", "no rizz": "no charisma", "valid": "acceptable",
    "based": "admirable", "cringe": "embarrassing", "vibe": "atmosphere", "vibes": "atmosphere", "vibing": "relaxing", "yeet": "throw",
    "ghosted": "ignored", "ghosting": "ignoring", "deadass": "seriously", "slaps": "is great", "fire": "excellent", "lit": "exciting",
    "goat": "greatest of all time", "goated": "the best", "tea": "gossip", "spill the tea": "share the gossip", "salty": "bitter",
    "extra": "over the top", "flex": "show off", "flexing": "showing off", "thicc": "curvy", "clout": "influence", "fomo": "fear of missing out",
    "jomo": "joy of missing out", "oof": "expression of discomfort", "yikes": "expression of concern", "wyd": "what are you doing",
    "wru": "where are you", "wsg": "what is good", "eta": "estimated arrival", "bruh": "bro",
}


def _literal(words: list[str]) -> str:
    return "|".join(words).replace("/", "[/]")


def expanded(text: str, table: dict[str, str] = SLANG) -> Column:
    """text with whole terms of table written out: upper case for terms in capitals, a capital first letter for those that begin with one.

    The text is cut into words, phrases of the table and what lies between; a term that ends in another sign than a letter must
    stand before a letter. Texts without any term are passed on after one scan. Null stays null.
    """
    word = r"[\p{L}\p{N}_]"
    phrases = [t for t in table if " " in t]
    signs = [t for t in table if not (t[-1].isalnum() or t[-1] == "_")]
    whole = f"(?:{_literal(phrases)})(?!{word})|" if phrases else ""
    before = f"(?:{_literal(signs)})(?={word})|" if signs else ""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?iu)(?<!{word})(?:{whole}{before}{word}+)|{word}+|[^\\p{{L}}\\p{{N}}_]+"), F.lit(0))
    of = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def one(x: Column) -> Column:
        low, to = F.lower(x), of[F.lower(x)]
        first = F.substring(x, 1, 1)
        capitals = (F.length(x) > 1) & (F.upper(x) == x) & (low != x)
        styled = F.when(capitals, F.upper(to)).when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(to, 1, 1)), F.lower(F.substring(to, 2, 1000)))).otherwise(to)
        # a set of the terms is asked first: the map is searched for hits only
        return F.when(low.isin(list(table)), styled).otherwise(x)

    some = F.col(text).rlike(f"(?iu)(?<!{word})(?:{_literal(sorted(table, key=len, reverse=True))})")
    return F.when(some, F.array_join(F.transform(pieces, one), "")).otherwise(F.col(text))
