"""Events in message text: what, when and where, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.text import once

# Words and patterns must equal the studied definitions.
EVENT_WORDS = ("meeting", "appointment", "call", "interview", "dinner", "lunch", "breakfast", "coffee", "party", "event", "conference", "webinar", "session", "class", "lesson", "workout", "gym", "doctor", "dentist", "flight", "trip", "vacation", "birthday", "anniversary", "wedding", "concert", "show", "game", "match", "reservation")
DAYS_AHEAD = (("today", 0), ("tomorrow", 1), ("next week", 7))
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TIME = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm|a\.m\.|p\.m\.)?"
PLACES = (r"(?i)at\s+([A-Z][^,.\n]+)", r"(?i)in\s+([A-Z][^,.\n]+)", r"@\s*([^\s,.\n]+)")
EVENT = r"(?i)\b(" + "|".join(EVENT_WORDS) + r")\b"


def _next_weekday(now: Column, day: int) -> Column:
    """The next such weekday from now on (0 is Monday); today counts."""
    return F.date_add(F.to_date(now), F.pmod(F.lit(day) - F.weekday(now), F.lit(7)))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(" + "|".join([*MONTHS, "sept", *(m[:3] for m in MONTHS)]) + ")"
_NTH = "(?:st|nd|rd|th)?"
#: Forms of dates in the order in which they are believed, with the groups of year, month and day (0: the current one). One grammar for Spark and for SQL.
FORMS = (
    ("iso", r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)),
    ("named", rf"\b{_MONTH}\.?\s+(\d{{1,2}}){_NTH}(?:,?\s+(\d{{4}}))?\b", (3, 1, 2)),
    ("day_first", rf"\b(\d{{1,2}}){_NTH}\s+(?:of\s+)?{_MONTH}\b\.?(?:,?\s+(\d{{4}})\b)?", (3, 2, 1)),
    ("numeric", r"\b(\d{1,2})/(\d{1,2})(?:/(\d{4}|\d{2}))?\b", (3, 1, 2)),
    ("ordinal", r"\bthe\s+(\d{1,2})(?:st|nd|rd|th)\b", (0, 0, 1)),
)
FREE = 0.75


def free_date(sentence: Column, now: Column) -> Column:
    """struct(form, day) of the first date that is written out: of the forms in their order the first that gives a day of the calendar; null without one.

    A year that is missing is now's, of two digits in this century; "the 5th" is of now's month. In numbers the month comes first.
    """

    def read(form: str, g: Column) -> Column:
        year = F.coalesce(F.when(F.length(g["y"]) == 2, F.concat(F.lit("20"), g["y"])).otherwise(g["y"]), F.year(now).cast("string"))
        month = g["m"]
        if form in ("named", "day_first"):
            number = F.array_position(F.array(*[F.lit(name[:3]) for name in MONTHS]), F.substring(month, 1, 3))
            month = F.nullif(number, F.lit(0).cast("long")).cast("string")
        return F.try_to_timestamp(F.concat_ws("-", F.when(g["d"].isNotNull(), year), month, g["d"]), F.lit("yyyy-M-d")).cast("date")

    def dated(low: Column) -> Column:
        found = []
        for form, pattern, (y, m, d) in FORMS:
            part = lambda k: F.nullif(F.regexp_extract(low, pattern, k), F.lit(""))  # noqa: B023, E731
            groups = F.struct((part(y) if y else F.lit(None).cast("string")).alias("y"), (part(m) if m else F.month(now).cast("string")).alias("m"), part(d).alias("d"))
            day = once(groups, lambda g: read(form, g))  # noqa: B023
            found.append(F.when(low.rlike(pattern), once(day, lambda x: F.when(x.isNotNull(), F.struct(F.lit(form).alias("form"), x.alias("day"))))))  # noqa: B023
        return F.coalesce(*found)

    return once(F.lower(F.coalesce(sentence, F.lit(""))), dated)


def without_dates(sentence: Column) -> Column:
    """The sentence without dates that are written out, so that what numbers are left can be times."""
    for _, pattern, _ in FORMS:
        sentence = F.regexp_replace(sentence, "(?i)" + pattern, " ")
    return sentence


def _place(sentence: Column) -> Column:
    found = [F.regexp_replace(F.trim(F.regexp_extract(sentence, p, 1)), r"(?i)\s+(at|on|for|to)\s*$", "") for p in PLACES]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def _title(sentence: Column, word: Column) -> Column:
    """The event word with whom or what it is about, or the word before it, or alone; with a capital first letter."""
    about = F.call_function("regexp_extract", sentence, F.concat(F.lit("(?i)("), word, F.lit(r"\s+(?:with|about|for|re:?)\s+[A-Za-z\s]+)")), F.lit(1))
    kind = F.call_function("regexp_extract", sentence, F.concat(F.lit(r"(?i)([A-Za-z]+\s+"), word, F.lit(")")), F.lit(1))
    t = F.trim(F.coalesce(F.nullif(about, F.lit("")), F.nullif(kind, F.lit("")), F.lower(word)))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 10_000))


def events(text: Column, now: Column, minutes: int = 60) -> Column:
    """array<struct<title, start, end, all_day, place, confidence, source>> of a text's sentences, most certain first.

    A sentence counts if it names an event and a day: today, tomorrow, next week, a weekday, this or next weekend, or a date that is written
    out (see free_date), which is believed before words without a time. The first number outside of dates
    is its time; without one, or with one that is no time, the event is all day from nine. Null and blank texts give an empty array.
    """

    names = [*(d for d, _ in DAYS_AHEAD), *WEEKDAYS]
    ahead = [*(F.date_add(F.to_date(now), n) for _, n in DAYS_AHEAD), *(_next_weekday(now, i) for i in range(7))]
    saturday = _next_weekday(now, 5)
    after = F.when(F.datediff(saturday, F.to_date(now)) < 7, F.date_add(saturday, 7)).otherwise(saturday)

    # in steps, as what one step has worked out is a value to the next and not worked out again
    def parts(x: Column) -> Column:
        s = F.trim(x)
        rest = without_dates(s)
        return F.struct(s.alias("s"), F.lower(s).alias("low"), F.regexp_extract(s, EVENT, 1).alias("word"), *[F.regexp_extract(rest, TIME, i).alias(f"t{i}") for i in (1, 2, 3)], free_date(s, now)["day"].alias("free"), _place(s).alias("place"))

    def read(p: Column) -> Column:
        h, m, half = p["t1"].try_cast("int"), F.coalesce(p["t2"].try_cast("int"), F.lit(0)), F.replace(F.lower(p["t3"]), F.lit("."), F.lit(""))
        h = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h)
        which = F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(names))):
            which = F.when(p["low"].rlike(rf"\b{name}\b"), i).otherwise(which)
        weekend = F.when(p["low"].rlike(r"\bthis weekend\b"), saturday).when(p["low"].rlike(r"\bnext weekend\b"), after)
        return F.struct(p["s"].alias("s"), p["word"].alias("word"), h.alias("h"), m.alias("m"), (h.isNotNull() & (h < 24) & (m < 60)).alias("timed"), which.alias("which"), weekend.alias("weekend"), p["free"].alias("free"), p["place"].alias("place"))

    def dated(r: Column) -> Column:
        sure = F.when(r["which"] >= len(DAYS_AHEAD), F.when(r["timed"], 0.85).otherwise(0.65)).when(r["which"].isNotNull(), F.when(r["timed"], 0.9).otherwise(0.7)).when(r["weekend"].isNotNull(), 0.6)
        better = r["free"].isNotNull() & (F.coalesce(sure, F.lit(0.0)) < FREE)
        day = F.when(better, r["free"]).otherwise(F.coalesce(F.get(F.array(*ahead), r["which"]), r["weekend"]))
        # a weekend has no hour
        timed = r["timed"] & (better | r["which"].isNotNull())
        return F.struct(r["s"].alias("s"), r["word"].alias("word"), r["h"].alias("h"), r["m"].alias("m"), r["place"].alias("place"), day.alias("day"), timed.alias("timed"), F.when(better, FREE).otherwise(sure).alias("sure"))

    def one(d: Column) -> Column:
        base, timed, place = d["day"].cast("timestamp"), d["timed"], d["place"]
        start = F.when(timed, base + F.make_interval(hours=d["h"], mins=d["m"])).otherwise(base + F.make_interval(hours=F.lit(9)))
        end = F.when(timed, base + F.make_interval(hours=d["h"], mins=d["m"] + F.lit(minutes))).otherwise(base + F.make_interval(hours=F.lit(23), mins=F.lit(59)))
        score = (F.lit(0.3) + F.when(timed, 0.25).otherwise(0.1) + F.when(place.isNotNull(), 0.15).otherwise(0.0) + d["sure"]) / 2
        return F.struct(_title(d["s"], d["word"]).alias("title"), start.alias("start"), end.alias("end"), (~timed).alias("all_day"), place.alias("place"), F.round(F.least(score, F.lit(1.0)), 4).alias("confidence"), d["s"].alias("source"))

    said = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda x: x.rlike(EVENT))
    days = F.filter(F.transform(F.transform(F.transform(said, parts), read), dated), lambda d: d["day"].isNotNull())
    found = F.transform(days, one)
    by = lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)
    return F.array_sort(found, by)
