"""Orders told as chat messages: a phrase chosen by the keys of each row, filled with its date, price and names.

The tables' own texts are syllables, in which no pattern of everyday language is found; these have dates, requests, facts and moods, as many as there are orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import dealt
from threadlake.sources.tables import table

NAMES = ("Anna", "Ben", "Clara", "David", "Elena", "Frank", "Grace", "Henry", "Ines", "Jonas", "Kira", "Liam")
PLACES = ("Austin", "Berlin", "New York", "Paris", "Oslo", "San Francisco", "Lagos", "Quito")
THINGS = ("spicy ramen noodles", "tea", "hiking", "the early morning train", "oat milk in coffee", "that", "it in August", "old jazz records", "to see you", "peanut butter cookies")
PHRASES = (
    "Dinner on {month} {day} at 7pm?",
    "my sister {name} lives in {place} and I love {thing}",
    "Can you send me the report by {weekday}? thanks!",
    "ok but if the meeting moves, tell me",
    "nooooo way!! lol",
    "I work at {name} Industries but we moved to {place}",
    "let's do lunch on {md} at noon at Cafe {name}",
    "gotta run, ttyl 👋",
    "I hate {thing}. I enjoy {thing}!",
    "are you free next {weekday} at {hour}:30pm",
    "Laughed at “see you {weekday}”",
    "please bring the invoice, I need you to sign it asap",
    "Happy birthday {name}!! 🎉🎉😍",
    "my best friend {name} grew up in {place}, moving to {place} soon",
    "sorry, my bad 😢 running late",
    "Doctor appointment {month} {ord}, {year} at {hour}am",
    "what time is the game tonight?",
    "haha that's so funny 😂😂 omg",
    "I dislike {thing} because it feels like a chore",
    "The proposal is due {iso}, deadline for the client is the {ord}",
    "loved how you did that",
    "yeah",
    "we should meet the {ord} of {month} in {place}, right?",
    "favorite food is {thing} and my mom {name} joined {name} Corp",
    "Concert {mdy} 8pm, whenever you have time call me",
    "I want you to see the house, if you can",
    "k",
    "I prefer {thing} when it rains, allergic to {thing}",
    "coffee tomorrow at 9? could you let me know",
    "OMG YES!",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _ordinal_sql(d: str) -> str:
    return f"concat({d}, CASE WHEN {d} IN (11, 12, 13) THEN 'th' WHEN {d} % 10 = 1 THEN 'st' WHEN {d} % 10 = 2 THEN 'nd' WHEN {d} % 10 = 3 THEN 'rd' ELSE 'th' END)"


def _texts(pick, day: str, month: str, year: str, weekday: str) -> str:
    """The SQL of the text; pick(list, expression) is the entry at an index from 0. The same words in Spark and DuckDB."""
    fill = {
        "{month}": pick(MONTHS, f"{month} - 1"),
        "{day}": f"cast({day} AS string)",
        "{ord}": _ordinal_sql(day),
        "{year}": f"cast({year} AS string)",
        "{weekday}": pick(DAYS, weekday),
        "{md}": f"concat({month}, '/', {day})",
        "{mdy}": f"concat({month}, '/', {day}, '/', {year})",
        "{iso}": f"concat({year}, '-', lpad(cast({month} AS string), 2, '0'), '-', lpad(cast({day} AS string), 2, '0'))",
        "{hour}": "cast(1 + o_orderkey % 11 AS string)",
        "{name}": pick(NAMES, f"o_custkey % {len(NAMES)}"),
        "{place}": pick(PLACES, f"(o_orderkey + o_custkey) % {len(PLACES)}"),
        "{thing}": pick(THINGS, f"(o_orderkey * 3 + o_custkey) % {len(THINGS)}"),
    }
    out = pick(PHRASES, f"(o_orderkey * 7 + o_custkey) % {len(PHRASES)}")
    for token, value in fill.items():
        out = f"replace({out}, '{token}', {value})"
    return out


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def spoken_messages(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """id, chat_id (the customer), date, is_from_me, text of every order; even: dealt over all cores before there is a text."""
    pick = lambda words, i: "element_at(array(" + ", ".join('"' + w + '"' for w in words) + f"), cast({i} AS int) + 1)"
    text = _texts(pick, "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)", "weekday(o_orderdate)")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = dealt(o, "o_orderkey") if even else o
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chat_id"), F.col("o_orderdate").cast("timestamp").alias("date"), (F.col("o_orderkey") % 3 == 0).alias("is_from_me"), F.expr(text).alias("text"))


#: The same for DuckDB.
SP = "(SELECT o_orderkey AS id, o_custkey AS chat_id, o_orderdate AS date, o_orderkey % 3 = 0 AS is_from_me, {} AS text FROM orders)".format(
    _texts(lambda words, i: f"([{_quoted(words)}])[({i}) + 1]", "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)", "isodow(o_orderdate) - 1").replace("AS string", "AS varchar")
)
