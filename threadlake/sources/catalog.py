"""A catalog of named queries with optional filters, registries, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators import messages as ops

#: Named reads: a message table and filters in, a table out.
NAMED: dict[str, Callable[..., DataFrame]] = {
    "messages": lambda m, **k: m.orderBy(F.desc("date"), F.desc("id")).limit(k.get("limit", 100)),
    "conversations": lambda m, **k: m.groupBy("chat_id").agg(F.max("date").alias("last_date"), F.count("*").alias("n")).orderBy(F.desc("last_date"), "chat_id").limit(k.get("limit", 50)),
    "search": lambda m, **k: ops.search(m, k["text"], limit=k.get("limit", 50)),
    "last_messages": lambda m, **k: ops.latest_per_chat(m, 1).drop("rn"),
    "after": lambda m, **k: m.where(F.col("id") > k["id"]).orderBy("date", "id").limit(k.get("limit", 100)),
}


def get_query(name: str, messages: DataFrame, since: object = None, before: object = None, chat: object = None, sender: str | None = None, **options: object) -> DataFrame:
    """The named query over messages, filters first; an unknown name raises KeyError."""
    m = messages.where(ops.between("date", since, before))
    if chat is not None:
        m = m.where(F.col("chat_id") == chat)
    if sender is not None:
        m = m.where(ops.sent_by("sender", sender))
    return NAMED[name](m, **options)


class Handlers:
    """Names to functions over DataFrames: task handlers, prediction strategies, exports."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, handler: Callable[..., DataFrame]) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered")
        self._known[name] = handler

    def run(self, name: str, *args: object, **options: object) -> DataFrame:
        return self._known[name](*args, **options)

    def names(self) -> list[str]:
        return sorted(self._known)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, text_columns: tuple[str, ...] = ("text",)) -> None:
    """CSV with a header; text columns are made safe for spreadsheets."""
    from threadlake.functions.text import csv_safe

    df.withColumns({c: csv_safe(c) for c in text_columns if c in df.columns}).write.mode("overwrite").option("header", True).csv(path)


def backup(messages: DataFrame) -> DataFrame:
    """chat_id, n, messages: a JSON list of each chat's messages in order."""
    g = messages.groupBy("chat_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("date", "id", "sender", "text"))).alias("m"))
    return g.select("chat_id", "n", F.to_json("m").alias("messages"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: a GraphML document of nodes(id) and edges(a, b), one element a row, in order of part and line."""
    n = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"/>', F.col("id").cast("string")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"/>', F.col("a").cast("string"), F.col("b").cast("string")).alias("line"))
    return n.unionByName(e)
