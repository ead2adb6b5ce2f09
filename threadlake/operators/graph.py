"""Graphs of contacts and facts as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import stored


def node_id(key: str | Column) -> Column:
    return F.substring(F.sha2(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), 256), 1, 16)


def node_size(n: Column, low: Column, high: Column, smallest: float = 10.0, largest: float = 50.0) -> Column:
    """Log-scaled between the sizes of the least and the most; 20 where all are equal."""
    return F.when(low == high, 20.0).otherwise(smallest + (largest - smallest) * (F.log1p(n) - F.log1p(low)) / (F.log1p(high) - F.log1p(low)))


def edge_weight(n: Column, most: Column, days: Column) -> Column:
    """Log share of the most; with an age in days 0.7 of it and 0.3 of exp(-days / 90); between 0.05 and 1."""
    base = F.log1p(n) / F.log1p(most)
    w = F.when(most == 0, 0.1).when(days > 0, 0.7 * base + 0.3 * F.exp(-days / 90)).otherwise(base)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), w))


def ego_network(messages: DataFrame, as_of: Column, least: int = 1) -> DataFrame:
    """chat_id, id, n, size, weight of each chat about 'me'; ages are whole days before as_of."""
    g = messages.groupBy("chat_id").agg(F.count("*").alias("n"), F.max("date").alias("last")).where(F.col("n") >= least)
    ends = g.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).withColumn("one", F.lit(1))
    x = g.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one")
    return x.select("chat_id", node_id("chat_id").alias("id"), "n", F.round(node_size(F.col("n"), F.col("lo"), F.col("hi")), 6).alias("size"), F.round(edge_weight(F.col("n"), F.col("hi"), F.datediff(as_of, "last")), 6).alias("weight"))


def ego_graph(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """node, hops of all nodes within depth of start along edges (a, b) taken both ways.

    The frontier is joined level by level; nodes already reached are left out, and each level is written.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node long, hops int")
    frontier = seen
    for hop in range(1, depth + 1):
        nxt = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        frontier = stored(nxt, "frontier")
        seen = seen.union(frontier)
    return seen


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of communities (node, comm) over weighted undirected edges (a, b, w)."""
    x = edges.join(communities.withColumnsRenamed({"node": "a", "comm": "ca"}), "a").join(communities.withColumnsRenamed({"node": "b", "comm": "cb"}), "b")
    inside = x.where("ca = cb").groupBy(F.col("ca").alias("comm")).agg(F.sum("w").alias("inner"))
    ends = x.select(F.col("ca").alias("comm"), "w").union(x.select(F.col("cb").alias("comm"), "w")).groupBy("comm").agg(F.sum("w").alias("degree"))
    m = edges.agg(F.sum("w").alias("m")).withColumn("one", F.lit(1))
    y = ends.join(inside, "comm", "left").withColumn("one", F.lit(1)).join(F.broadcast(m), "one")
    return y.agg(F.round(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))), 6).alias("modularity"), F.count("*").alias("communities"))


def connected(edges: DataFrame) -> DataFrame:
    """node, comp of every node of edges (a, b): comp is the smallest node that edges reach.

    Each node takes the smallest neighbour's label, labels point on to their own labels, and edges are moved onto them, until none is left; every round is written.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("comp", F.col("node"))
    e = e.where("a < b")
    while not e.isEmpty():
        low = e.groupBy(F.col("b").alias("comp")).agg(F.min("a").alias("low"))
        # where the lower one has a lower one too, that one
        hop = low.join(low.select(F.col("comp").alias("low"), F.col("low").alias("lower")), "low", "left").select("comp", F.coalesce("lower", "low").alias("low"))
        hop = stored(hop, "hop")
        labels = stored(labels.join(hop, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "labels")
        moved = e.join(hop.withColumnsRenamed({"comp": "a", "low": "x"}), "a", "left").join(hop.withColumnsRenamed({"comp": "b", "low": "y"}), "b", "left")
        moved = moved.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        e = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
    return labels


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, comm: every node takes the label of most weight among its neighbours and itself (ties: the smaller), for some rounds.

    A deterministic local-move scheme for large graphs: a round is one join and two groupings.
    """
    both = stored(edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("comm", F.col("node"))
    own = both.groupBy(F.col("a").alias("node")).agg((F.max("w") / 2).alias("w"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnsRenamed({"node": "b"}), "b").select(F.col("a").alias("node"), "comm", "w").union(labels.join(own, "node").select("node", "comm", "w"))
        sums = votes.groupBy("node", "comm").agg(F.sum("w").alias("w"))
        labels = stored(sums.groupBy("node").agg(F.min_by("comm", F.struct(-F.col("w"), "comm")).alias("comm")), "labels")
    return labels


def local_moves(edges: DataFrame, resolution: float = 1.0, rounds: int = 100) -> DataFrame:
    """node, comm: communities (named by their smallest node) from which no single move of a node to a neighbouring one raises the modularity, or those after so many rounds.

    Edges (a, b, w) are undirected, weights positive; loops are left out, parallel edges add up. Nodes begin alone. In a round each node finds the neighbouring
    community of most gain (ties: the smaller), and many move at once, never so that the modularity falls. A community is either left or
    entered, as the best move that touches it says. Of nodes that leave or enter together some wait, by a hash, and the rest move if their gain outweighs the
    degrees of those that leave or enter with them. Where none does, those moves are made that are the best of both their communities. Nodes
    meet by joins and sums only.
    """
    loose = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w"))
    e = loose.groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = stored(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    nodes = stored(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("comm", F.col("node")), "nodes")
    total = nodes.agg(F.sum("k")).first()[0] or 0.0
    for t in range(rounds):
        moves = stored(_together(stored(_moves(both, nodes, total, resolution), "moves"), total, resolution, t), "moves")
        found = moves.agg(F.count("*").alias("n"), F.count_if("many").alias("many")).first()
        if not found["n"]:
            break
        taken = moves.where("many" if found["many"] else "first").select("node", "new")
        nodes = stored(nodes.join(taken, "node", "left").select("node", "k", F.coalesce("new", "comm").alias("comm")), "nodes")
    names = nodes.groupBy("comm").agg(F.min("node").alias("name"))
    return nodes.join(names, "comm").select("node", F.col("name").alias("comm"))


def _moves(both: DataFrame, nodes: DataFrame, total: float, resolution: float) -> DataFrame:
    """node, old, new, k, gain, rank of the best move of each node that gains by one."""
    sums = nodes.groupBy("comm").agg(F.sum("k").alias("all"))
    votes = both.join(nodes.select(F.col("node").alias("b"), "comm"), "b").groupBy(F.col("a").alias("node"), "comm").agg(F.sum("w").alias("s"))
    own = nodes.withColumnRenamed("comm", "old").join(sums.select(F.col("comm").alias("old"), F.col("all").alias("all_old")), "old")
    worth = lambda s, rest: s / total - resolution * F.col("k") * rest / total**2
    reach = votes.join(sums, "comm").join(own, "node").withColumn("worth", worth(F.col("s"), F.col("all")))
    stay = F.max(F.when(F.col("comm") == F.col("old"), F.col("s")))
    to = F.max(F.when(F.col("comm") != F.col("old"), F.struct("worth", (-F.col("comm")).alias("minus"))))
    best = reach.groupBy("node", "old", "k").agg(to.alias("to"), F.coalesce(stay, F.lit(0.0)).alias("s"), F.first("all_old").alias("all_old"))
    best = best.select("node", "old", "k", (-F.col("to.minus")).alias("new"), F.col("to.worth").alias("worth"), (F.col("to.worth") - worth(F.col("s"), F.col("all_old") - F.col("k"))).alias("gain"))
    return best.where((F.col("worth") > 0) & (F.col("gain") > 1e-12)).select("node", "old", "new", "k", "gain", F.struct("gain", (-F.col("node")).alias("minus")).alias("rank"))


def _together(moves: DataFrame, total: float, resolution: float, t: int) -> DataFrame:
    """The moves from communities that are left to ones that are entered. many: it may be made with all others so marked; first: it is the best of both communities."""
    none = F.lit(None).cast(moves.schema["rank"].dataType)
    ends = moves.select(F.col("old").alias("comm"), F.col("rank").alias("out"), none.alias("in")).union(moves.select("new", none, "rank")).groupBy("comm").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    ends = ends.select("comm", (F.col("in").isNotNull() & F.coalesce(F.col("in") > F.col("out"), F.lit(True))).alias("entered"), F.greatest("out", "in").alias("top"))
    m = moves.join(ends.select(F.col("comm").alias("old"), F.col("entered").alias("e1"), F.col("top").alias("t1")), "old").join(ends.select(F.col("comm").alias("new"), F.col("entered").alias("e2"), F.col("top").alias("t2")), "new")
    m = m.where("NOT e1 AND e2").select("node", "old", "new", "k", "gain", ((F.col("rank") == F.col("t1")) & (F.col("rank") == F.col("t2"))).alias("first"))

    def beside(rows: DataFrame) -> DataFrame:
        """rows with the share of the gain that others of the same communities cost: 1 or more where they cost all of it."""
        rows = rows.join(rows.groupBy("new").agg(F.sum(F.when(F.col("on"), F.col("k"))).alias("enter")), "new").join(rows.groupBy("old").agg(F.sum(F.when(F.col("on"), F.col("k"))).alias("leave")), "old")
        cost = resolution * F.col("k") * (F.coalesce("enter", F.lit(0.0)) + F.coalesce("leave", F.lit(0.0)) - 2 * F.col("k")) / total**2
        return rows.withColumn("cost", cost / (2 * F.col("gain"))).drop("enter", "leave")

    u = F.pmod(F.xxhash64("node", F.lit(t)), F.lit(1 << 20)) / float(1 << 20)
    thin = beside(m.withColumn("on", F.lit(True))).withColumn("on", F.col("first") | (u * F.col("cost") < 0.5))
    return beside(thin.drop("cost")).select("node", "old", "new", "k", "gain", (F.col("on") & (F.col("cost") < 1)).alias("many"), "first")


def dense_clusters(nodes: DataFrame, by: str, position: str) -> DataFrame:
    """nodes with cluster: numbers from 0 by first position of each value of by."""
    first = nodes.groupBy(by).agg(F.min(position).alias("first"))
    numbered = first.withColumn("cluster", F.row_number().over(Window.orderBy("first")) - 1).drop("first")  # one row a value
    return nodes.join(numbered, by)


def participant_stats(chats: DataFrame) -> DataFrame:
    """participant, messages, sentiment (sample-weighted mean of non-zero scores), last_date, chats of rows (participant, chat_id, n, samples, score, last_date)."""
    score = F.sum(F.when(F.col("score") != 0, F.col("score") * F.col("samples"))) / F.sum(F.when(F.col("score") != 0, F.col("samples")))
    return chats.groupBy("participant").agg(F.sum("n").alias("messages"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("sentiment"), F.max("last_date").alias("last_date"), F.array_join(F.sort_array(F.collect_set("chat_id")).cast("array<string>"), ",").alias("chats"))
