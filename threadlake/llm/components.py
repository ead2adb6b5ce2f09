"""Connected components of an edge table by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import stored


#: So many labels of two numbers are broadcast at most.
MOST_SENT = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, comp) for each node that has an edge; comp is the smallest node that edges reach.

    Each round contracts the edge table onto its current minimum labels, so that stars and chains shrink
    together; the table is written to the shared folder after every round. Up to MOST_SENT labels go to every task, beyond, both
    sides of a join are shuffled. No edges give no rows.
    """
    e = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    labels = e.select(F.col("b").alias("node")).union(e.select(F.col("a").alias("node"))).distinct().withColumn("comp", F.col("node"))
    while not e.isEmpty():
        # every node takes its smallest neighbour or itself; the labels then point to smaller nodes only
        both = e.select(F.col("b").alias("node"), F.col("a").alias("low")).union(e.select(F.col("a").alias("node"), F.col("a").alias("low")))
        hop = stored(both.groupBy("node").agg(F.min("low").alias("low")), "hop")
        sent = F.broadcast if hop.count() <= MOST_SENT else lambda df: df
        on = sent(hop.select(F.col("node").alias("low"), F.col("low").alias("lower")))
        for _ in range(3):
            hop = hop.join(on, "low", "left").select("node", F.coalesce("lower", "low").alias("low"))
        hop = stored(hop, "hop")
        to = sent(hop.withColumnRenamed("node", "comp"))
        labels = stored(labels.join(to, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "labels")
        x = e.join(sent(hop.withColumnsRenamed({"node": "a", "low": "x"})), "a").join(sent(hop.withColumnsRenamed({"node": "b", "low": "y"})), "b")
        e = stored(x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
    return labels
