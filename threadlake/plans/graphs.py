"""Graph and streaming queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.operators import clusters, graph
from threadlake.plans.registry import query
from threadlake.session import ship, stored
from threadlake.sources.tables import EV, event_messages, table
from threadlake.streaming import messages as st


@query("gra01_ego_network", f"""
WITH g AS (SELECT chat_id, count(*) AS n, max(date) AS last FROM {EV} GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT min(n) AS lo, max(n) AS hi FROM g)
SELECT chat_id, substr(sha256(chat_id::VARCHAR), 1, 16) AS id, n, round(CASE WHEN lo = hi THEN 20 ELSE 10 + 40 * (ln(1 + n) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo)) END, 6) AS size,
  round(greatest(0.05, least(1, CASE WHEN date_diff('day', last::DATE, DATE '2024-02-01') > 0 THEN 0.7 * ln(1 + n) / ln(1 + hi) + 0.3 * exp(-date_diff('day', last::DATE, DATE '2024-02-01') / 90) ELSE ln(1 + n) / ln(1 + hi) END)), 6) AS weight FROM g, e""")
def ego_network(spark, sf_dir):
    return graph.ego_network(event_messages(spark, sf_dir), F.lit("2024-02-01").cast("date"), 3)


EDGES = "(SELECT DISTINCT c_nationkey::BIGINT AS a, 100 + s_nationkey::BIGINT AS b FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50 AND l_discount = 0.05)"


def nation_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_discount = 0.05").select("l_orderkey", "l_suppkey")
    o, c, s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return j.select(F.col("c_nationkey").cast("long").alias("a"), (F.lit(100) + F.col("s_nationkey")).cast("long").alias("b")).distinct()


@query("gra02_ego_graph", f"""
WITH RECURSIVE e AS (SELECT a, b FROM {EDGES} UNION SELECT b, a FROM {EDGES}), r(node, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT e.b, hops + 1 FROM r JOIN e ON e.a = r.node WHERE hops < 3)
SELECT node, min(hops) AS hops FROM r GROUP BY 1""")
def ego_graph(spark, sf_dir):
    return graph.ego_graph(nation_edges(spark, sf_dir), 0, 3)


@query("gra03_modularity", f"""
WITH e AS (SELECT a, b, 1.0 AS w FROM {EDGES}), x AS (SELECT a % 5 AS ca, b % 5 AS cb, w FROM e), i AS (SELECT ca AS comm, sum(w) AS inner_w FROM x WHERE ca = cb GROUP BY 1),
d AS (SELECT comm, sum(w) AS degree FROM (SELECT ca AS comm, w FROM x UNION ALL SELECT cb, w FROM x) GROUP BY 1), m AS (SELECT sum(w) AS m FROM e)
SELECT round(sum(coalesce(inner_w, 0)::DOUBLE / m - power(degree::DOUBLE / (2 * m), 2)), 6) AS modularity, count(*) AS communities FROM d LEFT JOIN i USING (comm), m""")
def modularity(spark, sf_dir):
    e = nation_edges(spark, sf_dir).withColumn("w", F.lit(1.0))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return graph.modularity(e, nodes.withColumn("comm", F.col("node") % 5))


def _label_rounds(rounds: int) -> str:
    """Each round's labels as one more table."""
    steps = [f"WITH e AS (SELECT a, b, 1.0::DOUBLE AS w FROM {EDGES} UNION ALL SELECT b, a, 1.0::DOUBLE FROM {EDGES}), own AS (SELECT a AS node, max(w) / 2 AS w FROM e GROUP BY 1), l0 AS (SELECT DISTINCT a AS node, a AS comm FROM e)"]
    for i in range(1, rounds + 1):
        steps.append(f"l{i} AS (SELECT node, arg_min(comm, (-w, comm)) AS comm FROM (SELECT node, comm, sum(w) AS w FROM (SELECT e.a AS node, comm, w FROM e JOIN l{i - 1} l ON l.node = e.b UNION ALL SELECT node, comm, w FROM l{i - 1} JOIN own USING (node)) GROUP BY 1, 2) GROUP BY 1)")
    return ", ".join(steps) + f" SELECT node, comm FROM l{rounds}"


@query("gra03_label_communities", _label_rounds(5))
def label_communities(spark, sf_dir):
    return graph.label_communities(nation_edges(spark, sf_dir).withColumn("w", F.lit(1.0)))


def neighbour_edges(spark, sf_dir):
    """Vectors and their five nearest others."""
    own, _ = clusters.points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    near = clusters.nearest_neighbours(clusters.Cells(own), 5)
    return near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct().withColumn("w", F.lit(1.0))


@query("gra03_local_moves")
def local_moves(spark, sf_dir):
    """node, comm, size: communities of vectors in the graph of near neighbours, by modularity gains."""
    c = stored(graph.local_moves(neighbour_edges(spark, sf_dir)), "communities")
    return c.join(c.groupBy("comm").agg(F.count("*").alias("size")), "comm").select("node", "comm", "size")


@query("gra04_type_clusters", "WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1), n AS (SELECT p_brand, row_number() OVER (ORDER BY first) - 1 AS cluster FROM f) SELECT p_partkey, cluster FROM part JOIN n USING (p_brand)")
def type_clusters(spark, sf_dir):
    return graph.dense_clusters(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "cluster")


@query("gra05_knowledge_graph", "SELECT 'contact' AS kind, 'c:' || c_custkey AS node, count(o_orderkey) AS edges FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey UNION ALL SELECT 'entity', 'e:' || o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def knowledge_graph(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    contacts = table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").select(F.lit("contact").alias("kind"), F.concat(F.lit("c:"), "c_custkey").alias("node"), F.coalesce("k", F.lit(0)).alias("edges"))
    return contacts.unionByName(o.groupBy("o_orderpriority").agg(F.count("*").alias("edges")).select(F.lit("entity").alias("kind"), F.concat(F.lit("e:"), "o_orderpriority").alias("node"), "edges"))


@query("gra06_reverse_lookup", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000")
def reverse_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 250000").select("o_custkey").distinct()


@query("gra08_fact_summary", "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_custkey = 7 ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) SELECT o_orderpriority AS category, string_agg('order ' || o_orderkey, '; ' ORDER BY rn) AS facts FROM r GROUP BY 1")
def fact_summary(spark, sf_dir):
    top = table(spark, sf_dir, "orders").where("o_custkey = 7").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)
    g = top.groupBy(F.col("o_orderpriority").alias("category")).agg(F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("s"))
    return g.select("category", F.array_join(F.transform("s", lambda x: F.concat(F.lit("order "), x["o_orderkey"])), "; ").alias("facts"))


@query("agg33_participant_stats", f"""
WITH c AS (SELECT chat_id, chat_id % 7 AS participant, count(*) AS n, count(*) FILTER (value > 50) AS samples, round(avg(value) / 100 - 0.5, 3) AS score, max(date) AS last_date FROM {EV} GROUP BY 1)
SELECT participant, sum(n)::BIGINT AS messages, round(coalesce(sum(score * samples) FILTER (score <> 0) / sum(samples) FILTER (score <> 0), 0), 6) AS sentiment, max(last_date) AS last_date, string_agg(chat_id::VARCHAR, ',' ORDER BY chat_id) AS chats FROM c GROUP BY 1""")
def participant_stats(spark, sf_dir):
    c = event_messages(spark, sf_dir).groupBy("chat_id").agg((F.col("chat_id") % 7).alias("participant"), F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("samples"), F.round(F.avg("value") / 100 - 0.5, 3).alias("score"), F.max("date").alias("last_date"))
    return graph.participant_stats(c)


@query("agg34_graph_stats", f"SELECT count(*) + 1 AS nodes, count(*) AS edges, round(avg(n), 4) AS mean_messages, arg_max(chat_id, (n, -chat_id)) AS most_active FROM (SELECT chat_id, count(*) AS n FROM {EV} GROUP BY 1)")
def graph_stats(spark, sf_dir):
    g = event_messages(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n"))
    return g.agg((F.count("*") + 1).alias("nodes"), F.count("*").alias("edges"), F.round(F.avg("n"), 4).alias("mean_messages"), F.max_by("chat_id", F.struct("n", -F.col("chat_id"))).alias("most_active"))


def stream(spark, sf_dir):
    ship(spark)
    return st.event_stream(spark, f"{sf_dir}/events.parquet")


@query("src06_tail", f"SELECT id, chat_id, date FROM {EV}")
def tail(spark, sf_dir):
    return st.drain(stream(spark, sf_dir).select("id", "chat_id", "date"), "append")


@query("str03_resegment_signals", f"SELECT chat_id, (count(*) // 15) * 15 AS n FROM {EV} GROUP BY 1 HAVING count(*) >= 15")
def resegment(spark, sf_dir):
    return st.drain(st.resegment_signals(stream(spark, sf_dir)), "append").groupBy("chat_id").agg(F.sum("n").alias("n"))


@query("str06_tumbling", f"SELECT date_trunc('day', date)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (is_from_me) AS sent FROM {EV} GROUP BY 1")
def tumbling(spark, sf_dir):
    return st.drain(st.tumbling(stream(spark, sf_dir)), "complete")


@query("str06_sliding", f"SELECT (date_trunc('hour', date) - k * INTERVAL 1 HOUR)::TIMESTAMP AS start, event_type, count(*) AS n FROM {EV}, range(2) r(k) GROUP BY 1, 2")
def sliding(spark, sf_dir):
    return st.drain(st.sliding(stream(spark, sf_dir)), "complete")


@query("str05_sessions", f"""
WITH g AS (SELECT chat_id, date, CASE WHEN lag(date) OVER w IS NULL OR date_diff('microsecond', lag(date) OVER w, date) >= 1800000000 THEN 1 ELSE 0 END AS s FROM {EV} WINDOW w AS (PARTITION BY chat_id ORDER BY date, id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY chat_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT chat_id, min(date) AS start, count(*) AS n FROM i GROUP BY chat_id, k""")
def sessions(spark, sf_dir):
    return st.drain(st.sessions(stream(spark, sf_dir)), "complete")


@query("str08_fan_out", f"SELECT event_type, count(*) AS n FROM {EV} GROUP BY 1")
def fan_out(spark, sf_dir):
    import uuid

    from threadlake.session import shared_dir

    base = f"{shared_dir(spark)}/fan-{uuid.uuid4().hex}"
    st.fan_out(stream(spark, sf_dir), [lambda df, b: st.put(df, f"{base}/index", b), lambda df, b: st.put(df.groupBy("event_type").agg(F.count("*").alias("n")), f"{base}/counts", b)])
    return spark.read.parquet(f"{base}/counts").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("str04_resegment", f"""
WITH g AS (SELECT chat_id, id, sum(CASE WHEN prev IS NULL OR date_diff('microsecond', prev, date) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY date, id) AS k, date FROM (SELECT *, lag(date) OVER (PARTITION BY chat_id ORDER BY date, id) AS prev FROM {EV}))
SELECT chat_id, count(DISTINCT k) AS threads, count(*) AS n FROM g GROUP BY 1""")
def resegment_threads(spark, sf_dir):
    import uuid

    from threadlake.session import shared_dir

    base = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    st.resegment(stream(spark, sf_dir), base)
    return spark.read.parquet(f"{base}/threads").groupBy("chat_id").agg(F.countDistinct("thread_id").alias("threads"), F.count("*").alias("n"))
