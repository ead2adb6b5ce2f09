"""Queries over clusters of vectors (VEC-17, VEC-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.operators import clusters, vectors
from threadlake.operators.text import tfidf_keywords, topic_word_array
from threadlake.plans.registry import query
from threadlake.sources.tables import table

#: Cosine distance of neighbours and rows of a dense place; rows of a template.
EPS, DENSE, FREQUENT = 0.65, 5, 5


def _topics(spark, sf_dir):
    return clusters.hdbscan(table(spark, sf_dir, "embeddings"))


@query("vec17_topic_members")
def topic_members(spark, sf_dir):
    """vec_id, topic: null for noise."""
    return _topics(spark, sf_dir).select(F.col("key").alias("vec_id"), F.col("cluster").alias("topic"))


@query("vec17_topics")
def topics(spark, sf_dir):
    """topic, messages, samples, keywords, centroid: a row a topic, by falling size; the text of a vector is that of the document of its number."""
    labels = _topics(spark, sf_dir)
    rows = clusters.summaries(labels, table(spark, sf_dir, "embeddings"), 3)
    # every text counts for the document frequencies, those of a topic for its words
    texts = labels.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"), "key").withColumn("topic", F.coalesce("cluster", F.lit(-1)))
    words = tfidf_keywords(texts, "topic", "key", 5, topic_word_array).groupBy(F.col("topic").alias("cluster")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda s: s["word"]), " ").alias("keywords"))
    out = rows.join(words, "cluster", "left")
    return out.select(F.col("cluster").alias("topic"), F.col("n").alias("messages"), F.array_join(F.col("nearest").cast("array<string>"), ",").alias("samples"), "keywords", F.array_join(F.transform("centroid", lambda c: F.round(c, 6).cast("string")), ",").alias("centroid"))


DBSCAN = f"""
v AS (SELECT vec_id AS k, embedding::DOUBLE[] AS x FROM embeddings),
near AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON 1 - list_cosine_similarity(a.x, b.x) <= {EPS}),
core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= {DENSE}),
links AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN core x ON x.k = a SEMI JOIN core y ON y.k = b),
reach(k, other) AS (SELECT k, k FROM core UNION SELECT r.k, l.b FROM reach r JOIN links l ON l.a = r.other),
named AS (SELECT k, min(other) AS cluster FROM reach GROUP BY 1),
labels AS (SELECT v.k, any_value(v.x) AS x, c.k IS NOT NULL AS core, coalesce(any_value(own.cluster), min(n.cluster)) AS cluster FROM v LEFT JOIN core c ON c.k = v.k LEFT JOIN named own ON own.k = v.k LEFT JOIN near e ON e.a = v.k LEFT JOIN named n ON n.k = e.b GROUP BY v.k, c.k)"""


def _dense(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", clusters.unit("embedding").alias("embedding"))
    return clusters.dbscan(v, (2 * EPS) ** 0.5, DENSE)


@query("vec19_density_clusters", f"WITH RECURSIVE {DBSCAN} SELECT k AS vec_id, core, cluster FROM labels")
def density_clusters(spark, sf_dir):
    return _dense(spark, sf_dir).select(F.col("key").alias("vec_id"), "core", "cluster")


@query("vec19_templates", f"""
WITH RECURSIVE {DBSCAN}, one AS (SELECT cluster, pos, avg(x[pos]) AS c FROM labels, range(1, 65) r(pos) WHERE cluster IS NOT NULL GROUP BY 1, 2), centre AS (SELECT cluster, list(c ORDER BY pos) AS c FROM one GROUP BY 1),
far AS (SELECT cluster, k, round(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) ** 2)), 12) AS d FROM labels JOIN centre USING (cluster)),
r AS (SELECT cluster, k, row_number() OVER (PARTITION BY cluster ORDER BY d, k) AS near, row_number() OVER (PARTITION BY cluster ORDER BY md5(k::VARCHAR), k) AS pick, count(*) OVER (PARTITION BY cluster) AS n FROM far)
SELECT cluster, n AS frequency, min(k) FILTER (near = 1) AS representative, string_agg(k::VARCHAR, ',' ORDER BY pick) FILTER (pick <= 5) AS examples FROM r GROUP BY 1, 2 HAVING n >= {FREQUENT}""")
def templates(spark, sf_dir):
    """Clusters of at least FREQUENT rows: how many, the row nearest to the centroid, five examples in the order of a hash."""
    labels = _dense(spark, sf_dir)
    middle = clusters.summaries(labels, table(spark, sf_dir, "embeddings"), 1).where(F.col("n") >= FREQUENT)
    pick = clusters.examples(labels, 5)
    return middle.join(pick, "cluster").select("cluster", F.col("n").alias("frequency"), F.col("nearest")[0].alias("representative"), F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("vec16_group_templates", """
WITH t AS (SELECT label AS template, embedding AS c, label % 3 = 0 AS is_group, CASE WHEN label % 4 = 1 THEN 2 END AS least, CASE WHEN label % 4 >= 2 THEN 4 END AS most FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
e AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 > 0 THEN (vec_id % 7)::INT END AS n FROM embeddings),
s AS (SELECT vec_id, n, t.*, list_cosine_similarity(e.embedding::DOUBLE[], t.c::DOUBLE[]) AS sim FROM e, t),
g AS (SELECT vec_id, arg_max({'t': template, 's': sim}, (CASE WHEN n >= 3 AND is_group THEN least(sim + 0.05, 1) ELSE sim END, -template)) AS b FROM s
  WHERE sim >= 0.2 AND CASE WHEN n IS NULL THEN true WHEN s.least IS NULL AND most IS NULL THEN NOT is_group OR n >= 3 ELSE n >= coalesce(s.least, n) AND n <= coalesce(most, n) END GROUP BY 1)
SELECT e.vec_id, b.t AS template, round(b.s, 5) AS similarity FROM e LEFT JOIN g USING (vec_id)""")
def group_templates(spark, sf_dir):
    """The first vector of each label as a template, some for groups; rows say how large their group is."""
    e = table(spark, sf_dir, "embeddings")
    t = e.groupBy(F.col("label").alias("template")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    t = t.select("*", (F.col("template") % 3 == 0).alias("is_group"), F.when(F.col("template") % 4 == 1, 2).alias("least"), F.when(F.col("template") % 4 >= 2, 4).alias("most"))
    m = e.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 > 0, F.col("vec_id") % 7).alias("group_size"))
    return vectors.best_templates(m, t, 0.2)
