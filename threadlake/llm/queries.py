"""The opN queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import bpe, decontam, jaccard, langid, maxent, mixing, pii, tiff, tokenfile, toxicity, urlfilter, vectorcode, whitening
from threadlake.session import small, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encoded_digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(11), ' ', 'g'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
flat AS (SELECT doc_id, md5(unnest(s)) AS h FROM shingled),
sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN ways l ON l.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id
FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n
"""


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), k=4, num=85, den=100)


@query("op10_maxent_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.lm_scores(documents(spark, sf_dir))


@query("op6_token_file")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.languages(docs, langid.fit(docs))


@query("op8_tiff")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_image_digests(documents(spark, sf_dir))


@query("op9_benchmark_decontamination", decontam.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts of pages, as there is no list among the tables: about a fifth of hosts, and domains of some."""
    host = F.regexp_extract(F.lower("url"), urlfilter.HOST, 1)
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    hosts = hosts.select("host", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long").alias("m"))
    own = hosts.where("m % 5 = 0").selectExpr("host AS pattern", "m")
    above = hosts.where("m % 97 = 0").selectExpr("regexp_extract(host, '[^.]+[.][^.]+$', 0) AS pattern", "m")
    rows = own.union(above).selectExpr("concat('list', m % 3) AS list", "pattern", "m", "explode(sequence(0, 2)) AS k")
    return rows.selectExpr("list", "pattern", "CASE WHEN k = 1 THEN 'remove' ELSE 'add' END AS action", "timestamp_seconds(1704067200 + (m % 1000) * 3600 + k * (m % 700) * 5400) AS ts")


URL_SQL = r"""
WITH cap AS (
  SELECT page_id, url, to_timestamp(1704067200 + page_id * 420)::TIMESTAMP AS fetch_ts,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', ''), '') AS host,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS m FROM (SELECT DISTINCT regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host FROM pages) WHERE host <> ''),
own AS (SELECT host AS pattern, m FROM hosts WHERE m % 5 = 0 UNION ALL SELECT regexp_extract(host, '[^.]+[.][^.]+$') AS pattern, m FROM hosts WHERE m % 97 = 0),
entries AS (SELECT DISTINCT concat('list', m % 3) AS list, pattern, CASE WHEN k = 1 THEN 'remove' ELSE 'add' END AS action,
  to_timestamp(1704067200 + (m % 1000) * 3600 + k * (m % 700) * 5400)::TIMESTAMP AS ts FROM own, range(0, 3) r(k)),
spans AS (SELECT list, pattern, action, ts AS valid_from, lead(ts) OVER (PARTITION BY list, pattern ORDER BY ts, action) AS valid_to FROM entries),
keyed AS (
  SELECT DISTINCT page_id, url, fetch_ts, unnest(list_concat(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    CASE WHEN segment IS NULL THEN [] ELSE [host || '/' || segment] END)) AS pattern FROM cap WHERE host IS NOT NULL),
hits AS (SELECT k.*, s.list FROM keyed k JOIN spans s ON s.pattern = k.pattern AND s.action = 'add' AND k.fetch_ts >= s.valid_from AND (s.valid_to IS NULL OR k.fetch_ts < s.valid_to)),
found AS (SELECT page_id, url, fetch_ts, count(DISTINCT list || ' ' || pattern) AS n_active, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern FROM hits GROUP BY 1, 2, 3)
SELECT c.page_id, c.url, c.fetch_ts, c.host, f.n_active IS NOT NULL AS blocked, coalesce(f.n_active, 0) AS n_active, coalesce(f.lists, '') AS lists, f.pattern
FROM cap c LEFT JOIN found f USING (page_id, url, fetch_ts)
"""


@query("op7_url_filter", URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    # pages have no fetch times: one every seven minutes, in order of page_id
    captures = pages.withColumn("fetch_ts", F.expr("timestamp_seconds(1704067200 + page_id * 420)"))
    return urlfilter.filtered(captures, list_entries(pages))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.personal_data(docs, pii.fit(docs))


def _code_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Codebooks round by round, written out; squared distances by inner products, which doubles hold exactly."""
    pos = ", ".join(f"({p})" for p in range(parts))
    sql = [
        f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS (SELECT vec_id, label, p, x[p * {width} + 1:(p + 1) * {width}] AS x FROM kept, (VALUES {pos}) t(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})"""
    ]
    for r in range(rounds + 1):
        sql.append(f"""near{r} AS (SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT k.vec_id, k.label, k.p, k.x, b.e, (list_inner_product(k.x, k.x) - 2 * list_inner_product(k.x, b.c) + list_inner_product(b.c, b.c))::BIGINT AS d
  FROM cut k JOIN book{r} b USING (p)) GROUP BY vec_id, label, p)""")
        if r < rounds:
            mean = "list_transform(range(1, " + str(width + 1) + "), lambda i: floor(list_sum(list_transform(xs, lambda v: v[i])) / n))"
            sql.append(f"""sums{r} AS (SELECT p, best.e AS e, list(x) AS xs, count(*) AS n FROM near{r} GROUP BY 1, 2),
book{r + 1} AS (SELECT b.p, b.e, CASE WHEN s.n IS NULL THEN b.c ELSE {mean} END AS c FROM book{r} b LEFT JOIN sums{r} s USING (p, e))""")
    sql.append(f"""coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) AS h FROM book{rounds})""")
    return ",\n".join(sql) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, digest"


@query("op13_vector_codes", _code_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vectorcode.fit(vectors)
    # the label is carried beside the key
    both = vectors.select(F.struct("vec_id", "label").alias("id"), "embedding")
    coded = stored(vectorcode.encode(both, books, key="id").select("id.*", "codes", "error"), "codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    joined = coded.alias("c").join(small(sums).alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", code.alias("code"), "error", F.expr("try_cast(label_error AS long)").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, model.explained)).cast("array<double>"), F.col("at"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


@query("op12_source_mix")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir)).drop("source")
