"""Versioned vector tables: typed vectors in folders that grow batch by batch, and one active version at a time.

A store is a folder: versions/<version>/meta, versions/<version>/<table>/batch=<n>, and active/<n>-<version>, empty files of which the last
by name tells the active version. A batch counts once its _SUCCESS is there; one that broke off is written again. A file of active/ is there or
not, so readers see the old or the new version while one is activated, never none or two.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.vectors import quantise, sign_words

#: Folders that vectors are dealt over by their partition key, so that a search within a key reads one of them.
BUCKETS = 16
#: Characters of a message's preview, and of a segment's context and reply.
PREVIEW, PASSAGE = 200, 1000

TABLES = {
    "messages": "id long, chat_id string, preview string, sender string, timestamp long, is_from_me boolean, embedding array<tinyint>, bits binary, bucket int",
    "segments": "segment_id string, chat_id string, contact_id long, timestamp long, context string, reply string, n int, embedding array<tinyint>, bits binary, bucket int",
}


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def packed_signs(v: str | Column, dim: int) -> Column:
    """Bits x > 0, the first component highest, as bytes; a last word that is not full is filled up with zeros."""
    words = sign_words(v, dim)
    left = -dim % 32
    last = F.lit((dim - 1) // 32)
    bytes_ = F.transform(words, lambda w, i: F.lpad(F.hex(F.when(i == last, w * (1 << left)).otherwise(w)), 8, "0"))
    return F.unhex(F.substring(F.array_join(bytes_, ""), 1, -(-dim // 8) * 2))


def typed(df: DataFrame, dim: int, key: str, v: str = "embedding") -> DataFrame:
    """df with the vector as dim bytes, its packed signs, and the bucket of the partition key. Rows whose vector has another length, or nulls, are left out."""
    fit = df.where(F.size(v) == dim).where(F.forall(v, lambda x: x.isNotNull()))
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(BUCKETS)).cast("int")
    return fit.withColumn("bits", packed_signs(v, dim)).withColumn(v, quantise(v)).withColumn("bucket", bucket)


def add_version(spark: SparkSession, base: str, version: str, model: str, dim: int) -> None:
    """Put a version into the catalog; one that is there is an error."""
    if not version or "/" in version:
        raise ValueError("a version is a name of a folder")
    spark.createDataFrame([(version, model, dim)], "version string, model string, dim int").coalesce(1).write.parquet(f"{base}/versions/{version}/meta")


def batches(spark: SparkSession, base: str, version: str, name: str) -> list[int]:
    """Numbers of the finished batches of a table."""
    path = f"{base}/versions/{version}/{name}"
    return sorted(int(x.split("=")[1]) for x in _names(spark, path) if x.startswith("batch=") and "_SUCCESS" in _names(spark, f"{path}/{x}"))


def read(spark: SparkSession, base: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version, or of the active one, with the batch of each row; empty before the first batch. No active version is an error."""
    version = version or active(spark, base)
    if version is None:
        raise ValueError(f"no version of {base} is active")
    path = f"{base}/versions/{version}/{name}"
    done = batches(spark, base, version, name)
    if not done:
        return spark.createDataFrame([], f"{TABLES[name]}, batch int")
    return spark.read.schema(f"{TABLES[name]}, batch int").option("basePath", path).parquet(*[f"{path}/batch={n}" for n in done])


def _append(rows: DataFrame, base: str, version: str, name: str, key: str) -> int:
    """Write the rows whose key the table has not, as its next batch, and tell how many; of rows with the same key the first by all columns. None, no batch."""
    spark = rows.sparkSession
    done = batches(spark, base, version, name)
    own = rows.select(*[c.split()[0] for c in TABLES[name].split(", ")])
    new = own.join(read(spark, base, name, version).select(key), key, "left_anti") if done else own
    path = f"{base}/versions/{version}/{name}/batch={(done[-1] if done else -1) + 1}"
    new.select(own.columns).dropDuplicates([key]).write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = spark.read.schema(TABLES[name]).parquet(path).count()
    if not written:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return written


def index_messages(messages: DataFrame, base: str, version: str, dim: int) -> int:
    """Index messages(id, chat_id, text, sender, date, is_from_me, embedding) that the version has not: texts of three characters or more, trimmed. How many were new."""
    own = messages.where("id IS NOT NULL AND length(trim(text)) >= 3")
    rows = own.select("id", F.col("chat_id").cast("string").alias("chat_id"), F.substring("text", 1, PREVIEW).alias("preview"), "sender", F.unix_seconds("date").alias("timestamp"), "is_from_me", "embedding")
    return _append(typed(rows, dim, "chat_id"), base, version, "messages", "id")


def passages(members: DataFrame) -> DataFrame:
    """segment_id, chat_id, timestamp, context, reply, n of members (segment_id, chat_id, id, date, is_from_me, text): what others said and what was answered, each in order, by lines, PASSAGE characters at most.

    Segments without context are left out. Only messages that begin within the passage, or right behind it (the line break before them is its last character), are gathered, however long a segment is.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("segment_id", "is_from_me").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, -1)
    said = members.where("text <> ''").withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).where(F.col("before") <= PASSAGE)
    part = lambda mine: F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_from_me") == mine, F.struct("date", "id", F.substring("text", 1, PASSAGE).alias("text"))))), lambda x: x["text"]), "\n"), 1, PASSAGE)
    texts = said.groupBy("segment_id").agg(part(False).alias("context"), part(True).alias("reply"))
    sizes = members.groupBy("segment_id").agg(F.first("chat_id").alias("chat_id"), F.unix_seconds(F.min("date")).alias("timestamp"), F.count("*").cast("int").alias("n"))
    return sizes.join(texts.where("context <> ''"), "segment_id").select("segment_id", F.col("chat_id").cast("string").alias("chat_id"), "timestamp", "context", "reply", "n")


def index_segments(members: DataFrame, centroids: DataFrame, base: str, version: str, dim: int) -> int:
    """Index segments that the version has not, from their members and centroids (segment_id, embedding); contacts are not known here (0). How many were new."""
    rows = passages(members).join(centroids.select("segment_id", "embedding"), "segment_id").withColumn("contact_id", F.lit(0).cast("long"))
    return _append(typed(rows, dim, "chat_id"), base, version, "segments", "segment_id")


def activate(spark: SparkSession, base: str, version: str) -> bool:
    """Make a version of the catalog the active one; False, and no change, if the catalog has it not."""
    if version not in _names(spark, f"{base}/versions"):
        return False
    n = max((int(x.split("-")[0]) for x in _names(spark, f"{base}/active")), default=-1) + 1
    fs, p = _fs(spark, f"{base}/active/{n:012d}-{version}")
    fs.create(p, True).close()
    return True


def active(spark: SparkSession, base: str) -> str | None:
    names = [x for x in _names(spark, f"{base}/active") if not x.startswith(".")]
    return names[-1].split("-", 1)[1] if names else None


def versions(spark: SparkSession, base: str, name: str = "messages") -> DataFrame:
    """version, model, dim, vectors, is_active of every version."""
    known = _names(spark, f"{base}/versions")
    now = active(spark, base)
    if not known:
        return spark.createDataFrame([], "version string, model string, dim int, vectors long, is_active boolean")
    meta = spark.read.schema("version string, model string, dim int").parquet(*[f"{base}/versions/{v}/meta" for v in known])
    sizes = None
    for v in known:
        one = read(spark, base, name, v).agg(F.count("*").alias("vectors")).withColumn("version", F.lit(v))
        sizes = one if sizes is None else sizes.unionByName(one)
    return meta.join(sizes, "version").select("version", "model", "dim", "vectors", F.col("version").eqNullSafe(F.lit(now)).alias("is_active"))


def staleness(messages: DataFrame, base: str) -> DataFrame:
    """messages, indexed, newest, newest_indexed, stale: one row; stale if the active version has not as many messages, or not the newest."""
    spark = messages.sparkSession
    own = messages.where("id IS NOT NULL AND length(trim(text)) >= 3").agg(F.count("*").alias("messages"), F.unix_seconds(F.max("date")).alias("newest"))
    held = read(spark, base, "messages").agg(F.count("*").alias("indexed"), F.max("timestamp").alias("newest_indexed"))
    one = F.lit(1).alias("one")
    both = own.select("*", one).join(F.broadcast(held.select("*", one)), "one")
    stale = (F.col("messages") != F.col("indexed")) | ~F.col("newest").eqNullSafe(F.col("newest_indexed"))
    return both.select("messages", "indexed", "newest", "newest_indexed", stale.alias("stale"))


def search(spark: SparkSession, base: str, query: list[float], limit: int, chat_id: str | None = None) -> DataFrame:
    """id, chat_id, distance: the messages of the active version nearest to a query by their bytes, ties by id; within a chat only its bucket is read."""
    from threadlake.operators.vectors import squared_distance

    rows = read(spark, base, "messages")
    if chat_id is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(chat_id)), F.lit(BUCKETS)).cast("int")).first()[0]
        rows = rows.where((F.col("bucket") == bucket) & (F.col("chat_id") == chat_id))
    q = quantise(F.array(*[F.lit(float(x)).cast("float") for x in query]))
    return rows.select("id", "chat_id", F.sqrt(squared_distance("embedding", q)).alias("distance")).orderBy("distance", "id").limit(limit)
