"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "_threadlake_shipped"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, so that tasks can import it wherever they run.

    Texts may be long, so rows go to Python in smaller batches than Spark's default, unless the session says otherwise.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), f"threadlake-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("threadlake", os.path.relpath(full, root)))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder that driver and executors share, under spark.checkpoint.dir.

    Where that is unset, a session on one machine (as in tests) gets a temporary folder; on a cluster it is an error, as executors
    would write to disks of their own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = getattr(sc, "_threadlake_dir", None)
        if made is None:
            made = "file://" + tempfile.mkdtemp(prefix="threadlake-")
            sc._threadlake_dir = made
        path = made
    return f"{path.rstrip('/')}/threadlake/{sc.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and return it read back: lineage is cut and every copy survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has stored. Results that are not yet computed or written may still need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Have every executor collect garbage, so that heaps grown in one heavy step are small again before the next.

    Live data are few between steps; what has grown is free space, which otherwise adds to what Python workers take. The
    calls go through Spark's own function for static methods, a few a core, so that each executor gets some.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by the hash of a key over two tasks a core: a file of few bytes but many rows is one task otherwise, however long each row takes."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has most rows or fewer; beyond that the join is left to Spark. Counting df is an action."""
    return F.broadcast(df) if df.count() <= most else df
