"""Where intermediate results go: always a folder that the driver and all executors share."""

from __future__ import annotations

import gc
import os
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.operators.shared import checkpoint, checkpoint_dir

__all__ = ["checkpoint", "checkpoint_dir"]


#: Rows of documents in an Arrow batch.
BATCH_ROWS = 1000


def settled(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A checkpoint in as many partitions as its rows need: small results of wide shuffles stay cheap to use."""
    df = checkpoint(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def written(df: DataFrame, *partition_by: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared folder, and a function that deletes it once nothing lazy reads it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)

    return spark.read.schema(df.schema).parquet(path), lambda: deleted(spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``keyed``, whose column ``n`` says how many rows each key has.

    Keys with over a thousandth of all these rows are under a thousand; they are
    joined by broadcast, so no hot key meets in one task. ``keyed`` is read three
    times and should be stored.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    least = max(1000, total // 1000)
    hot = keyed.where(F.col(n) > least)
    both = rows.join(keyed.where(F.col(n) <= least).drop(n), keys, how)
    if total <= least or hot.isEmpty():
        return both
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(n) <= least).drop(n), keys, how)
    return rows.join(F.broadcast(hot.drop(n)), keys, how).unionByName(cold)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle and checkpoint files of steps that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def short_batches(spark: SparkSession) -> None:
    """Let tasks hand texts to Python in batches of at most ``BATCH_ROWS`` rows.

    Spark's own default, 10,000 rows, is tens or hundreds of MB of texts, held
    several times over by each task. It is lowered for the session, unless the
    session was given a value of its own; it changes no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_ROWS))


def least_of_top(df: DataFrame, count: str, limit: int) -> int:
    """The smallest c for which at most ``limit`` rows have ``count`` >= c (up to a rounding to 1/1024 of a power of two).

    Two histograms of at most 64 and 1,024 rows reach the driver, whatever the size.
    """
    c = F.col(count).cast("long")
    size = {r[0]: r[1] for r in df.groupBy(F.length(F.bin(c)).alias("k")).agg(F.count(F.lit(1))).collect()}
    total = 0
    for k in sorted(size, reverse=True):
        if total + size[k] > limit:
            break
        total += size[k]
    else:
        return 1
    low, width = 1 << (k - 1), max(1, (1 << (k - 1)) >> 10)
    parts = df.where(c.between(low, 2 * low - 1)).groupBy(F.floor((c - low) / width).cast("long").alias("p")).agg(F.count(F.lit(1))).collect()
    least = 2 * low
    for p, n in sorted(((r[0], r[1]) for r in parts), reverse=True):
        if total + n > limit:
            break
        total, least = total + n, low + p * width
    return least


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of)).cast("int")


def fold_py(doc_id: object, of: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use yet (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def file_bytes(path: str) -> bytes:
    with open(os.fspath(path), "rb") as f:
        return f.read()
