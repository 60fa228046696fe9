"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: Rows up to which a side may be broadcast; the rows that are broadcast are narrow (a key and a few numbers).
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Texts are long, so Python workers get them in Arrow batches of at most that size; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a written table in the shared folder: what lies before it is never run again when executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else df as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back(spark: SparkSession) -> None:
    """Return to the system what the driver holds but no longer needs: models that an earlier step has built in Python and
    the pages that they leave, and in the JVM plans, broadcasts and the heap that they made grow. The executors' JVMs give
    back their heaps too; they are reached by as many tasks as can run at once, and one that gets none keeps what it has."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
    spark.sparkContext._jvm.java.lang.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else: lower() where all is ASCII, translate() otherwise."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def crc_mod(n: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
