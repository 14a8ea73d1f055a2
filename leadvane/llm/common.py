"""Shared folders, table reads and text expressions of the operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadvane.session import configure, ensure_checkpoint_dir

#: Characters that part words and are trimmed from lines: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of at most so many longs are broadcast after they were counted (8 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Whether Spark removes the shuffle files of a query when it ends, rather than when its plan is garbage on the driver.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, because a row may hold a very long text."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the one that driver and executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors, has known size.

    The shuffle files of the write go with it, so that the steps of an operator do not add up on disk. Only the write is run
    that way: a frame that is collected twice still needs its own.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, tag), spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def keyed(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Join ``rows`` with the written single-column table ``keys``; broadcast only after its rows were counted."""
    few = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, keys.columns, how)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Text without other letters takes the faster built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def blank_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))
