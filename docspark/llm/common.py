"""Shared small helpers: table reading, shared-folder checkpoints, partition counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from docspark.shared import cut as cut
from docspark.shared import shared_folder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the checkpoints, which all machines share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where its files give under half as many; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts or packed vectors don't fill the executors' memory outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the rows of an Arrow batch for the jobs that run inside, and gives the session its own setting back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows to a range of a numbering.
NUMBERED = 1 << 18


def on_group(left: DataFrame, right: DataFrame, keys: list[str], how: str, more: Column) -> DataFrame:
    """All columns of ``left`` and one more; nulls in the keys are equal."""
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys], how).select("l.*", more)


def numbered(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """``df`` with ``_at``: numbers from 0 without gaps for each value of ``keys``, by ``order``; ``n`` is about the table's rows.

    Rows are sorted into ranges and written, so that the counts of the ranges and the places in them come from the same rows. The last of ``order`` should part rows that
    are equal otherwise, so that a common value is spread over ranges.
    """
    order = [*keys, *order]
    ranges = max(1, -(-n // NUMBERED))
    sorted_ = cut(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    # a row for each range and each of the keys' values that begin in it or go on
    starts = sorted_.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.select(*keys, "_range", F.coalesce("_start", F.lit(0)).alias("_start"))
    inside = sorted_.withColumn("_in", F.row_number().over(W.partitionBy("_range", *keys).orderBy(*order)) - 1)
    both = on_group(inside, starts, ["_range", *keys], "inner", F.col("r._start").alias("_start"))
    return both.withColumn("_at", (F.col("_start") + F.col("_in")).cast("long")).drop("_range", "_start", "_in")
