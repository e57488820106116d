"""Small helpers of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts for each core that rows are dealt into.
PARTS_A_CORE = 4
#: The session's setting that a finished query's shuffle files go at once, not when the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints in spark.checkpoint.dir, which all executors share.

    Only a session on one machine may name no folder; then one of this process's own is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docspark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` for tables of very many rows or of long texts: written as compressed columns, of which a reader takes those that it needs. What was shuffled for it is removed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores by ``keys``: joins by them find it in place, and a task that is run again sends each row where it sent it before."""
    spark = df.sparkSession
    return df.repartition(max(PARTS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def dealt(df: DataFrame, together: Column | None = None) -> DataFrame:
    """``df`` dealt evenly over all cores, row by row, for stages that cost far more a row than moving it.

    The partitions of a file are those of its row groups, and a compact table of very many rows has one. Rows go by their number, so that equal rows part and none are sorted; those where
    ``together`` is not null go by it, which is for values that a task remembers. A stream stays as it is.
    """
    if df.isStreaming:
        return df
    number = F.monotonically_increasing_id()
    parts = PARTS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, number if together is None else F.when(together.isNull(), number).otherwise(F.xxhash64(together)))
