"""The session's settings, and how long plans are cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Adaptive execution re-plans joins, splits skewed partitions and merges small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "grove", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='grove-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries planned within leave no shuffle files. For what is written: a query that is run again would miss them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, which all executors reach; a temporary folder where none is set, on one machine alone."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    with cleaned(spark):
        return df.select("*").checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the checkpoint folder in columns, compressed, and read again: for tables whose size counts."""
    return stored_parts([df], name)


def stored_parts(parts: list[DataFrame], name: str) -> DataFrame:
    """Tables of the same columns stored as one, one after the other, so that the shuffle of one alone is on disk at a time."""
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for df in parts:
        with cleaned(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


#: Rows that are sent to all executors at most.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """df checkpointed, and marked for a broadcast where it has no more than FEW rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= FEW else df
