"""Notifications as a stream: subscriptions, the latest push of each branch, counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.session import shared_dir
from grove.sources.fixtures import as_events


def source(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """The events of the Parquet files at a path, as they come; a single file is a folder's only file by its name."""
    schema = spark.read.parquet(path).schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return as_events(stream.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString()))
    return as_events(stream.parquet(path))


def subscribed(events: DataFrame, repository: int, kinds: tuple[str, ...] = ()) -> DataFrame:
    rows = events.where(F.col("repository") == repository)
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def latest_pointers(events: DataFrame) -> DataFrame:
    """(repository, branch, number): the highest number pushed; state of a row a branch."""
    return events.where("kind = 'BranchPushed'").groupBy("repository", "branch").agg(F.max("number").alias("number"))


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("repository", "kind").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) in windows of event time, our own extension; rows later than the watermark are dropped and state with them."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def published(events: DataFrame, path: str) -> None:
    """Adds events to the files of a stream's source."""
    events.write.mode("append").parquet(path)


def drained(stream: DataFrame, mode: str = "complete", path: str | None = None) -> DataFrame:
    """All that a stream gives until its source is read to the end, as a table of files in the shared folder.

    With mode append rows are added to the files as they are final; a later call with the same path goes on behind what was
    acknowledged. With mode complete each batch's whole result replaces the one before.
    """
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/acks").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        run = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/rows")).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
