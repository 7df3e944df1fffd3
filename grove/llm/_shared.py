"""What the training-data operators share: table access, the folder all executors see, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to one pass of a numpy kernel, in bytes of UTF-8.
KERNEL_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new temporary one, on one machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='grove-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that stored() has written since the last cleared().
WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Deletes what stored() has written so far, for a caller that has no more use for any result; how many folders."""
    jvm, conf, many = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(WRITTEN)
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return many


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with marks added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def packed(df: DataFrame, *more: Column, leave: str = "") -> DataFrame:
    """(row, more): all columns of df (but one) in a struct, so that names given to others can't clash with them. row.* unpacks it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != leave)).alias("row"), *more)


def unpacked(df: DataFrame, made: dict[str, Column]) -> list[Column]:
    """The columns of df, from the struct that packed() has made and, where named in made, from that."""
    return [made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in df.columns]


def spread(rows: DataFrame, few: DataFrame, key: str | list[str], by: Column, salts: int = 16) -> DataFrame:
    """rows joined with few (one row a key): a key's rows are dealt to `salts` tasks by a hash of `by`, its row of few goes to each."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(each, [*([key] if isinstance(key, str) else key), "_salt"]).drop("_salt")


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives a worker's free memory back to the system when a partition ends: workers live on, beside the next stage's."""

    @wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def releasing(factory: Callable) -> Callable:
    """A factory of functions over batches, whose functions are released()."""

    @wraps(factory)
    def make(*args: object) -> Callable:
        return released(factory(*args))

    return make


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds about `limit` bytes at most (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            n = 0 if n != n else int(n)
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of the whole input: as the session has it."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor (null: -1, which is no remainder)."""
    return F.coalesce(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % F.lit(divisor), F.lit(-1))
