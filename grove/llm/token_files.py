"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.llm._shared import partitions, releasing, shared_dir, table, text_batches
from grove.llm._tokenizer import encoder

#: part and row give the order over all files; ids end with the end id.
FILE_SCHEMA = "doc_id long, part int, row long, n_tokens long, ids array<int>"


@releasing
def _encode(path: str, end_id: int | None):
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in text_batches(batches):
            ids = [x + tail for x in encoder(path).encode(batch.column("text").to_pylist())]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))],
                ["doc_id", "part", "row", "n_tokens", "ids"],
            )
            row += n

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, stride: int = 1000, stripe: int = 64 << 20, compression: str = "zstd") -> None:
    """Encodes every text of docs (null: empty) and writes the ids to ORC files under path, in ascending id order.

    Ids are range-partitioned, one file a partition, and sorted within; null ids come first, rows that share
    an id are in order of a hash of their text, by which they are partitioned too. end_id is appended to each document (None: nothing
    is). Each file has stripes of `stripe` bytes that can be read in parallel, a row index every `stride` rows, and Bloom filters on
    doc_id, so a reader that filters on doc_id skips stripes and row groups. An empty table gives files without rows.
    Other columns of docs are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(files or partitions(docs), *order).sortWithinPartitions(*order, "text")
    ids = ordered.mapInArrow(_encode(tokenizer, end_id), FILE_SCHEMA)
    ids.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", stride).option("orc.create.index", "true").option("orc.stripe.size", stripe).option("orc.rows.between.memory.checks", 100).option("compression", compression).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows (FILE_SCHEMA). Filters on doc_id reach the ORC reader."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: start is the number of ids before it.

    Sums within a file are taken over a file's rows, and those of files (a row each) over all files.
    """
    read = read_tokens(spark, path)
    digests = read.select("doc_id", "part", "row", "ids").mapInArrow(_digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = sums.select(F.col("part").alias("at"), F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("row")), F.lit(0))
    rows = digests.withColumn("within", within)
    return rows.join(offsets, rows["part"] == offsets["at"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_index(spark, path)
