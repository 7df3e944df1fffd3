"""Token counts through a digest cache."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm._shared import releasing, shared_dir, spread, table, text_batches
from grove.llm._tokenizer import encoder, file_digest

CACHE_SCHEMA = "tokenizer_digest string, content_digest string, n_tokens long"
#: A text with more tokens than this is over the limit.
LIMIT = 2048


def _model_file(path: str) -> bool:
    return path.endswith(".model")


@releasing
def _encode_counts(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _model_file(path):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in pieces.encode([t or "" for t in texts], num_threads=1)]
        else:
            count = lambda texts: [len(x) // 4 for x in encoder(path).encode(texts)]
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(count(batch.column("text").to_pylist()), pa.int64())], ["content_digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row per row of docs.

    tokenizer: a .json file for the tokenizers library or a .model file for sentencepiece, at the same path
    on every executor. cache: a folder in a store that all executors reach; it holds Parquet rows
    (tokenizer_digest, content_digest, n_tokens). Contents with no row under this tokenizer's digest are
    encoded once per distinct content and appended; a lost executor repeats only its tasks of that append.

    Normalisation: none but null to empty, as no other keeps the counts of every tokenizer. Equal texts thus
    share a row. Null texts count as empty. Null and repeated ids stay as they are. Other columns of docs
    are not read, whatever their names.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer) if not _model_file(tokenizer) else _piece_digest(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content_digest", F.sha2("text", 256))
    known = _cached(spark, cache, version)
    # One row of each content is encoded: copies meet in the tasks that read them, before any text moves.
    texts = rows.select("content_digest", "text").dropDuplicates(["content_digest"])
    if known is not None:
        texts = texts.join(known, "content_digest", "left_anti")
    counted = texts.mapInArrow(_encode_counts(tokenizer), "content_digest string, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(cache)
    # Where two runs have appended the same content, their counts are equal.
    counts = _cached(spark, cache, version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    slim = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    # Copies of one content are dealt to several tasks by their ids, or else by their places.
    own = F.coalesce(F.xxhash64("id"), F.lit(0)) + F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    return spread(slim, counts, "content_digest", own, 8).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _piece_digest(path: str) -> str:
    import hashlib

    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. The cache is new with every run, so that each distinct text is encoded."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
