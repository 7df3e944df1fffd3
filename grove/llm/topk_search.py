"""Exact top-k search by tiled matrix products of queries and shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm._shared import table

#: Vectors of a shard and queries of a block: what one task holds.
SHARD, BLOCK = 65_536, 16_384
#: Sides of a tile: one matrix product.
TILE_QUERIES, TILE_ROWS = 512, 4_096
#: Top lists merged at once in a node of the merging tree.
FAN = 32
#: Shards at least, so that a small table still keeps all cores busy.
LEAST_SHARDS = 12

LISTS = "query_id long, query long, cell int, vec_id array<long>, score array<long>"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long; null for vectors that are null or hold null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return F.when(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), whole)


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where every partial sum is a whole number below 2^53, else in 64-bit integers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return q @ rows.T


def merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[at], scores[at]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _tile(k: int):
    def run(key: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
        cell, found = key[0].as_py(), {}
        for dim in set(queries.column("dim").to_pylist()) & set(shard.column("dim").to_pylist()):
            qid, q, which = _matrix(queries, dim)
            vid, rows, _ = _matrix(shard, dim)
            for i in range(0, len(qid), TILE_QUERIES):
                tops: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qid[i : i + TILE_QUERIES])
                for j in range(0, len(vid), TILE_ROWS):
                    ids, scores = vid[j : j + TILE_ROWS], products(q[i : i + TILE_QUERIES], rows[j : j + TILE_ROWS])
                    for n, (top_ids, top_scores) in enumerate(tops):
                        some = scores[n]
                        if len(top_scores) == k:  # what a full list would take in; equal scores may have smaller ids
                            at = np.flatnonzero(some >= top_scores[-1])
                            new_ids, some = ids[at], some[at]
                        else:
                            new_ids = ids
                        other = new_ids != qid[i + n]
                        tops[n] = merge(np.concatenate([top_ids, new_ids[other]]), np.concatenate([top_scores, some[other]]), k)
                found.update({(dim, i + n): (qid[i + n], which[i + n], t) for n, t in enumerate(tops)})
        rows_out = [(q, w, t[0].tolist(), t[1].tolist()) for q, w, t in found.values()]
        names = ["query_id", "query", "cell", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [[r[0] for r in rows_out], [r[1] for r in rows_out], [cell] * len(rows_out), [r[2] for r in rows_out], [r[3] for r in rows_out]]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    return run


def _matrix(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = rows.filter(pa.compute.equal(rows.column("dim"), dim))
    flat = own.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return own.column("id").to_numpy(), flat.reshape(own.num_rows, dim), own.column("query").to_numpy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest inner products with rows of other id.

    Both sides have id_col, a long, and vector_col, an array of numbers, of which floor(scale * x) is taken in
    each component. Ties go to the smaller id; a query with fewer than k candidates gets all. Rows whose id or vector
    is null, or whose vector holds null or non-finite components, take no part; vectors meet those of
    their own length only. Repeated rows are candidates each, and repeated queries one; queries that share an id but not the vector have a list each. Components that don't fit a long are held at
    its ends, and sums beyond it wrap. Empty tables give no rows. Other columns are not read.

    Shards of vectors and blocks of queries, both of fixed size, meet in a grid of cells: a vector is sent to
    each block, a query to each shard. A cell goes through tiles and keeps a list of k for each query; lists are
    merged in a tree of fixed fan.
    """
    took = lambda df: df.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), scale).alias("q")).where("id is not null and q is not null").withColumn("dim", F.size("q"))
    rows, asked = took(vectors), took(queries).dropDuplicates(["id", "q"])
    n, m = vectors.count(), queries.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD)), max(1, -(-m // BLOCK))
    # A row's place in its partition tells copies apart, so that they don't meet in one shard.
    dealt = lambda df, many, other: df.withColumn("query", F.xxhash64("q")).withColumn("own", F.pmod(F.xxhash64("id", "query", F.monotonically_increasing_id()), F.lit(many)).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    left = dealt(asked, blocks, shards).select((F.col("met") * blocks + F.col("own")).alias("cell"), "id", "dim", "q", "query")
    right = dealt(rows, shards, blocks).select((F.col("own") * blocks + F.col("met")).alias("cell"), "id", "dim", "q", "query")
    lists = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_tile(k), LISTS)
    pairs = F.transform(F.arrays_zip("score", "vec_id"), lambda x: F.struct((-x["score"]).alias("s"), x["vec_id"].alias("v")))
    tops = lists.select("query_id", "query", (F.col("cell") / blocks).cast("int").alias("shard"), pairs.alias("top"))
    width = shards
    while True:
        width = -(-width // FAN)
        parent = (F.col("shard") / FAN).cast("int")
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        tops = tops.groupBy("query_id", "query", parent.alias("shard")).agg(merged.alias("top"))
        if width <= 1:
            break
    ranked = tops.select("query_id", F.posexplode("top").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.v").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
