"""Connected components by alternating stars, on Spark alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm._shared import stored

#: Edges that one task unites in memory (about 100 MB of names); more go in rounds over all tasks. Both give the same.
FEW = 1_000_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked node of 0..n-1 to the smallest of its component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        # The old labels' roots learn too, so that what was joined before moves as one.
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.string()), ("b", pa.string())]))
    both = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], pa.string())
    names = pc.unique(both)
    names = names.take(pc.sort_indices(names))
    at = lambda c: pc.index_in(table.column(c), names).to_numpy().astype(np.int64)
    node, root = forest(at("a"), at("b"), len(names))
    label = np.arange(len(names))
    label[node] = root
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), strings: component is the smallest node reachable.

    Up to FEW distinct edges are united in one task. Beyond that each round links the larger neighbours of a node to
    its smallest (large star), then the smaller ones (small star), until nothing changes: O(log^2) rounds. Only minima by node
    are aggregated, never lists, and the edges of a hub are dealt to many tasks. Rounds are written to the shared folder, which cuts
    the lineage. Edges may repeat, be reversed, or join a node to itself; nulls must be filtered before.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count = pairs.count()
    if count <= FEW:
        return pairs.coalesce(1).mapInArrow(_united, "node string, component string")
    # At most 2 * count / most nodes have over `most` edges: 40,000 names are broadcast at most.
    most, mark = max(4096, count // 20_000), None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        large = _star(both, most).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large.union(pairs.where("a = b")), "edges")
        low = large.where("a <> b")
        small = _with_least(low, low.groupBy("a").agg(F.min("b").alias("m")), most).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = stored(small.where("a <> b").union(large.where("a = b")).distinct(), "edges")
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))


def _star(both: DataFrame, most: int) -> DataFrame:
    """(u, v, m): each edge with the smallest of u and its neighbours."""
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both, least, most).select(F.col("a").alias("u"), F.col("b").alias("v"), "m")


def _with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """Edges with their node's row of least. The edges of a node that has over `most` are dealt to 64 tasks, its row goes to each."""
    hubs = F.broadcast(edges.groupBy("a").count().where(F.col("count") > most).select("a", F.lit(True).alias("hub")))
    cell = F.when(F.col("hub"), F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")).otherwise(-1)
    cells = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(-1)))
    own = edges.join(hubs, "a", "left").withColumn("cell", cell).drop("hub")
    return own.join(least.join(hubs, "a", "left").withColumn("cell", F.explode(cells)).drop("hub"), ["a", "cell"]).drop("cell")
