"""Dependencies between files: closures, cycles, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.session import checkpointed


def direct(deps: DataFrame, roots: DataFrame, reverse: bool = False) -> DataFrame:
    """(source, target, tags): edges from the roots (node), or to them, with their tags merged."""
    side = "target" if reverse else "source"
    return merged_tags(deps.join(roots.select(F.col("node").alias(side)), side, "left_semi"))


def merged_tags(deps: DataFrame) -> DataFrame:
    """(source, target, tags): the sorted distinct tags of each edge."""
    return deps.groupBy("source", "target").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def closure(deps: DataFrame, roots: DataFrame, *, tags: list[str] | None = None, depth: int = 0, reverse: bool = False) -> DataFrame:
    """(node, depth): what the roots (node) depend on, at the least number of edges; roots only if they are reached.

    tags: edges with any of them alone, at every step (none: all). depth: so many steps at most (0: no limit). A round joins the
    frontier with the edges and drops what was seen; rounds are written to the checkpoint folder.
    """
    edges = deps.where(F.col("tag").isin(*tags)) if tags else deps
    a, b = ("target", "source") if reverse else ("source", "target")
    edges = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    seen = None
    frontier, d = roots.select(F.col("node").alias("a")).distinct(), 0
    while not depth or d < depth:
        d += 1
        new = edges.join(frontier, "a", "left_semi").select(F.col("b").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, "node", "left_anti")
        new = checkpointed(new.withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = new if seen is None else checkpointed(seen.unionByName(new))
        frontier = new.select(F.col("node").alias("a"))
    return seen if seen is not None else roots.select("node", F.lit(0).alias("depth")).limit(0)


def included(deps: DataFrame, roots: DataFrame, **how) -> DataFrame:
    """(node): the roots and all they depend on."""
    return roots.select("node").unionByName(closure(deps, roots, **how).select("node")).distinct()


def makes_cycle(deps: DataFrame, source: int, target: int) -> bool:
    """Whether an edge from source to target would close a cycle."""
    if source == target:
        return True
    start = deps.sparkSession.createDataFrame([(target,)], "node long")
    return not closure(deps, start).where(F.col("node") == source).isEmpty()


def on_cycles(deps: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves: those of strongly connected components of two nodes or more, and those with an edge to themselves.

    Nodes without an edge in or out are peeled off. Each other node takes the least number of those that reach it; a node
    that kept its own is one of its component, which are the nodes of its number that reach it. They go, and the rest is taken again. Only a
    number a node is kept, never pairs; rounds follow the longest shortest path.
    """
    edges = checkpointed(deps.select("source", "target").distinct())
    done = edges.where("source = target").select(F.col("source").alias("node"))
    edges = edges.where("source <> target")
    while True:
        many = -1
        while (now := edges.count()) != many:
            many = now
            heads, tails = edges.select(F.col("target").alias("source")).distinct(), edges.select(F.col("source").alias("target")).distinct()
            edges = checkpointed(edges.join(heads, "source", "left_semi").join(tails, "target", "left_semi").select("source", "target"))
        if not many:
            return done.distinct()
        color = checkpointed(edges.select(F.col("source").alias("node"), F.col("source").alias("color")).distinct())
        while True:
            came = edges.join(color.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("color").alias("came"))
            new = color.join(came, "node", "left").select("node", F.least("color", F.coalesce("came", "color")).alias("color"), (F.col("came") < F.col("color")).alias("moved"))
            new = checkpointed(new)
            moved = not new.where("moved").isEmpty()
            color = new.select("node", "color")
            if not moved:
                break
        # Edges within one number: backwards from the node that gave it.
        own = color.withColumnRenamed("node", "source")
        inner = edges.join(own, "source").join(color.select(F.col("node").alias("target"), F.col("color").alias("to")), "target").where("color = to").select("source", "target")
        inner = checkpointed(inner)
        found = checkpointed(color.where("node = color"))
        frontier = found
        while True:
            back = inner.join(frontier.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node"), "color").distinct().join(found.select("node"), "node", "left_anti")
            frontier = checkpointed(back)
            if frontier.isEmpty():
                break
            found = checkpointed(found.unionByName(frontier))
        large = found.groupBy("color").agg(F.count("*").alias("n")).where("n > 1").select("color")
        done = checkpointed(done.unionByName(found.join(large, "color", "left_semi").select("node")))
        gone = found.select("node")
        edges = checkpointed(edges.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))


def add(deps: DataFrame, new: DataFrame, acyclic: bool = False) -> DataFrame:
    """deps with new edges; with acyclic those that would lie on a cycle are refused, all of a cycle's new edges together."""
    both = deps.unionByName(new.select(*deps.columns)).distinct()
    if not acyclic:
        return both
    bad = on_cycles(both)
    refused = new.join(bad.withColumnRenamed("node", "source"), "source", "left_semi").join(bad.withColumnRenamed("node", "target"), "target", "left_semi").select(*deps.columns)
    return both.join(refused, list(deps.columns), "left_anti")


def remove(deps: DataFrame, gone: DataFrame) -> DataFrame:
    """deps without edges of gone: with a tag that tag alone, with a null tag all of the edge."""
    whole = gone.where("tag is null").select("source", "target")
    return deps.join(whole, ["source", "target"], "left_anti").join(gone.where("tag is not null").select("source", "target", "tag"), ["source", "target", "tag"], "left_anti").select(*deps.columns)
