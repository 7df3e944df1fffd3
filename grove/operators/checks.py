"""What must hold between tables, and joins across repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.operators import graph


def orphans(nodes: DataFrame, root: str) -> DataFrame:
    """Nodes (node_id, parent_id) whose parent is neither there nor the root."""
    known = nodes.select(F.col("node_id").alias("parent_id"))
    return nodes.where(F.col("parent_id") != root).join(known, "parent_id", "left_anti").select("node_id")


def same_names(nodes: DataFrame) -> DataFrame:
    """(parent_id, lower, n): siblings of one name in any case."""
    return nodes.groupBy("parent_id", F.lower("name").alias("lower")).agg(F.count("*").alias("n")).where("n > 1")


def missing_content(tree: DataFrame, store: DataFrame) -> DataFrame:
    """(path) of files whose digest the store lacks."""
    return tree.join(store.select("hash"), "hash", "left_anti").select("path")


def missing_parents(revs: DataFrame) -> DataFrame:
    """(revision) with a parent that isn't there."""
    known = revs.select(F.col("revision").alias("p")).distinct()
    parents = revs.select("revision", F.explode(F.array_compact(F.array("parent_self", "parent_other"))).alias("p"))
    return parents.join(known, "p", "left_anti").select("revision").distinct()


def matched_by_metadata(layer: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(revision, source_revision): for each revision of a layer the nearest source revision with the same value under a key.

    layer and source have (revision, key, str); source has distance too.
    """
    value = lambda df: df.where(F.col("key") == key)
    best = value(source).groupBy("str").agg(F.min_by("revision", F.struct("distance", "revision")).alias("source_revision"))
    return value(layer).join(best, "str").select("revision", "source_revision")


def limited_to_dependencies(tree: DataFrame, deps: DataFrame, roots: DataFrame, **how) -> DataFrame:
    """Files whose id is a root or something a root depends on."""
    keep = graph.included(deps, roots, **how).select(F.col("node").alias("file_id"))
    return tree.join(keep, "file_id", "left_semi").select(*tree.columns)


def named(rows: DataFrame, users: DataFrame, column: str = "owner") -> DataFrame:
    """rows with the display name of their user (id, name); the id as text where there is none."""
    known = users.select(F.col("id").alias("_u"), F.col("name").alias("_name"))
    return rows.join(known, rows[column] == known["_u"], "left").withColumn("user", F.coalesce("_name", F.col(column).cast("string"))).drop("_u", "_name")


def woven(revs: DataFrame, changed: DataFrame) -> DataFrame:
    """(file, revision, previous): each change of a file (revision, file) with the one before it on its branch."""
    rows = changed.join(revs.select("revision", "branch", "number"), "revision")
    return rows.select("file", "revision", F.lag("revision").over(Window.partitionBy("file", "branch").orderBy("number")).alias("previous"))


def last_merged(revs: DataFrame, into: int, source: int) -> DataFrame:
    """(revision, merged): the newest revision of a branch that merged one of the source branch, with what it merged."""
    own = revs.where((F.col("branch") == into) & F.col("parent_other").isNotNull()).select("revision", "number", F.col("parent_other").alias("merged"))
    theirs = revs.where(F.col("branch") == source).select(F.col("revision").alias("merged"))
    return own.join(theirs, "merged", "left_semi").orderBy(F.desc("number")).limit(1).select("revision", "merged")
