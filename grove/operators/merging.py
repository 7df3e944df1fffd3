"""Merges of branches: clean text merges, what is carried over, cherry-picks, merges into other branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators import diff, texts, workflow


def auto_resolved(changes: DataFrame, base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """changes with conflicts of two modified texts merged where that is clean: no conflict then, and the digest is that of the merged text.

    base, ours and theirs are the contents (path, text) of the merge's base, target and source.
    """
    asked = changes.where("conflict and action = 'keep'").select("path")
    side = lambda df, n: df.select("path", F.col("text").alias(n))
    rows = asked.join(side(base, "base"), "path").join(side(ours, "ours"), "path").join(side(theirs, "theirs"), "path")
    clean = texts.merges(rows, "path", "base", "ours", "theirs").where("conflicts = 0").select(F.col("path").alias("_p"), F.sha2("text", 256).alias("_h"))
    met = changes.join(clean, changes["path"] == clean["_p"], "left")
    done = F.col("_p").isNotNull() & F.col("conflict") & (F.col("action") == "keep")
    made = {"hash": F.when(done, F.col("_h")).otherwise(F.col("hash")), "conflict": F.col("conflict") & ~done}
    return met.select(*(made.get(c, F.col(c)).alias(c) for c in changes.columns))


def content_diffs(changes: DataFrame, before: DataFrame, after: DataFrame, **how) -> DataFrame:
    """(path, diff): unified differences of the files that changes modify or move in place, from contents (path, text)."""
    rows = changes.where("action = 'keep'").select("path").join(before.select("path", F.col("text").alias("old")), "path").join(after.select("path", F.col("text").alias("new")), "path")
    return texts.diffs(rows, "path", "old", "new", **how)


def merge_patches(paths: DataFrame, base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, patch, conflicts): what merging theirs changes in ours, as a unified difference."""
    side = lambda df, n: df.select("path", F.col("text").alias(n))
    rows = paths.select("path").join(side(base, "base"), "path").join(side(ours, "ours"), "path").join(side(theirs, "theirs"), "path")
    merged = texts.merges(rows, "path", "base", "ours", "theirs").join(side(ours, "ours"), "path")
    patch = texts.diffs(merged, "path", "ours", "text").withColumnRenamed("diff", "patch")
    return patch.join(merged.select("path", "conflicts"), "path")


def picked(parent: DataFrame, revision: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the current snapshot after a revision's changes to its parent, its conflicts): a merge whose base is the parent."""
    changes = diff.diff3(parent, revision, current)
    return diff.merged(current, changes), changes.where("conflict")


def merged_into(base: DataFrame, source: DataFrame, target: DataFrame, tips: DataFrame, into: int, origin: int, message: str) -> tuple[DataFrame, DataFrame]:
    """(the new revision, conflicts) of merging one branch into another without leaving it: tips (branch, revision, number)."""
    changes = diff.diff3(base, source, target)
    parents = tips.where(F.col("branch").isin(into, origin)).select(F.when(F.col("branch") == into, 0).otherwise(1).alias("place"), "revision", "number")
    return workflow.revision(parents, diff.merged(target, changes), into, message), changes.where("conflict")


def server_merged(base: DataFrame, pushed: DataFrame, head: DataFrame, tips: DataFrame, branch: int) -> DataFrame:
    """The revision that joins a push that is behind with its branch's head: none where they conflict. tips has places 0 (head) and 1 (pushed)."""
    changes = diff.diff3(base, pushed, head)
    free = changes.agg(F.coalesce(F.bool_or("conflict"), F.lit(False)).alias("any")).where("not any")
    return workflow.revision(tips, diff.merged(head, changes), branch, "merge").join(F.broadcast(free)).drop("any")


def classified(met: DataFrame) -> DataFrame:
    """met (path, target_hash, current_hash; null: not there) with what a merge does to the current side: add, delete, modify, none."""
    t, c = F.col("target_hash"), F.col("current_hash")
    action = F.when(t.isNull() & c.isNull(), "none").when(c.isNull(), "add").when(t.isNull(), "delete").when(t != c, "modify").otherwise("none")
    return met.withColumn("action", action)


def carried(changes: DataFrame, answers: DataFrame) -> DataFrame:
    """changes with conflicts settled as in an earlier attempt at the same merge: answers (path, hash, from_hash, answer) of equal contents are used again."""
    known = answers.select(F.col("path").alias("_p"), F.col("hash").alias("_h"), F.col("from_hash").alias("_f"), "answer")
    same = (changes["path"] == known["_p"]) & changes["hash"].eqNullSafe(known["_h"]) & changes["from_hash"].eqNullSafe(known["_f"]) & changes["conflict"]
    met = changes.join(known, same, "left").where(~(F.col("conflict") & (F.coalesce("answer", F.lit("")) == "mine")))
    return met.withColumn("conflict", F.col("conflict") & F.col("answer").isNull()).select(*changes.columns)


def eligible_links(links: DataFrame, base: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(mount, action) of links (mount) by their pins (mount, revision) on three sides: `take` where the source alone moved, `merge` where both moved
    apart, `keep` else."""
    pin = lambda df, n: df.select("mount", F.col("revision").alias(n))
    met = links.select("mount").join(pin(base, "b"), "mount", "left").join(pin(source, "s"), "mount", "left").join(pin(target, "t"), "mount", "left")
    moved = lambda x: ~F.col(x).eqNullSafe(F.col("b"))
    action = F.when(~moved("s") | F.col("s").eqNullSafe(F.col("t")), "keep").when(~moved("t"), "take").otherwise("merge")
    return met.select("mount", action.alias("action"))


def united(main: DataFrame, *mounts: tuple[str, DataFrame]) -> DataFrame:
    """Changes of a repository and of what is mounted in it, at their mounts; null mount is the repository itself."""
    rows = main.withColumn("mount", F.lit(None).cast("string"))
    at = lambda mount, c: F.when(F.col(c).isNotNull(), F.concat_ws("/", F.lit(mount), c)).alias(c)
    for mount, own in mounts:
        rows = rows.unionByName(own.select(*(at(mount, c) if c in ("path", "from_path") else F.col(c) for c in main.columns), F.lit(mount).alias("mount")))
    return rows


def merged_metadata(own: DataFrame, source: DataFrame) -> DataFrame:
    """Entries (revision, key, ...) of the source over one's own."""
    return own.join(source.select("revision", "key"), ["revision", "key"], "left_anti").unionByName(source)
