"""Snapshots with directories: changes of files, directories and kinds, three-way merges of them, status rows.

A snapshot has (path, kind, file_id, hash, size, mode); kind is file, dir or link. Directories have file id 0 and one digest, as
what is below them has rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.paths import FLAGS, ancestors, flag_action, has_flag, under
from grove.operators import diff

COLUMNS = ("action", "path", "from_path", "kind", "file_id", "hash", "from_hash", "size", "mode", "from_mode")


def diff2(before: DataFrame, after: DataFrame, prefix: str = "") -> DataFrame:
    """Changes (COLUMNS): adds and deletes with all that is below, files modified in place (digest, id or mode), directories of
    another mode, moves where a path differs in case alone. A path whose kind changes is deleted and added."""
    a, b = (t.where(under(F.lower("path"), F.lit(prefix.lower()))) if prefix else t for t in (before, after))
    rest = ("path", "file_id", "hash", "size", "mode")
    side = lambda t, n: t.select(F.lower("path").alias("_k"), "kind", *(F.col(c).alias(f"{n}{c}") for c in rest))
    # Kinds are part of the key: a path of two kinds has no partner on either side.
    met = side(a, "a").join(side(b, "b"), ["_k", "kind"], "full_outer")
    renamed = F.col("apath") != F.col("bpath")
    edited = (F.col("kind") != "dir") & ((F.col("ahash") != F.col("bhash")) | (F.col("afile_id") != F.col("bfile_id")))
    action = F.when(F.col("apath").isNull(), "add").when(F.col("bpath").isNull(), "delete").when(renamed, "move").when(edited | (F.col("amode") != F.col("bmode")), "keep")
    return met.withColumn("action", action).where("action is not null").select(
        "action", F.coalesce("bpath", "apath").alias("path"), F.when(F.col("action") == "move", F.col("apath")).alias("from_path"), "kind", F.coalesce("bfile_id", "afile_id").alias("file_id"),
        F.col("bhash").alias("hash"), F.col("ahash").alias("from_hash"), F.coalesce("bsize", "asize").alias("size"), F.col("bmode").alias("mode"), F.col("amode").alias("from_mode"),
    )


def collected(before: DataFrame, after: DataFrame, prefix: str = "", each: bool = False) -> DataFrame:
    """Changes with moves paired; each: see diff.with_moves."""
    return diff.with_moves(diff2(before, after, prefix), each)


def clash(action: str, kind: str, hash_: str, t_action: str, t_kind: str, t_hash: str) -> Column:
    """Whether two changes of one path conflict: not two deletes; yes if the kinds differ; not two directories; else if digests differ."""
    c = F.col
    both = (c(action) == "delete") & (c(t_action) == "delete")
    return F.when(both, False).when(c(kind) != c(t_kind), True).when(c(kind) == "dir", False).otherwise(~c(hash_).eqNullSafe(c(t_hash)))


def diff3(base: DataFrame, source: DataFrame, target: DataFrame, each: bool = False) -> DataFrame:
    """Source changes (COLUMNS) with `conflict`, but those that the target made too.

    A change conflicts with one of the target at its path (see clash), and one that the target didn't touch conflicts where the target
    deleted a directory above it, or made a file of one. each: see diff.with_moves.
    """
    equal = F.col("hash").eqNullSafe(F.col("from_hash"))
    ours = collected(base, source, each=each).where(~equal | (F.col("action") == "move"))
    theirs = diff2(base, target).where(~equal).select(*(F.col(c).alias(f"t_{c}") for c in ("action", "path", "kind", "hash")))
    met = ours.join(theirs, ours["path"] == theirs["t_path"], "left")
    judged = met.withColumn("clash", F.when(F.col("t_path").isNotNull(), clash("action", "kind", "hash", "t_action", "t_kind", "t_hash"))).where("clash is null or clash").select(*COLUMNS, "clash")
    gone = theirs.where("(t_kind = 'dir' and t_action = 'delete') or (t_kind = 'file' and t_action <> 'delete')").select(F.col("t_path").alias("above"), F.col("t_kind").alias("over")).distinct()
    alone = judged.where("clash is null and (kind = 'dir' or action <> 'delete')").select("path", "kind", F.explode(ancestors("path")).alias("above"))
    hit = alone.join(gone, "above").where("over <> kind").select(F.col("path").alias("_p"), F.col("kind").alias("_k"), F.lit(True).alias("_hit")).distinct()
    rows = judged.join(hit, (judged["path"] == hit["_p"]) & (judged["kind"] == hit["_k"]), "left")
    return rows.select(*COLUMNS, F.coalesce("clash", "_hit", F.lit(False)).alias("conflict"))


def without_covered(changes: DataFrame) -> DataFrame:
    """Changes without deletes of directories that have a conflict below or above them."""
    conflicts = changes.where("conflict").select("path").distinct()
    above = conflicts.select(F.explode(F.concat(ancestors("path"), F.array("path"))).alias("_p")).distinct()
    gone = changes.where("kind = 'dir' and action = 'delete' and not conflict")
    below = gone.select("path", F.explode(ancestors("path")).alias("up")).join(conflicts.withColumnRenamed("path", "up"), "up", "left_semi").select(F.col("path").alias("_p"))
    covered = above.unionByName(below).distinct()
    return changes.join(covered, (changes["path"] == covered["_p"]) & (changes["kind"] == "dir") & (changes["action"] == "delete") & ~changes["conflict"], "left_anti")


def history_pass(changes: DataFrame, source_modified: DataFrame, target_modified: DataFrame, into_target: DataFrame, into_source: DataFrame, target: DataFrame) -> DataFrame:
    """changes with conflicts settled by history.

    A side's last modification of a path (path, number) that the other side has merged since (into: path, number of the newest merged revision)
    is known there: where the target knows the source's the conflict goes, and where only the source knows the target's it is a plain change from
    the target's content (target: path, hash) - an add in place of a file that the target still has is a change in place.
    """
    number = lambda df, n: df.select(F.col("path").alias(f"_{n}p"), F.col("number").alias(n))
    rows = changes
    for df, n in ((source_modified, "sm"), (target_modified, "tm"), (into_target, "it"), (into_source, "is")):
        side = number(df, n)
        rows = rows.join(side, rows["path"] == side[f"_{n}p"], "left").drop(f"_{n}p")
    own = target.select(F.col("path").alias("_tp"), F.col("hash").alias("_th"))
    rows = rows.join(own, rows["path"] == own["_tp"], "left")
    known = lambda modified, merged: F.coalesce(F.col(modified) <= F.col(merged), F.lit(False))
    by_target, by_source = F.col("conflict") & known("sm", "it"), F.col("conflict") & known("tm", "is")
    settled = rows.where(~by_target).withColumn("_s", by_source)
    action = F.when(F.col("_s") & (F.col("action") == "add") & F.col("_tp").isNotNull(), "keep").otherwise(F.col("action"))
    made = {"action": action, "from_hash": F.when(F.col("_s"), F.col("_th")).otherwise(F.col("from_hash")), "conflict": F.col("conflict") & ~F.col("_s")}
    return settled.select(*(made.get(c, F.col(c)).alias(c) for c in changes.columns))


#: Answers to conflicts, as bits beside FLAGS.
ANSWERS = {"unresolved": 256, "automerged": 512, "mine": 1024, "theirs": 2048}


def status_rows(working: DataFrame) -> DataFrame:
    """The 13 columns of a status report, from rows (path, from_path, kind, size, flags) with changes."""
    bit = lambda n: F.col("flags").bitwiseAND(F.lit(ANSWERS[n])) != 0
    named = {"flag_staged": has_flag("flags", "staged"), "flag_merged": has_flag("flags", "merge"), "flag_conflict": has_flag("flags", "conflict")}
    named |= {"flag_conflict_unresolved": bit("unresolved"), "flag_conflict_automerged": bit("automerged"), "flag_conflict_mine": bit("mine"), "flag_conflict_theirs": bit("theirs"), "flag_dirty": has_flag("flags", "dirty")}
    return working.where("flags <> 0").select("path", "size", flag_action("flags").alias("action"), F.col("kind").alias("type"), *(c.alias(n) for n, c in named.items()), F.coalesce("from_path", F.lit("")).alias("from_path"))


def discard_counts(nodes: DataFrame, path: str) -> DataFrame:
    """(files, directories) that go with a path and all below it."""
    rows = nodes.where(under("path", F.lit(path)))
    return rows.agg(F.count_if(F.col("kind") != "dir").alias("files"), F.count_if(F.col("kind") == "dir").alias("directories"))


def output_rows(changes: DataFrame, parts: int = 16) -> DataFrame:
    """(path, action, kind, from_hash, hash, part): a change as it is sent; part deals paths to streams."""
    return changes.select("path", "action", "kind", "from_hash", "hash", F.pmod(F.conv(F.substr(F.sha2("path", 256), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(parts)).alias("part"))


def legacy_rows(changes: DataFrame) -> DataFrame:
    """(path, change): files alone, as added, deleted, modified or renamed."""
    named = F.when(F.col("action") == "add", "added").when(F.col("action") == "delete", "deleted").when(F.col("action") == "move", "renamed").otherwise("modified")
    return changes.where("kind = 'file'").select("path", named.alias("change"))


def marked(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """A target's files with flags of a merge: `merge` on those that it changes, with `conflict` and unresolved where it conflicts."""
    flags = F.when(F.col("conflict"), F.lit(FLAGS["merge"] | FLAGS["conflict"] | ANSWERS["unresolved"])).otherwise(F.lit(FLAGS["merge"] | FLAGS["staged"]))
    own = changes.where("kind = 'file'").groupBy(F.col("path").alias("_p")).agg(F.max(flags).alias("_f"))
    return tree.join(own, tree["path"] == own["_p"], "left").select(*tree.columns, F.coalesce("_f", F.lit(0)).alias("flags"))


def unmarked(working: DataFrame) -> DataFrame:
    """What an abandoned merge leaves: rows without the merge's flags."""
    merge = FLAGS["merge"] | FLAGS["conflict"] | sum(ANSWERS.values())
    return working.withColumn("flags", F.when(has_flag("flags", "merge"), F.col("flags").bitwiseAND(F.lit(~(merge | FLAGS["staged"])))).otherwise(F.col("flags")))
