"""A working copy's cycle: stage, unstage, reset, commit, amend, sync; branches as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.paths import FLAGS, ancestors, flag_action, has_flag, under
from grove.operators import diff

#: Rows of a working copy: a tree's with flags (see FLAGS).
WORKING = ("path", "from_path", "file_id", "hash", "size", "flags")


def _bits(*names: str) -> Column:
    return F.lit(sum(FLAGS[n] for n in names))


def stage(tree: DataFrame, disk: DataFrame, prefix: str = "") -> DataFrame:
    """WORKING rows of a tree against what is on disk: changes under the prefix are staged, others are marked dirty alone."""
    changes = diff.with_moves(diff.diff2(tree, disk))
    kind = F.when(F.col("action") == "add", _bits("add")).when(F.col("action") == "delete", _bits("delete")).when(F.col("action") == "move", _bits("move")).otherwise(F.lit(0))
    here = under("path", F.lit(prefix))
    rows = changes.withColumn("flags", kind.bitwiseOR(F.when(here, _bits("staged")).otherwise(_bits("dirty"))))
    touched = changes.select(F.explode(F.array_compact(F.array("path", "from_path"))).alias("_p")).distinct()
    rest = tree.join(touched, tree["path"] == touched["_p"], "left_anti")
    same = rest.select("path", F.lit(None).cast("string").alias("from_path"), "file_id", "hash", "size", F.lit(0).alias("flags"))
    return rows.select(*WORKING).unionByName(same)


def unstage(working: DataFrame, prefix: str = "") -> DataFrame:
    """Staged rows under the prefix are dirty instead."""
    hit = under("path", F.lit(prefix)) & has_flag("flags", "staged")
    demoted = F.col("flags").bitwiseAND(F.lit(~FLAGS["staged"])).bitwiseOR(_bits("dirty"))
    return working.withColumn("flags", F.when(hit, demoted).otherwise(F.col("flags")))


def reset(working: DataFrame, tree: DataFrame, prefix: str = "") -> DataFrame:
    """Rows under the prefix as the tree has them."""
    here = under("path", F.lit(prefix))
    back = tree.where(here).select("path", F.lit(None).cast("string").alias("from_path"), "file_id", "hash", "size", F.lit(0).alias("flags"))
    return working.where(~here).unionByName(back)


def status(working: DataFrame) -> DataFrame:
    """(action, staged, dirty, files, bytes) of changed rows."""
    rows = working.where("flags <> 0").select(flag_action("flags").alias("action"), has_flag("flags", "staged").alias("staged"), has_flag("flags", "dirty").alias("dirty"), "size")
    return rows.groupBy("action", "staged", "dirty").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def dirty_paths(working: DataFrame) -> DataFrame:
    return working.where(has_flag("flags", "dirty")).select("path")


def changed_dirs(working: DataFrame) -> DataFrame:
    """(path, staged, dirty): directories with a staged or dirty file anywhere below."""
    rows = working.where("flags <> 0").select(F.explode(ancestors("path")).alias("path"), has_flag("flags", "staged").alias("s"), has_flag("flags", "dirty").alias("d"))
    return rows.groupBy("path").agg(F.bool_or("s").alias("staged"), F.bool_or("d").alias("dirty"))


def staged_below(working: DataFrame, mounts: DataFrame) -> DataFrame:
    """(path, files): staged files below each mount (path)."""
    up = working.where(has_flag("flags", "staged")).select(F.explode(ancestors("path")).alias("path"))
    return up.join(mounts.select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("files"))


def committed(tree: DataFrame, working: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the tree after the staged changes, the delta (path, from_path, action) of the revision)."""
    staged = working.where(has_flag("flags", "staged")).withColumn("action", flag_action("flags"))
    return diff.apply(tree, staged), staged.select("path", "from_path", "action")


def tree_digest(tree: DataFrame) -> DataFrame:
    """(digest): of all paths and digests, by way of 2^24 buckets of 4096 groups, so that no task holds all of a tree."""
    digest = F.sha2("path", 256)
    line = F.concat_ws("|", "path", "hash")
    rows = tree.select(F.substr(digest, F.lit(1), F.lit(3)).alias("g"), F.substr(digest, F.lit(1), F.lit(6)).alias("b"), line.alias("line"))
    parts = rows.groupBy("g", "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    ordered = lambda n: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, "d"))), lambda x: x["d"]), ""), 256)
    return parts.groupBy("g").agg(ordered("b").alias("d")).agg(ordered("g").alias("digest"))


def revision(parents: DataFrame, tree: DataFrame, branch: int, message: str) -> DataFrame:
    """(branch, number, revision, parent_self, parent_other, message) of a new revision on parents (revision, number; the first by order)."""
    ordered = parents.agg(F.array_sort(F.collect_list(F.struct("place", "revision", "number"))).alias("p"))
    row = ordered.join(tree_digest(tree))
    at = lambda n: F.get("p", F.lit(n))
    number = F.coalesce(F.array_max(F.transform("p", lambda x: x["number"])), F.lit(0)) + 1
    name = F.sha2(F.concat_ws("|", at(0)["revision"], at(1)["revision"], "digest", F.lit(message)), 256)
    return row.select(F.lit(branch).cast("long").alias("branch"), number.alias("number"), name.alias("revision"), at(0)["revision"].alias("parent_self"), at(1)["revision"].alias("parent_other"), F.lit(message).alias("message"))


def moved_pointer(branches: DataFrame, branch: int, to: DataFrame) -> DataFrame:
    """branches with one's latest set to the revision (revision)."""
    new = to.select(F.col("revision").alias("_r")).limit(1)
    rows = branches.where(F.col("id") == branch).drop("latest").join(new).withColumnRenamed("_r", "latest")
    return branches.where(F.col("id") != branch).unionByName(rows.select(*branches.columns))


def amended(revs: DataFrame, branch: int, message: str) -> DataFrame:
    """revs with the newest of a branch replaced: the new one has its number and parents, and a name made of the old one and the message."""
    last = F.broadcast(revs.where(F.col("branch") == branch).agg(F.max("number").alias("_n")))
    newest = (F.col("branch") == branch) & (F.col("number") == F.col("_n"))
    name = F.when(F.coalesce(newest, F.lit(False)), F.sha2(F.concat_ws("|", "revision", F.lit(message)), 256)).otherwise(F.col("revision"))
    return revs.join(last).withColumn("revision", name).select(*revs.columns)


def restored(current: DataFrame, old: DataFrame, branch: int, message: str) -> DataFrame:
    """A new revision on the current one (revision, number) with an old snapshot: (branch, number, revision, parent_self, parent_other, message)."""
    return revision(current.select(F.lit(0).alias("place"), "revision", "number"), old, branch, message)


def switched(branches: DataFrame, to: int, working: DataFrame, trees: dict[int, DataFrame], current: int) -> tuple[DataFrame, DataFrame]:
    """Moving a working copy from one branch's snapshot to another's: what synced() says of the two."""
    return synced(trees[current], trees[to], working)


def copied(working: DataFrame, moves: DataFrame, keep: bool = False) -> DataFrame:
    """working with paths marked as moved, or (keep) copied: moves (path, to). What is told from outside is dirty, not staged."""
    here = moves.select(F.col("path").alias("_p"), F.col("to").alias("_to"))
    met = working.join(here, working["path"] == here["_p"], "left")
    told = F.col("_to").isNotNull()
    made = met.where(told).select(F.col("_to").alias("path"), F.col("path").alias("from_path"), "file_id", "hash", "size", _bits("copy" if keep else "move", "dirty").alias("flags"))
    rest = met if keep else met.where(~told)
    return rest.select(*WORKING).unionByName(made.select(*WORKING))


def staged_from(working: DataFrame, source: DataFrame, prefix: str = "") -> DataFrame:
    """working with another snapshot's files under the prefix staged over its own: those that differ, as adds or changes in place."""
    theirs = source.where(under("path", F.lit(prefix))).select(F.col("path").alias("_p"), F.col("file_id").alias("_i"), F.col("hash").alias("_h"), F.col("size").alias("_s"))
    met = working.join(theirs, working["path"] == theirs["_p"], "full_outer")
    differs = F.col("_p").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_h"))
    take = lambda own, new: F.when(differs, F.col(new)).otherwise(F.col(own)).alias(own)
    flags = F.when(differs & F.col("path").isNull(), _bits("add", "staged")).when(differs, F.coalesce("flags", F.lit(0)).bitwiseOR(_bits("staged"))).otherwise(F.col("flags"))
    return met.select(F.coalesce("path", "_p").alias("path"), "from_path", take("file_id", "_i"), take("hash", "_h"), take("size", "_s"), flags.alias("flags"))


def commit_counts(working: DataFrame) -> DataFrame:
    """(added, deleted, moved, modified, bytes): counters of the staged files of a commit."""
    rows = working.where(has_flag("flags", "staged")).withColumn("action", flag_action("flags"))
    many = lambda a: F.count_if(F.col("action") == a)
    size = F.coalesce(F.sum(F.when(F.col("action") != "delete", F.col("size"))), F.lit(0)).cast("long")
    return rows.agg(many("add").alias("added"), many("delete").alias("deleted"), many("move").alias("moved"), many("keep").alias("modified"), size.alias("bytes"))


def realise_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(added, deleted, retained, replaced): files of a folder that is brought from one snapshot to another, by path."""
    met = before.select("path", F.col("hash").alias("_b")).join(after.select("path", F.col("hash").alias("_a")), "path", "full_outer")
    return met.agg(F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_a").isNull()).alias("deleted"), F.count_if(F.col("_a") == F.col("_b")).alias("retained"), F.count_if(F.col("_a") != F.col("_b")).alias("replaced"))


def created(branches: DataFrame, id_: int, name: str, origin: int) -> DataFrame:
    """branches with a new one that leaves another at its latest revision."""
    base = branches.where(F.col("id") == origin)
    point = F.struct(F.col("id").alias("branch"), F.col("latest").alias("revision"))
    row = base.select(F.lit(id_).cast("long").alias("id"), F.lit(name).alias("name"), "latest", "creator", F.concat(F.array(point), "stack").alias("stack"))
    return branches.unionByName(row.select(*branches.columns))


def synced(current: DataFrame, target: DataFrame, working: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes that bring current to target, paths that stand in the way: changed both there and in the working copy)."""
    changes = diff.with_moves(diff.diff2(current, target))
    own = working.where("flags <> 0").select(F.lower("path").alias("_k")).distinct()
    return changes, changes.join(own, F.lower(changes["path"]) == own["_k"], "left_semi").select("path")
