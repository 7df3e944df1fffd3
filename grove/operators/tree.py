"""Trees: files of a snapshot by path, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions.paths import ancestors, depth, name, parent, under
from grove.session import checkpointed


def nodes(tree: DataFrame) -> DataFrame:
    """Files and the directories above them: (path, parent, name, kind, depth, file_id, hash, size)."""
    up = tree.select(F.explode(ancestors("path")).alias("path")).distinct()
    dirs = up.select("path", F.lit("dir").alias("kind"), F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("int").alias("size"))
    files = tree.select("path", F.lit("file").alias("kind"), "file_id", "hash", "size")
    return files.unionByName(dirs).select("path", parent("path").alias("parent"), name("path").alias("name"), "kind", depth("path").alias("depth"), "file_id", "hash", "size")


def listing(tree: DataFrame, prefix: str = "", max_depth: int | None = None) -> DataFrame:
    """Paths under a prefix, itself included, down to max_depth levels below it."""
    rows = nodes(tree).where(under("path", F.lit(prefix)))
    level = len(prefix.split("/")) if prefix else 0
    return rows if max_depth is None else rows.where(F.col("depth") <= level + max_depth)


def children(tree: DataFrame, path: str) -> DataFrame:
    """Files and directories right under a path: only what is under it is read on."""
    return nodes(tree.where(under("path", F.lit(path)))).where(F.col("parent") == path)


def dir_sizes(tree: DataFrame) -> DataFrame:
    """(path, size, files) of each directory: sums over all below. Partial sums by directory run before the shuffle."""
    up = tree.select(F.explode(ancestors("path")).alias("path"), "size")
    return up.groupBy("path").agg(F.sum("size").alias("size"), F.count("*").alias("files"))


def counts(tree: DataFrame, prefix: str = "") -> DataFrame:
    """(files, directories) under a prefix."""
    rows = listing(tree, prefix)
    return rows.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") != "file").alias("directories"))


def dir_hashes(tree: DataFrame) -> DataFrame:
    """(path, hash, size): a directory's digest is that of its children's names, digests and sizes.

    Children are hashed in 4096 groups by a digest of their name, each in order, and a directory is the digest of its groups': no
    task holds all of a large directory. One aggregation for each level, the deepest first; a level's directories join the level above as children.
    """
    rows = nodes(tree).select("path", "parent", "name", "kind", "depth", "hash", F.col("size").cast("long").alias("size"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    files, done = rows.where("kind = 'file'").drop("kind"), None
    record = F.concat_ws("|", F.lower("name"), "hash", F.col("size").cast("string"))
    group = F.substr(F.sha2(F.lower("name"), 256), F.lit(1), F.lit(3))
    level = None
    for d in range(deepest, 1, -1):
        own = files.where(F.col("depth") == d)
        own = own if level is None else own.unionByName(level)
        groups = own.groupBy(F.col("parent").alias("path"), group.alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(record)), "\n"), 256).alias("d"), F.sum("size").alias("size"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "")
        hashed = groups.groupBy("path").agg(F.sha2(whole, 256).alias("hash"), F.sum("size").alias("size"))
        level = checkpointed(hashed.select("path", parent("path").alias("parent"), name("path").alias("name"), F.lit(d - 1).alias("depth"), "hash", "size"))
        out = level.select("path", "hash", "size")
        done = out if done is None else done.unionByName(out)
    return done if done is not None else rows.select("path", "hash", "size").limit(0)


def case_collisions(tree: DataFrame) -> DataFrame:
    """(parent, lower, variants): siblings whose names differ in case alone."""
    rows = nodes(tree).groupBy("parent", F.lower("name").alias("lower")).agg(F.array_sort(F.collect_set("name")).alias("variants"))
    return rows.where(F.size("variants") > 1)


def identified(tree: DataFrame) -> DataFrame:
    """Nodes with ids and parents' ids: (node_id, parent_id, name, kind); the root's id is that of the empty path."""
    key = lambda c: F.substr(F.sha2(F.lower(c), 256), F.lit(1), F.lit(16))
    return nodes(tree).select(key("path").alias("node_id"), key("parent").alias("parent_id"), "name", "kind")


def node_paths(rows: DataFrame, root: str) -> DataFrame:
    """(node_id, path) of nodes below a root, by climbing: a level of joins for each level of the tree."""
    level = rows.where(F.col("parent_id") == root).select("node_id", F.col("name").alias("path"))
    done = None
    while not level.isEmpty():
        level = checkpointed(level)
        done = level if done is None else done.unionByName(level)
        up = level.select(F.col("node_id").alias("up"), F.col("path").alias("above"))
        level = rows.join(up, rows["parent_id"] == up["up"]).select("node_id", F.concat_ws("/", "above", "name").alias("path"))
    return done if done is not None else level


def lookup(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """Each asked path (path) with its node, in any case: (asked, path, file_id); none: null."""
    rows = tree.select(F.lower("path").alias("k"), "path", "file_id")
    asked = paths.select(F.col("path").alias("asked"), F.lower("path").alias("k"))
    return asked.join(rows, "k", "left").select("asked", "path", "file_id")


def any_changed(tree: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, files): directories with a changed file (path) anywhere below."""
    rows = tree.join(changed.select("path"), "path", "left_semi")
    return rows.select(F.explode(ancestors("path")).alias("path")).groupBy("path").agg(F.count("*").alias("files"))


def overlay(tree: DataFrame, layer: DataFrame, mount: str) -> DataFrame:
    """A tree with a layer mounted: the layer hides what lies under the mount."""
    rest = tree.where(~under(F.lower("path"), F.lit(mount.lower())))
    return rest.unionByName(layer.withColumn("path", F.concat_ws("/", F.lit(mount), "path")))


def mounted(links: DataFrame, trees: DataFrame, most: int = 8) -> DataFrame:
    """Paths of linked repositories at their mounts: links (repository, mount, target), trees (repository, path).

    Links within linked repositories are followed, `most` deep at most.
    """
    hops = links.select("repository", "mount", "target").withColumn("hops", F.lit(1))
    level = hops
    for n in range(2, most + 1):
        inner = links.select(F.col("repository").alias("r"), F.col("mount").alias("m"), F.col("target").alias("t"))
        level = level.join(inner, level["target"] == inner["r"]).select("repository", F.concat_ws("/", "mount", "m").alias("mount"), F.col("t").alias("target"), F.lit(n).alias("hops"))
        if level.isEmpty():
            break
        level = checkpointed(level)
        hops = hops.unionByName(level)
    files = trees.select(F.col("repository").alias("target"), "path")
    return hops.join(files, "target").select("repository", F.concat_ws("/", "mount", "path").alias("path"), "hops")
