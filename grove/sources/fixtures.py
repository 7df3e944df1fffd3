"""Versioned-store tables derived from the driver's tables, as FIXTURES.md defines them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.functions.paths import ancestors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str, side: str = "base") -> DataFrame:
    """Files of one of three snapshots: base, source or target."""
    k, body = F.col("p_partkey"), F.concat_ws("|", "p_name", "p_size")
    path = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/p"), k, F.lit(".txt"))
    keep = {"base": k % 10 != 0, "source": ((k % 10 != 0) | (k % 20 == 0)) & (k % 17 != 0), "target": ((k % 10 != 0) | (k % 30 == 0)) & (k % 19 != 0)}[side]
    if side == "source":
        path = F.when(k % 11 == 0, F.concat(F.lit("moved/"), path)).when(k % 23 == 0, F.upper(path)).otherwise(path)
        body = F.when(k % 7 == 0, F.concat(body, F.lit("|A"))).otherwise(body)
    if side == "target":
        body = F.when(k % 35 == 0, F.concat(body, F.lit("|A"))).when(k % 5 == 1, F.concat(body, F.lit("|B"))).otherwise(body)
    return table(spark, sf_dir, "part").where(keep).select(path.alias("path"), k.alias("file_id"), F.sha2(body, 256).alias("hash"), F.length(body).alias("size"))


def nodes(spark: SparkSession, sf_dir: str, side: str = "base") -> DataFrame:
    """Files and directories of a snapshot, with modes: (path, kind, file_id, hash, size, mode).

    In the source some files have become directories with a file in them, and some directories another mode; in the target some files have.
    Of directories whose paths differ in case alone the first is taken.
    """
    k = F.col("file_id")
    files = tree(spark, sf_dir, side)
    if side == "source":
        files = files.withColumn("path", F.when(k % 29 == 0, F.concat("path", F.lit("/inner.txt"))).otherwise(F.col("path"))).withColumn("file_id", F.when(k % 29 == 0, k + 1_000_000).otherwise(k))
    mode = F.when((k % 31 == 0) & F.lit(side == "target"), 493).otherwise(420)
    rows = files.select("path", F.lit("file").alias("kind"), "file_id", "hash", "size", mode.alias("mode"))
    above = files.select(F.explode(ancestors("path")).alias("path")).groupBy(F.lower("path").alias("k")).agg(F.min("path").alias("path"))
    own = F.when((F.length("path") % 5 == 0) & F.lit(side == "source"), 448).otherwise(493)
    return rows.unionByName(above.select("path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("file_id"), F.lit("dir").alias("hash"), F.lit(0).alias("size"), own.alias("mode")))


def contents(spark: SparkSession, sf_dir: str, side: str = "base") -> DataFrame:
    """(path, text): files of four lines; the source changes the first line of some, the target the last or the first of others."""
    k, first = F.col("p_partkey"), F.col("p_name")
    last = F.col("p_size").cast("string")
    if side == "source":
        first = F.when(k % 7 == 0, F.upper(first)).otherwise(first)
    if side == "target":
        first = F.when(k % 35 == 0, F.concat(first, F.lit("!"))).otherwise(first)
        last = F.when(k % 5 == 1, F.concat(last, F.lit(" more"))).otherwise(last)
    path = F.concat(F.col("p_brand"), F.lit("/p"), k, F.lit(".txt"))
    return table(spark, sf_dir, "part").select(path.alias("path"), F.concat(F.concat_ws("\n", first, "p_brand", "p_type", last), F.lit("\n")).alias("text"))


def named(k: str) -> Column:
    """The revision that an order's key stands for."""
    return F.sha2(F.col(k).cast("string"), 256)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four branches of all orders: a trunk, branch points on it, and merges from it."""
    # One window over keys alone; names are made last.
    order = Window.partitionBy("branch").orderBy("o_orderkey")
    ranked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("branch")).withColumn("n", F.row_number().over(order)).withColumn("_before", F.lag("o_orderkey").over(order))
    # Of the trunk only what others point at. Conditions on the branch alone would go below the window, and each would have a shuffle of its own.
    of_trunk, off_trunk = F.when(F.col("branch") == 0, F.col("n")), F.when(F.col("branch") > 0, F.col("n"))
    trunk = ranked.where((of_trunk % 25 == 0) | of_trunk.isin(10, 20, 30)).select(F.col("n").alias("tn"), F.col("o_orderkey").alias("trunk"))
    point, merge = F.coalesce(off_trunk == 1, F.lit(False)), F.coalesce(off_trunk % 25 == 0, F.lit(False))
    # Only rows that point at the trunk are joined with it.
    met = ranked.where(point | merge).withColumn("tn", F.when(point, 10 * F.col("branch")).otherwise(F.col("n")).cast("int")).join(trunk, "tn", "left")
    pointed = met.select("branch", "n", "o_orderkey", F.when(point, F.col("trunk")).otherwise(F.col("_before")).alias("up"), F.when(merge, F.col("trunk")).alias("other"))
    rows = ranked.where(~(point | merge)).select("branch", "n", "o_orderkey", F.col("_before").alias("up"), F.lit(None).cast("long").alias("other")).unionByName(pointed)
    return rows.select("branch", (F.col("n") + 10 * F.col("branch")).cast("long").alias("number"), named("o_orderkey").alias("revision"), named("up").alias("parent_self"), named("other").alias("parent_other"))


def revision_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(revision, key, type, str, num): who made a revision, when (epoch ms) and for which change request."""
    # Every order with a key has a revision.
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null").withColumn("revision", F.sha2(F.col("o_orderkey").cast("string"), 256))
    none = F.lit(None)
    entries = F.array(
        F.struct(F.lit("created-by").alias("key"), F.lit("string").alias("type"), F.col("o_custkey").cast("string").alias("str"), none.cast("long").alias("num")),
        F.struct(F.lit("timestamp").alias("key"), F.lit("numeric").alias("type"), none.cast("string").alias("str"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("num")),
        F.struct(F.lit("change-request").alias("key"), F.lit("string").alias("type"), F.col("o_orderpriority").alias("str"), none.cast("long").alias("num")),
    )
    return orders.select("revision", F.explode(entries).alias("e")).select("revision", "e.*")


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, latest, creator, stack): the last revision of each branch and the points where it left others."""
    # From keys alone: a branch's newest revision has its last key, and of the trunk only the first keys count, so few rows are shuffled.
    keys = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("branch"))
    tips = keys.groupBy("branch").agg(F.max("o_orderkey").alias("_last")).select("branch", F.when(F.col("branch").isNotNull(), named("_last")).alias("latest"))
    first = keys.where("branch = 0").withColumn("n", F.row_number().over(Window.partitionBy("branch").orderBy("o_orderkey"))).where("n <= 30")
    points = first.where("n % 10 = 0").select((F.col("n") / 10).cast("long").alias("b"), named("o_orderkey").alias("point"))
    stack = F.when(F.col("branch") > 0, F.array(F.struct(F.lit(0).cast("long").alias("branch"), F.col("point").alias("revision"))))
    met = tips.join(points, tips["branch"] == points["b"], "left")
    empty = F.array().cast("array<struct<branch: bigint, revision: string>>")
    return met.select(F.col("branch").alias("id"), F.concat(F.lit("b"), F.col("branch")).alias("name"), "latest", (F.col("branch") * 7).alias("creator"), F.coalesce(stack, empty).alias("stack"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, tag): edges between file numbers, cycles included."""
    many = table(spark, sf_dir, "part").agg(F.count("*").alias("parts"))
    rows = table(spark, sf_dir, "lineitem").join(F.broadcast(many))
    edges = rows.select(F.col("l_partkey").alias("source"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("parts")).alias("target"), F.col("l_returnflag").alias("tag"))
    return edges.where("source <> target").distinct()


def fragments(spark: SparkSession, sf_dir: str, width: int = 256) -> DataFrame:
    """(doc_id, part, seq, hash, sz): documents cut to fixed-size chunks; the language is the partition, the id the context."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    seq = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / width)))
    rows = docs.select("doc_id", F.col("lang").alias("part"), seq.alias("seq"), "text")
    chunk = F.substr("text", (F.col("seq") * width + 1).cast("int"), F.lit(width))
    return rows.select("doc_id", "part", "seq", F.sha2(chunk, 256).alias("hash"), F.length(chunk).alias("sz"))


KINDS = {"signup": "BranchCreated", "purchase": "BranchPushed", "error": "BranchDeleted", "click": "ResourceLocked", "view": "ResourceUnlocked"}


def as_events(events: DataFrame) -> DataFrame:
    """Notifications from the events table or stream."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("event_type"))
    resource = F.get_json_object("props", "$.k").cast("long") % 20
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("repository"), kind.alias("kind"), (F.col("user_id") % 7).alias("branch"), F.col("event_id").alias("number"), F.col("user_id").alias("owner"), resource.alias("resource"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def filter_rules(spark: SparkSession) -> list[tuple[int, str, bool]]:
    return [(1, "brand#1*/**", False), (2, "/brand#12/economy", True), (3, "*7.txt", False), (4, "moved/", False)]


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repository, mount, target, target_name): nations mounted under their regions."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    met = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    return met.select(F.col("r_regionkey").alias("repository"), F.concat_ws("/", F.lit("region"), "r_name", "n_name").alias("mount"), F.col("n_nationkey").alias("target"), F.col("n_name").alias("target_name"))
