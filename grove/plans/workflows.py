"""Queries on a working copy's cycle and on what must hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from grove.operators import checks, tree
from grove.operators import history as H
from grove.operators import workflow as W
from grove.plans._sql import sql
from grove.plans.histories import walk
from grove.sources import fixtures as X

Q, O = {}, {}


def working(s, d):
    return W.stage(X.tree(s, d, "base"), X.tree(s, d, "source"), "moved")


WORK = """, w AS (SELECT path, from_path, size, (CASE action WHEN 'add' THEN 2 WHEN 'delete' THEN 1 WHEN 'move' THEN 4 ELSE 0 END) + CASE WHEN starts_with(path, 'moved/') THEN 16 ELSE 32 END AS flags, action FROM moves
    UNION ALL SELECT path, NULL, size, 0, NULL FROM base WHERE path NOT IN (SELECT path FROM moves) AND path NOT IN (SELECT from_path FROM moves WHERE from_path IS NOT NULL))"""
Q["stage_paths"] = lambda s, d: working(s, d).select("path", "from_path", "flags")
O["stage_paths"] = sql("moves base", WORK + " SELECT path, from_path, CAST(flags AS INTEGER) AS flags FROM w")
Q["stage_status"] = lambda s, d: W.status(working(s, d))
O["stage_status"] = sql("moves base", WORK + " SELECT action, flags & 16 <> 0 AS staged, flags & 32 <> 0 AS dirty, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM w WHERE flags <> 0 GROUP BY ALL")
Q["unstage_paths"] = lambda s, d: W.dirty_paths(W.unstage(working(s, d), "moved/Brand#12"))
O["unstage_paths"] = sql("moves base", WORK + " SELECT path FROM w WHERE flags & 32 <> 0 OR (flags & 16 <> 0 AND starts_with(path, 'moved/Brand#12/'))")
Q["reset_paths"] = lambda s, d: W.reset(working(s, d), X.tree(s, d, "base"), "Brand#12").where("path like 'Brand#12/%'").select("path", "hash", "flags")
O["reset_paths"] = sql("base", "SELECT path, hash, CAST(0 AS INTEGER) AS flags FROM base WHERE starts_with(path, 'Brand#12/')")
Q["stage_dirs"] = lambda s, d: W.changed_dirs(working(s, d))
O["stage_dirs"] = sql("moves base", WORK + """, u AS (SELECT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path, flags FROM (SELECT path, flags, unnest(range(1, len(string_split(path, '/')))) AS n FROM w WHERE flags <> 0))
    SELECT path, bool_or(flags & 16 <> 0) AS staged, bool_or(flags & 32 <> 0) AS dirty FROM u GROUP BY path""")  # fmt: skip
Q["stage_mounts"] = lambda s, d: W.staged_below(working(s, d), s.createDataFrame([("moved",), ("moved/Brand#12",)], "path string"))
O["stage_mounts"] = sql("moves base", WORK + " SELECT 'moved' AS path, count(*) AS files FROM w WHERE flags & 16 <> 0 UNION ALL SELECT 'moved/Brand#12', count(*) FROM w WHERE flags & 16 <> 0 AND starts_with(path, 'moved/Brand#12/') HAVING count(*) > 0")
Q["commit_tree"] = lambda s, d: W.committed(X.tree(s, d, "base"), working(s, d))[0].select("path", "hash")
O["commit_tree"] = sql("moves base", "SELECT path, hash FROM base WHERE path NOT IN (SELECT path FROM moves WHERE starts_with(path, 'moved/')) AND path NOT IN (SELECT from_path FROM moves WHERE from_path IS NOT NULL AND starts_with(path, 'moved/')) UNION ALL SELECT path, hash FROM moves WHERE starts_with(path, 'moved/') AND action <> 'delete'")
Q["commit_delta"] = lambda s, d: W.committed(X.tree(s, d, "base"), working(s, d))[1]
O["commit_delta"] = sql("moves", "SELECT path, from_path, action FROM moves WHERE starts_with(path, 'moved/')")
Q["commit_digest"] = lambda s, d: W.tree_digest(X.tree(s, d, "base"))
DIGEST = ", b AS (SELECT substring(sha256(path), 1, 3) AS g, substring(sha256(path), 1, 6) AS b, sha256(string_agg(path || '|' || hash, chr(10) ORDER BY path || '|' || hash)) AS d FROM base GROUP BY 1, 2), g AS (SELECT g, sha256(string_agg(d, '' ORDER BY b)) AS d FROM b GROUP BY g), h AS (SELECT sha256(string_agg(d, '' ORDER BY g)) AS digest FROM g)"
O["commit_digest"] = sql("base", DIGEST + " SELECT digest FROM h")


def commit_revision(s, d):
    tips = X.branches(s, d).where("id in (0, 2)").select(F.when(F.col("id") == 2, 0).otherwise(1).alias("place"), F.col("latest").alias("revision"))
    parents = tips.join(X.revisions(s, d).select("revision", "number"), "revision")
    return W.revision(parents, X.tree(s, d, "base"), 2, "merge").drop("message")


Q["commit_revision"] = commit_revision
TWO = "(SELECT latest FROM tips WHERE branch = 2) AS a, (SELECT latest FROM tips WHERE branch = 0) AS b, (SELECT max(number) FROM rev WHERE revision IN (SELECT latest FROM tips WHERE branch IN (0, 2))) + 1 AS number"
O["commit_revision"] = sql("tips rev base", DIGEST + f" SELECT CAST(2 AS BIGINT) AS branch, number, sha256(a || '|' || b || '|' || digest || '|merge') AS revision, a AS parent_self, b AS parent_other FROM (SELECT {TWO}, digest FROM h)")
Q["restore_revision"] = lambda s, d: W.restored(X.branches(s, d).where("id = 2").select(F.col("latest").alias("revision")).join(X.revisions(s, d).select("revision", "number"), "revision"), X.tree(s, d, "base"), 2, "back").drop("message")
O["restore_revision"] = sql("tips rev base", DIGEST + f" SELECT CAST(2 AS BIGINT) AS branch, (SELECT number FROM rev WHERE revision = a) + 1 AS number, sha256(a || '|' || digest || '|back') AS revision, a AS parent_self, NULL AS parent_other FROM (SELECT {TWO}, digest FROM h)")
Q["amend_latest"] = lambda s, d: W.amended(X.revisions(s, d), 1, "new words")
O["amend_latest"] = sql("rev", "SELECT branch, number, CASE WHEN branch = 1 AND number = (SELECT max(number) FROM rev WHERE branch = 1) THEN sha256(revision || '|new words') ELSE revision END AS revision, parent_self, parent_other FROM rev")
Q["branch_create"] = lambda s, d: W.created(X.branches(s, d), 9, "topic", 2).select("id", "name", "latest", F.size("stack").alias("points"))
O["branch_create"] = sql("tips", "SELECT branch AS id, 'b' || branch AS name, latest, CAST(CASE WHEN branch > 0 THEN 1 ELSE 0 END AS INTEGER) AS points FROM tips UNION ALL SELECT 9, 'topic', latest, 2 FROM tips WHERE branch = 2")
Q["branch_reset"] = lambda s, d: W.moved_pointer(X.branches(s, d), 1, H.by_number(X.revisions(s, d), 1, 50)).select("id", "latest")
O["branch_reset"] = sql("tips rev", "SELECT branch AS id, CASE WHEN branch = 1 THEN (SELECT revision FROM rev WHERE branch = 1 AND number = 50) ELSE latest END AS latest FROM tips")
Q["sync_blocked"] = lambda s, d: W.synced(X.tree(s, d, "base"), X.tree(s, d, "target"), working(s, d))[1]
O["sync_blocked"] = sql("moves base tchg", WORK + " SELECT path FROM tchg WHERE lower(path) IN (SELECT lower(path) FROM w WHERE flags <> 0)")
Q["verify_orphans"] = lambda s, d: checks.orphans(tree.identified(X.tree(s, d, "base")).where("not (kind = 'dir' and name = 'PROMO')"), s.range(1).select(F.substr(F.sha2(F.lit(""), 256), F.lit(1), F.lit(16))).first()[0])
O["verify_orphans"] = sql("base", "SELECT substring(sha256(lower(path)), 1, 16) AS node_id FROM base WHERE string_split(path, '/')[2] = 'PROMO'")
Q["verify_names"] = lambda s, d: checks.same_names(tree.identified(X.tree(s, d, "source"))).select("lower", "n")
O["verify_names"] = sql("nodes", ", n AS (SELECT lower(path) AS lp FROM nodes) SELECT regexp_extract(lp, '[^/]*$') AS lower, count(*) AS n FROM n GROUP BY regexp_replace(lp, '/?[^/]*$', ''), regexp_extract(lp, '[^/]*$') HAVING count(*) > 1")
Q["verify_content"] = lambda s, d: checks.missing_content(X.tree(s, d, "source"), X.tree(s, d, "target"))
O["verify_content"] = sql("source target", "SELECT path FROM source WHERE hash NOT IN (SELECT hash FROM target)")
Q["verify_parents"] = lambda s, d: checks.missing_parents(X.revisions(s, d).where("number % 10 <> 3"))
O["verify_parents"] = sql("rev", ", r AS (SELECT * FROM rev WHERE number % 10 <> 3) SELECT revision FROM r WHERE (parent_self IS NOT NULL AND parent_self NOT IN (SELECT revision FROM r)) OR (parent_other IS NOT NULL AND parent_other NOT IN (SELECT revision FROM r))")


def by_request(s, d):
    """Entries of the layer's and the walk's revisions, found by one pass over the metadata."""
    meta, revs = X.revision_metadata(s, d).where("key = 'change-request'").select(H.key("revision").alias("_key"), "key", "str"), X.revisions(s, d)
    tip = X.branches(s, d).where("id = 0").select(F.col("latest").alias("revision"))
    table = H.runs(revs)
    layer = table.rows.where("branch = 1").select("_key", F.lit(None).cast("long").alias("distance"))
    met = H.met(meta, layer.unionByName(H.walked(table, tip).select("_key", "distance")), "requests").select(H.named("_key").alias("revision"), "key", "str", "distance")
    return checks.matched_by_metadata(met.where("distance is null"), met.where("distance is not null"), "change-request")


Q["layer_match"] = by_request
O["layer_match"] = sql(
    "rk",
    """SELECT l.revision, s.revision AS source_revision FROM rk l JOIN (SELECT o_orderpriority AS v, w.revision, row_number() OVER (PARTITION BY o_orderpriority ORDER BY distance, w.revision) AS n FROM w JOIN rk ON rk.revision = w.revision) s
    ON s.v = l.o_orderpriority AND s.n = 1 WHERE l.branch = 1""",
    walk(0),
)
Q["clone_dependencies"] = lambda s, d: checks.limited_to_dependencies(X.tree(s, d, "base"), X.dependencies(s, d), s.createDataFrame([(3,), (8,), (21,)], "node long")).select("path")
O["clone_dependencies"] = sql("base dep", "SELECT path FROM base WHERE file_id IN (3, 8, 21) OR file_id IN (SELECT node FROM c)", "c AS (SELECT target AS node FROM dep WHERE source IN (3, 8, 21) UNION SELECT dep.target FROM c JOIN dep ON dep.source = c.node)")
Q["lock_users"] = lambda s, d: checks.named(X.events(s, d).where("kind = 'ResourceLocked'").select("owner").distinct(), X.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
O["lock_users"] = sql("ev", """SELECT e.owner, coalesce(c.c_name, CAST(e.owner AS VARCHAR)) AS "user" FROM (SELECT DISTINCT owner FROM ev WHERE kind = 'ResourceLocked') e LEFT JOIN customer c ON c.c_custkey = e.owner AND c.c_custkey % 2 = 0""")
Q["history_woven"] = lambda s, d: checks.woven(X.revisions(s, d), X.revisions(s, d).select("revision", (F.col("number") % 17).alias("file")))
O["history_woven"] = sql("rev", "SELECT number % 17 AS file, revision, lag(revision) OVER (PARTITION BY number % 17, branch ORDER BY number) AS previous FROM rev")
Q["last_merged"] = lambda s, d: checks.last_merged(X.revisions(s, d), 2, 0)
O["last_merged"] = sql("rev", "SELECT revision, parent_other AS merged FROM rev WHERE branch = 2 AND parent_other IN (SELECT revision FROM rev WHERE branch = 0) ORDER BY number DESC LIMIT 1")

Q["stage_from_source"] = lambda s, d: W.staged_from(X.tree(s, d, "target").withColumn("from_path", F.lit(None).cast("string")).withColumn("flags", F.lit(0)), X.tree(s, d, "base"), "Brand#12").where("flags <> 0").select("path", "hash", "flags")
O["stage_from_source"] = sql("base target", "SELECT b.path, b.hash, CAST(CASE WHEN t.path IS NULL THEN 18 ELSE 16 END AS INTEGER) AS flags FROM base b LEFT JOIN target t ON t.path = b.path WHERE starts_with(b.path, 'Brand#12/') AND b.hash IS DISTINCT FROM t.hash")
Q["dirty_moves"] = lambda s, d: W.copied(working(s, d), X.tree(s, d, "base").where("file_id % 13 = 0").select("path", F.concat(F.lit("to/"), "path").alias("to"))).where("from_path is not null and path like 'to/%'").select("path", "from_path", "flags")
O["dirty_moves"] = sql("moves base", WORK + " SELECT 'to/' || b.path AS path, b.path AS from_path, CAST(36 AS INTEGER) AS flags FROM base b JOIN w ON w.path = b.path WHERE b.file_id % 13 = 0")
Q["commit_counts"] = lambda s, d: W.commit_counts(W.stage(X.tree(s, d, "base"), X.tree(s, d, "source")))
O["commit_counts"] = sql("moves", "SELECT count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'move') AS moved, count(*) FILTER (action = 'keep') AS modified, CAST(sum(size) FILTER (action <> 'delete') AS BIGINT) AS bytes FROM moves")
Q["realise_counts"] = lambda s, d: W.realise_counts(X.tree(s, d, "base"), X.tree(s, d, "target"))
O["realise_counts"] = sql("base target", "SELECT count(*) FILTER (a.path IS NULL) AS added, count(*) FILTER (b.path IS NULL) AS deleted, count(*) FILTER (a.hash = b.hash) AS retained, count(*) FILTER (a.hash <> b.hash) AS replaced FROM base a FULL JOIN target b ON a.path = b.path")
Q["branch_switch"] = lambda s, d: W.switched(X.branches(s, d), 1, working(s, d), {0: X.tree(s, d, "base"), 1: X.tree(s, d, "target")}, 0)[0].where("action <> 'move'").select("action", "path")
O["branch_switch"] = sql("base target", "SELECT CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'keep' END AS action, coalesce(b.path, a.path) AS path FROM base a FULL JOIN target b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash")

QUERIES, ORACLES = Q, O
