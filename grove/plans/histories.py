"""Queries on revisions, branches and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from grove.operators import graph, tables
from grove.operators import history as H
from grove.operators import workflow as W
from grove.plans._sql import sql
from grove.sources import fixtures as X

Q, O = {}, {}


def query(name: str, oracle: str):
    def put(f):
        Q[name], O[name] = f, oracle
        return f

    return put


def tip(s, d, b):
    return X.branches(s, d).where(F.col("id") == b).select(F.col("latest").alias("revision"))


def walk(b: int, name: str = "w") -> str:
    """A table (revision, number, branch, distance) along first parents from a branch's tip: all of the branch, then of the trunk up to its point."""
    own = f"(SELECT max(n) AS mx FROM rk WHERE branch = {b})"
    trunk = f" UNION ALL SELECT revision, number, branch, CAST(mx + {10 * b} - n AS BIGINT) FROM rk, {own} WHERE branch = 0 AND n <= {10 * b}" if b else ""
    return f"{name} AS (SELECT revision, number, branch, CAST(mx - n AS BIGINT) AS distance FROM rk, {own} WHERE branch = {b}{trunk})"


def reach(b: int, name: str) -> str:
    """A table (revision) over both parents: all of the branch, and the trunk up to its point or the last revision that was merged."""
    return f"""{name} AS (SELECT revision FROM rk WHERE branch = {b} UNION ALL SELECT revision FROM rk WHERE branch = 0 AND n <=
        (SELECT max(n) FROM rk WHERE branch = 0 AND (n <= {10 * b} OR (n % 25 = 0 AND n <= (SELECT max(n) FROM rk WHERE branch = {b})))))"""


Q["revision_rows"] = lambda s, d: X.revisions(s, d)
O["revision_rows"] = sql("rev", "SELECT branch, number, revision, parent_self, parent_other FROM rev")
Q["history_linear"] = lambda s, d: H.history(X.revisions(s, d), tip(s, d, 0), limit=None)
O["history_linear"] = sql("rk", "SELECT revision, number, branch, distance FROM w", walk(0))
Q["history_limit"] = lambda s, d: H.history(X.revisions(s, d), tip(s, d, 1))
O["history_limit"] = sql("rk rev tips", "SELECT revision, number, branch, distance FROM w WHERE distance < 100", walk(1))
Q["history_only_branch"] = lambda s, d: H.history(X.revisions(s, d), tip(s, d, 2), limit=None, only_branch=True)
O["history_only_branch"] = sql("rk rev tips", "SELECT revision, number, branch, distance FROM w WHERE distance <= (SELECT min(distance) FROM w WHERE branch <> 2)", walk(2))
SINCE = 820_000_000_000
Q["history_since"] = lambda s, d: H.history(X.revisions(s, d), tip(s, d, 3), limit=None, since=(X.revision_metadata(s, d).where("key = 'timestamp'"), SINCE))
O["history_since"] = sql("rk rev tips",
    f"""SELECT w.revision, w.number, w.branch, w.distance FROM w WHERE distance < coalesce((SELECT min(distance) FROM w JOIN rk ON rk.revision = w.revision WHERE epoch_ms(o_orderdate) < {SINCE}), 1000000000)""",
    walk(3),
)
Q["revision_nth_ancestor"] = lambda s, d: H.nth_ancestor(X.revisions(s, d), tip(s, d, 1), 130)
O["revision_nth_ancestor"] = sql("rk rev tips", "SELECT revision FROM w WHERE distance = 130", walk(1))
Q["revision_by_number"] = lambda s, d: H.resolve(X.revisions(s, d), X.branches(s, d), "b2@77")
O["revision_by_number"] = sql("rev", "SELECT revision FROM rev WHERE branch = 2 AND number = 77")
Q["revision_latest_back"] = lambda s, d: H.resolve(X.revisions(s, d), X.branches(s, d), "b1@latest~3~")
O["revision_latest_back"] = sql("rk rev tips", "SELECT revision FROM w WHERE distance = 4", walk(1))
Q["revision_by_prefix"] = lambda s, d: H.resolve(X.revisions(s, d), X.branches(s, d), "A", current=3)
O["revision_by_prefix"] = sql("rev", "SELECT revision FROM rev WHERE starts_with(revision, 'a') ORDER BY branch <> 3, number DESC, revision LIMIT 1")
Q["revision_by_metadata"] = lambda s, d: H.by_metadata(X.revision_metadata(s, d), "change-request", "1-URGENT")
O["revision_by_metadata"] = sql("rk", "SELECT revision FROM rk WHERE o_orderpriority = '1-URGENT'")
Q["revision_numbers"] = lambda s, d: H.next_number(X.revisions(s, d))
O["revision_numbers"] = sql("rev", "SELECT r.revision, r.number, greatest(coalesce(a.number, 0), coalesce(b.number, 0)) + 1 AS expected FROM rev r LEFT JOIN rev a ON a.revision = r.parent_self LEFT JOIN rev b ON b.revision = r.parent_other")
Q["revision_list_page"] = lambda s, d: H.page(X.revisions(s, d), 2, at=147, step=40)
O["revision_list_page"] = sql(
    "rk",
    """SELECT r.revision, r.number, p.number AS parent_number, (SELECT max(number) FROM rk WHERE branch = 2 AND number < 121) AS next FROM rk r LEFT JOIN rk p ON p.branch = 2 AND p.n = r.n - 1
    WHERE r.branch = 2 AND r.number BETWEEN 121 AND 147""",
)
Q["revision_list_newer"] = lambda s, d: H.page(X.revisions(s, d), 1, at=131, step=40, newer=True)
O["revision_list_newer"] = sql(
    "rk",
    """SELECT r.revision, r.number, p.number AS parent_number, (SELECT min(number) FROM rk WHERE branch = 1 AND number > 160) AS next FROM rk r LEFT JOIN rk p ON p.branch = 1 AND p.n = r.n - 1
    WHERE r.branch = 1 AND r.number BETWEEN 131 AND 160""",
)
Q["revision_list_range"] = lambda s, d: H.listed(X.revisions(s, d), H.by_number(X.revisions(s, d), 2, 60), X.branches(s, d).where("id = 2").select(F.col("stack")[0]["revision"].alias("revision")), limit=30)
O["revision_list_range"] = sql("rev", """SELECT r.revision, r.number, a.number AS parent_number, b.number AS other_number, TRUE AS has_more FROM rev r LEFT JOIN rev a ON a.revision = r.parent_self LEFT JOIN rev b ON b.revision = r.parent_other
    WHERE r.branch = 2 AND r.number BETWEEN 31 AND 60""")  # fmt: skip
Q["revision_list_to_point"] = lambda s, d: H.listed(X.revisions(s, d), H.by_number(X.revisions(s, d), 3, 40), X.branches(s, d).where("id = 3").select(F.col("stack")[0]["revision"].alias("revision"))).select("revision", "has_more")
O["revision_list_to_point"] = sql("rk", "SELECT revision, FALSE AS has_more FROM rk WHERE branch = 3 AND number <= 40")
Q["revision_segment_lists"] = lambda s, d: H.segment_lists(X.revisions(s, d), 40).select("branch", "segment", F.size("revisions").alias("n"), F.sha2(F.array_join("revisions", ""), 256).alias("digest"))
O["revision_segment_lists"] = sql("rk", "SELECT branch, CAST(((number + 39) // 40) * 40 AS BIGINT) AS segment, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(revision, '' ORDER BY number DESC)) AS digest FROM rk GROUP BY 1, 2")
Q["revision_matched"] = lambda s, d: H.matched(X.revisions(s, d), tip(s, d, 1), F.col("parent_other").isNotNull() & (F.col("number") % 2 == 0), abort=F.col("branch") == 0)
O["revision_matched"] = sql("rev rk", "SELECT rev.revision, rev.number, w.distance FROM rev JOIN w ON w.revision = rev.revision WHERE rev.parent_other IS NOT NULL AND rev.number % 2 = 0 ORDER BY w.distance LIMIT 1", walk(1))
Q["branch_latest_list"] = lambda s, d: H.latest_list(X.revisions(s, d), 5)
O["branch_latest_list"] = sql("rk", "SELECT branch, revision, number, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY number DESC) AS back FROM rk) WHERE back <= 5")
Q["branch_newer_side"] = lambda s, d: H.newer(X.revisions(s, d).where("number % 3 <> 0").groupBy("branch").agg(F.max_by("revision", "number").alias("revision"), F.max("number").alias("number")), X.revisions(s, d).where("number % 2 = 0").groupBy("branch").agg(F.max_by("revision", "number").alias("revision"), F.max("number").alias("number")))
O["branch_newer_side"] = sql("rk", """, x AS (SELECT branch, revision, number, 1 AS local FROM rk WHERE number % 3 <> 0 UNION ALL SELECT branch, revision, number, 0 FROM rk WHERE number % 2 = 0)
    SELECT branch, revision, number, CASE WHEN local = 1 THEN 'local' ELSE 'remote' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY number DESC, local DESC) AS n FROM x) WHERE n = 1""")  # fmt: skip
Q["branch_point_sides"] = lambda s, d: H.branch_point(X.revisions(s, d), H.by_number(X.revisions(s, d), 1, 40), H.by_number(X.revisions(s, d), 3, 45))
O["branch_point_sides"] = sql("rk", """SELECT 'point' AS side, revision, CAST(0 AS BIGINT) AS distance FROM rk WHERE branch = 0 AND number = 10 UNION ALL SELECT 'a', revision, 40 - number FROM rk WHERE branch = 1 AND number <= 40
    UNION ALL SELECT 'b', revision, 45 - number FROM rk WHERE branch = 3 AND number <= 45 UNION ALL SELECT 'b', revision, 15 + 30 - number FROM rk WHERE branch = 0 AND number BETWEEN 11 AND 30""")  # fmt: skip
Q["divergence_cut_off"] = lambda s, d: H.divergence(X.revisions(s, d), tip(s, d, 1), tip(s, d, 2), most=50, base=H.by_number(X.revisions(s, d), 0, 5))
O["divergence_cut_off"] = sql("rk", "SELECT revision, CAST(0 AS BIGINT) AS ahead, CAST(0 AS BIGINT) AS behind FROM rk WHERE branch = 0 AND number = 5")
Q["revision_list_segments"] = lambda s, d: H.segments(X.revisions(s, d), 40)
O["revision_list_segments"] = sql("rev", "SELECT branch, ((number + 39) // 40) * 40 AS segment, min(number) AS first, max(number) AS last, count(*) AS revisions FROM rev GROUP BY 1, 2")
Q["common_ancestors"] = lambda s, d: H.common_ancestors(X.revisions(s, d), tip(s, d, 1), tip(s, d, 2))
O["common_ancestors"] = sql("rk rev tips", "SELECT r.revision, r.number FROM rev r WHERE r.revision IN (SELECT revision FROM x) AND r.revision IN (SELECT revision FROM y)", f"{reach(1, 'x')}, {reach(2, 'y')}")
Q["merge_base"] = lambda s, d: H.merge_base(X.revisions(s, d), tip(s, d, 1), tip(s, d, 3))
O["merge_base"] = sql("rk rev tips", "SELECT r.revision, r.number FROM rev r WHERE r.revision IN (SELECT revision FROM x) AND r.revision IN (SELECT revision FROM y) ORDER BY number DESC, revision LIMIT 1", f"{reach(1, 'x')}, {reach(3, 'y')}")
Q["divergence_distance"] = lambda s, d: H.divergence(X.revisions(s, d), tip(s, d, 2), tip(s, d, 3))
O["divergence_distance"] = sql("rk rev tips",
    "SELECT w.revision, w.distance AS ahead, v.distance AS behind FROM w JOIN v ON w.revision = v.revision ORDER BY w.distance LIMIT 1",
    walk(2) + ", " + walk(3, "v"),
)
Q["bisect_midpoint"] = lambda s, d: H.bisect(X.revisions(s, d), H.resolve(X.revisions(s, d), X.branches(s, d), "@10"), tip(s, d, 1))
O["bisect_midpoint"] = sql("rk rev tips",
    "SELECT w.revision, e.distance AS steps, e.distance <= 1 AS done FROM w, (SELECT distance FROM w WHERE branch = 0 AND number = 10) e WHERE w.distance = e.distance // 2",
    walk(1),
)
Q["branch_rows"] = lambda s, d: X.branches(s, d).select("id", "name", "latest", "creator", F.size("stack").alias("points"))
O["branch_rows"] = sql("tips", "SELECT branch AS id, 'b' || branch AS name, latest, branch * 7 AS creator, CAST(CASE WHEN branch > 0 THEN 1 ELSE 0 END AS INTEGER) AS points FROM tips")
Q["branch_by_creator"] = lambda s, d: X.branches(s, d).where("creator = 14").select("name")
O["branch_by_creator"] = sql("tips", "SELECT 'b' || branch AS name FROM tips WHERE branch * 7 = 14")
Q["branch_stack_common"] = lambda s, d: H.common_branch(X.branches(s, d), 1, 3)
O["branch_stack_common"] = sql("rev", "SELECT CAST(0 AS BIGINT) AS branch, (SELECT revision FROM rev WHERE branch = 0 AND number = 10) AS a_revision, (SELECT revision FROM rev WHERE branch = 0 AND number = 30) AS b_revision")


@query(
    "branch_two_way",
    sql(
        "rk tips",
        """, b AS (SELECT branch AS id, CASE WHEN branch = 0 THEN (SELECT revision FROM rk WHERE branch = 0 AND n = 10) ELSE latest END AS latest FROM tips),
    i AS (SELECT id FROM b UNION ALL SELECT NULL), s AS (SELECT branch, revision FROM (SELECT unnest([1, 2, 3]) AS branch) JOIN rk USING (branch) WHERE FALSE
        UNION ALL SELECT b.id, r.revision FROM b JOIN rk r ON b.id > 0 AND r.branch = 0 AND r.n = 10 * b.id)
    SELECT x.id AS a, y.id AS b, x.id IS NULL OR y.id IS NULL OR x.id = y.id OR EXISTS (SELECT 1 FROM s JOIN b ON b.id = x.id WHERE s.branch = y.id AND s.revision = b.latest)
        OR EXISTS (SELECT 1 FROM s JOIN b ON b.id = y.id WHERE s.branch = x.id AND s.revision = b.latest) AS two_way FROM i x, i y""",
    ),
)
def _(s, d):
    """All pairs of branches and none, with the trunk set back to where the first branch left it."""
    branches = W.moved_pointer(X.branches(s, d), 0, H.by_number(X.revisions(s, d), 0, 10))
    ids = branches.select("id").unionByName(s.createDataFrame([(None,)], "id long"))
    return H.two_way(branches, ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b"))))


Q["branch_live"] = lambda s, d: tables.live_branches(X.events(s, d))
O["branch_live"] = sql("live", "SELECT repository, branch FROM live")
Q["branch_archived"] = lambda s, d: tables.archived_branches(X.events(s, d))
O["branch_archived"] = sql("live", "SELECT DISTINCT repository, branch FROM ev WHERE kind IN ('BranchCreated', 'BranchPushed') AND (repository, branch) NOT IN (SELECT repository, branch FROM live)")


def changed(s, d):
    """A file for each revision, as if its number modulo 17 were the file it changed."""
    return X.revisions(s, d).select("revision", (F.col("number") % 17).alias("file"))


Q["file_history"] = lambda s, d: H.file_history(X.revisions(s, d), changed(s, d), tip(s, d, 1)).select("file", "revision", "number", "back")
O["file_history"] = sql("rk rev tips", "SELECT number % 17 AS file, revision, number, CAST(row_number() OVER (PARTITION BY number % 17 ORDER BY distance) AS INTEGER) AS back FROM w", walk(1))
Q["last_modified"] = lambda s, d: H.last_modified(X.revisions(s, d), changed(s, d), tip(s, d, 2))
O["last_modified"] = sql("rk rev tips", "SELECT number % 17 AS file, arg_max(revision, number) AS revision, max(number) AS number FROM w GROUP BY 1", walk(2))

def deltas(s, d):
    """What each revision did to its file: the 40 revisions of a number modulo 17 add it first, move it at every 9th change of it, and delete it at every 31st."""
    r = X.revisions(s, d)
    name = lambda k: F.concat(F.lit("f"), F.col("number") % 17, F.lit("-"), k)
    step = F.floor(F.col("number") / 17).cast("long")
    kind = F.when(step % 31 == 30, "delete").when(step % 31 == 0, "add").when(step % 9 == 8, "move").otherwise("keep")
    moves = lambda n: F.floor((n + 1) / 9)
    return r.select("revision", name(moves(step)).alias("path"), F.when(kind == "move", name(moves(step - 1))).alias("from_path"), kind.alias("action"), "branch", "number")


DELTAS = """de AS (SELECT revision, branch, number, n, number % 17 AS f, number // 17 AS s, 'f' || (number % 17) || '-' || ((number // 17 + 1) // 9) AS path,
    CASE WHEN number // 17 % 31 = 30 THEN 'delete' WHEN number // 17 % 31 = 0 THEN 'add' WHEN number // 17 % 9 = 8 THEN 'move' ELSE 'keep' END AS action FROM rk)"""


@query(
    "file_chain",
    sql(
        "rk",
        """, v AS (SELECT de.*, w.distance, (s + 1) // 9 AS m FROM de JOIN w ON w.revision = de.revision),
    asked AS (SELECT f, max(s) AS last FROM v GROUP BY f), paths AS (SELECT v.f, v.s, v.path FROM v JOIN asked ON asked.f = v.f AND asked.last = v.s),
    -- back from the newest under the asked name: over moves to older names, to the add that began them
    lim AS (SELECT p.f, p.path AS asked, max(v.s) FILTER (v.action = 'add' AND v.s <= p.s) AS low, p.s AS high FROM paths p JOIN v ON v.f = p.f GROUP BY p.f, p.path, p.s)
    SELECT l.asked, v.path, v.revision, v.number, v.action, CAST(row_number() OVER (PARTITION BY l.f ORDER BY v.distance) AS INTEGER) AS back FROM lim l JOIN v ON v.f = l.f AND v.s BETWEEN coalesce(l.low, 0) AND l.high""",
        walk(0) + ", " + DELTAS,
    ),
)
def _(s, d):
    """Histories of the files of the trunk's newest revisions, back over their moves to their adds."""
    own = deltas(s, d).where("branch = 0")
    newest = own.groupBy((F.col("number") % 17).alias("f")).agg(F.max_by("path", "number").alias("path"))
    return H.file_chain(X.revisions(s, d), own.select("revision", "path", "from_path", "action"), tip(s, d, 0), newest.select("path"))


Q["delta_lookup"] = lambda s, d: H.delta_of(deltas(s, d), X.revisions(s, d).select("revision", F.concat(F.lit("f"), F.col("number") % 17, F.lit("-0")).alias("path")))
O["delta_lookup"] = sql("rk", "SELECT revision, 'f' || f || '-0' AS path, CASE WHEN path = 'f' || f || '-0' THEN action END AS action FROM de", DELTAS)
Q["last_merged_files"] = lambda s, d: H.last_merged_files(X.revisions(s, d), X.revisions(s, d).select("revision", (F.col("number") % 6).cast("string").alias("path")), tip(s, d, 2), 0)
O["last_merged_files"] = sql("rk rev", "SELECT path, revision, number FROM (SELECT CAST(r.number % 6 AS VARCHAR) AS path, r.revision, t.number, row_number() OVER (PARTITION BY r.number % 6 ORDER BY r.number DESC) AS n FROM rev r JOIN rk t ON t.revision = r.parent_other WHERE r.branch = 2) WHERE n = 1")

ROOTS = [(3,), (8,), (21,)]


def roots(s):
    return s.createDataFrame(ROOTS, "node long")


def deps_from(where: str = "", depth: int = 1000, reverse: bool = False) -> str:
    a, b = ("target", "source") if reverse else ("source", "target")
    return f"c AS (SELECT {b} AS node, 1 AS depth FROM dep WHERE {a} IN (3, 8, 21) {where} UNION SELECT dep.{b}, c.depth + 1 FROM c JOIN dep ON dep.{a} = c.node {where} WHERE c.depth < {depth})"


def closed(where: str = "", reverse: bool = False) -> str:
    a, b = ("target", "source") if reverse else ("source", "target")
    return f"c AS (SELECT {b} AS node FROM dep WHERE {a} IN (3, 8, 21) {where} UNION SELECT dep.{b} FROM c JOIN dep ON dep.{a} = c.node {where})"


Q["dep_rows"] = lambda s, d: X.dependencies(s, d)
O["dep_rows"] = sql("dep", "SELECT source, target, tag FROM dep")
Q["dep_direct"] = lambda s, d: graph.direct(X.dependencies(s, d), roots(s)).select("source", "target", F.array_join("tags", ",").alias("tags"))
O["dep_direct"] = sql("dep", "SELECT source, target, string_agg(tag, ',' ORDER BY tag) AS tags FROM dep WHERE source IN (3, 8, 21) GROUP BY source, target")
Q["dep_reverse"] = lambda s, d: graph.direct(X.dependencies(s, d), roots(s), reverse=True).select("source", "target", F.array_join("tags", ",").alias("tags"))
O["dep_reverse"] = sql("dep", "SELECT source, target, string_agg(tag, ',' ORDER BY tag) AS tags FROM dep WHERE target IN (3, 8, 21) GROUP BY source, target")
Q["dep_tag_merge"] = lambda s, d: graph.merged_tags(X.dependencies(s, d)).select("source", "target", F.array_join("tags", ",").alias("tags"))
O["dep_tag_merge"] = sql("dep", "SELECT source, target, string_agg(tag, ',' ORDER BY tag) AS tags FROM dep GROUP BY source, target")
Q["dep_closure"] = lambda s, d: graph.closure(X.dependencies(s, d), roots(s)).select("node")
O["dep_closure"] = sql("dep", "SELECT node FROM c", closed())
Q["dep_closure_depth2"] = lambda s, d: graph.closure(X.dependencies(s, d), roots(s), depth=2)
O["dep_closure_depth2"] = sql("dep", "SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY node", deps_from(depth=2))
Q["dep_closure_tag"] = lambda s, d: graph.closure(X.dependencies(s, d), roots(s), tags=["A", "N"]).select("node")
O["dep_closure_tag"] = sql("dep", "SELECT node FROM c", closed("AND tag IN ('A', 'N')"))
Q["dep_closure_reverse"] = lambda s, d: graph.closure(X.dependencies(s, d), roots(s), reverse=True).select("node")
O["dep_closure_reverse"] = sql("dep", "SELECT node FROM c", closed(reverse=True))
Q["dep_included"] = lambda s, d: graph.included(X.dependencies(s, d), roots(s))
O["dep_included"] = sql("dep", "SELECT node FROM c UNION SELECT unnest([3, 8, 21])", closed())
Q["dep_cycles"] = lambda s, d: graph.on_cycles(X.dependencies(s, d))
O["dep_cycles"] = sql("dep", "SELECT DISTINCT source AS node FROM t WHERE source = target", "t AS (SELECT source, target FROM dep UNION SELECT t.source, dep.target FROM t JOIN dep ON dep.source = t.target)")
Q["dep_added_acyclic"] = lambda s, d: graph.add(s.createDataFrame([(1, 2, "a"), (2, 3, "a")], "source long, target long, tag string"), X.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_nationkey") * 3 % 7).cast("long").alias("target"), F.lit("n").alias("tag")).where("source <> target").unionByName(s.createDataFrame([(3, 1, "back")], "source long, target long, tag string")), acyclic=True)
O["dep_added_acyclic"] = """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_nationkey * 3 % 7 AS BIGINT) AS target, 'n' AS tag FROM nation WHERE n_nationkey <> n_nationkey * 3 % 7 UNION ALL SELECT 3, 1, 'back'),
    k AS (SELECT 1 AS source, 2 AS target, 'a' AS tag UNION ALL SELECT 2, 3, 'a'), b AS (SELECT * FROM e UNION SELECT * FROM k),
    t AS (SELECT source, target FROM b UNION SELECT t.source, b.target FROM t JOIN b ON b.source = t.target), c AS (SELECT source AS node FROM t WHERE source = target)
    SELECT * FROM k UNION SELECT * FROM e WHERE NOT (source IN (SELECT node FROM c) AND target IN (SELECT node FROM c))"""
Q["dep_removed"] = lambda s, d: graph.remove(X.dependencies(s, d), X.dependencies(s, d).where("source % 3 = 0").select("source", "target", F.when(F.col("source") % 2 == 0, F.col("tag")).alias("tag")))
O["dep_removed"] = sql("dep", "SELECT source, target, tag FROM dep WHERE source % 3 <> 0")

QUERIES, ORACLES = Q, O
