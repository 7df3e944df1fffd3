"""Queries on trees, filters and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions import paths as P
from grove.operators import diff, filters
from grove.operators import tree as T
from grove.plans._sql import sql
from grove.sources import fixtures as X

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return put


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.tree(spark, d, "base"), X.tree(spark, d, "source")


def trees3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (*sides(spark, d), X.tree(spark, d, "target"))


DEPTH = "len(string_split(path, '/'))"

Q["tree_list_prefix"] = lambda s, d: T.listing(X.tree(s, d, "source"), "moved").select("path", "kind", "depth")
O["tree_list_prefix"] = sql("nodes", f"SELECT path, kind, CAST({DEPTH} AS INTEGER) AS depth FROM nodes WHERE path = 'moved' OR starts_with(path, 'moved/')")
Q["tree_list_depth"] = lambda s, d: T.listing(X.tree(s, d, "source"), "", 2).select("path", "kind", "depth")
O["tree_list_depth"] = sql("nodes", f"SELECT path, kind, CAST({DEPTH} AS INTEGER) AS depth FROM nodes WHERE {DEPTH} <= 2")
Q["tree_children"] = lambda s, d: T.children(X.tree(s, d, "source"), "moved").select("name", "kind")
O["tree_children"] = sql("nodes", "SELECT substring(path, 7) AS name, kind FROM nodes WHERE starts_with(path, 'moved/') AND len(string_split(path, '/')) = 2")
Q["tree_dump"] = lambda s, d: T.nodes(X.tree(s, d, "source")).select("path", "kind", "file_id", "hash").orderBy("path")
O["tree_dump"] = sql("nodes", "SELECT path, kind, file_id, hash FROM nodes")
Q["tree_dir_sizes"] = lambda s, d: T.dir_sizes(X.tree(s, d, "source"))
O["tree_dir_sizes"] = sql("source dirs", "SELECT d.path, CAST(sum(s.size) AS BIGINT) AS size, count(*) AS files FROM dirs d JOIN source s ON starts_with(s.path, d.path || '/') GROUP BY d.path")
Q["tree_dir_counts"] = lambda s, d: T.counts(X.tree(s, d, "source"), "moved")
O["tree_dir_counts"] = sql("nodes", "SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind <> 'file') AS directories FROM nodes WHERE path = 'moved' OR starts_with(path, 'moved/')")
Q["tree_dir_hash"] = lambda s, d: T.dir_hashes(X.tree(s, d, "base"))
O["tree_dir_hash"] = sql(
    "base",
    """, f AS (SELECT string_split(path, '/')[1] AS a, string_split(path, '/')[2] AS b, string_split(path, '/')[3] AS c, hash, size FROM base),
    g2 AS (SELECT a, b, substring(sha256(lower(c)), 1, 3) AS g, sha256(string_agg(lower(c) || '|' || hash || '|' || size, chr(10) ORDER BY lower(c) || '|' || hash || '|' || size)) AS d, sum(size) AS size FROM f GROUP BY a, b, g),
    l2 AS (SELECT a, b, sha256(string_agg(d, '' ORDER BY g)) AS hash, CAST(sum(size) AS BIGINT) AS size FROM g2 GROUP BY a, b),
    g1 AS (SELECT a, substring(sha256(lower(b)), 1, 3) AS g, sha256(string_agg(lower(b) || '|' || hash || '|' || size, chr(10) ORDER BY lower(b) || '|' || hash || '|' || size)) AS d, sum(size) AS size FROM l2 GROUP BY a, g),
    l1 AS (SELECT a, sha256(string_agg(d, '' ORDER BY g)) AS hash, CAST(sum(size) AS BIGINT) AS size FROM g1 GROUP BY a)
    SELECT a || '/' || b AS path, hash, size FROM l2 UNION ALL SELECT a, hash, size FROM l1""",
)
Q["tree_case_collisions"] = lambda s, d: T.case_collisions(X.tree(s, d, "source")).select("parent", "lower", F.array_join("variants", ",").alias("variants"))
O["tree_case_collisions"] = sql(
    "nodes",
    """, n AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name FROM nodes)
    SELECT parent, lower(name) AS lower, string_agg(name, ',' ORDER BY name) AS variants FROM n GROUP BY parent, lower(name) HAVING count(*) > 1""",
)


@query("tree_node_paths", sql("base", """, x AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM base)
    SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM x"""))  # fmt: skip
def _(s, d):
    root = s.range(1).select(F.substr(F.sha2(F.lit(""), 256), F.lit(1), F.lit(16))).first()[0]
    return T.node_paths(T.identified(X.tree(s, d, "base")), root).select("path")


@query("tree_lookup", sql("base source", "SELECT a.path AS asked, b.path, b.file_id FROM source a LEFT JOIN base b ON lower(a.path) = lower(b.path)"))
def _(s, d):
    base, source = sides(s, d)
    return T.lookup(base, source)


@query("tree_changed_dirs", sql("chg source dirs", "SELECT d.path, count(*) AS files FROM dirs d JOIN source s ON starts_with(s.path, d.path || '/') WHERE s.path IN (SELECT path FROM chg) GROUP BY d.path"))
def _(s, d):
    base, source = sides(s, d)
    return T.any_changed(source, diff.diff2(base, source))


RULES = ["brand#1*/**", "!/brand#12/economy", "*7.txt", "moved/"]
#: The same rules, as conditions on a lower-case path in order.
HITS = "CASE WHEN starts_with(lp, 'moved/') THEN TRUE WHEN regexp_matches(lp, '(^|/)[^/]*7[.]txt(/|$)') THEN TRUE WHEN starts_with(lp, 'brand#12/economy/') THEN FALSE WHEN regexp_matches(lp, '^brand#1[^/]*/') THEN TRUE ELSE FALSE END"
Q["filter_ignore"] = lambda s, d: X.tree(s, d, "source").where(~filters.excluded("path", filters.parse(RULES[:1]))).select("path")
O["filter_ignore"] = sql("source", "SELECT path FROM source WHERE NOT regexp_matches(lower(path), '^brand#1[^/]*/')")
Q["filter_view"] = lambda s, d: X.tree(s, d, "source").where(~filters.excluded("path", filters.parse(RULES))).select("path")
O["filter_view"] = sql("source", f"SELECT path FROM (SELECT path, lower(path) AS lp FROM source) WHERE NOT ({HITS})")
Q["filter_reason"] = lambda s, d: filters.judged(X.tree(s, d, "source"), filters.parse(["*3.txt"]), filters.parse(RULES)).where("reason is not null").select("path", "reason")
O["filter_reason"] = sql("source", f"SELECT path, reason FROM (SELECT path, CASE WHEN regexp_matches(lp, '3[.]txt$') THEN 'ignore' WHEN {HITS} THEN 'view' END AS reason FROM (SELECT path, lower(path) AS lp FROM source)) WHERE reason IS NOT NULL")
Q["filter_size"] = lambda s, d: X.tree(s, d, "source").where(~filters.excluded("path", filters.parse(RULES))).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
O["filter_size"] = sql("source", f"SELECT CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM (SELECT size, lower(path) AS lp FROM source) WHERE NOT ({HITS})")
Q["filter_from_changes"] = lambda s, d: filters.only_changed(X.tree(s, d, "target"), diff.diff2(*sides(s, d))).select("path")
O["filter_from_changes"] = sql("target chg", "SELECT path FROM target WHERE lower(path) IN (SELECT lower(path) FROM chg)")
Q["filter_prefix_superset"] = lambda s, d: filters.minimal(T.nodes(X.tree(s, d, "source")).where("path like 'moved/%' or kind = 'file'").select("path"))
O["filter_prefix_superset"] = sql("nodes", ", s AS (SELECT DISTINCT path FROM nodes WHERE starts_with(path, 'moved/') OR kind = 'file') SELECT path FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.path IN (regexp_extract(s.path, '^([^/]*)/', 1), regexp_extract(s.path, '^([^/]*/[^/]*)/', 1), regexp_extract(s.path, '^([^/]*/[^/]*/[^/]*)/', 1)))")
Q["filter_name_glob"] = lambda s, d: filters.by_name(X.tree(s, d, "base"), "p?[13]*.txt").select("path")
O["filter_name_glob"] = sql("base", "SELECT path FROM base WHERE regexp_matches(lower(path), '/p[^/][13][^/]*[.]txt$')")
Q["layer_mask"] = lambda s, d: filters.in_layer(X.tree(s, d, "source"), ["moved"]).groupBy("masked").agg(F.count("*").alias("files"))
O["layer_mask"] = sql("source", "SELECT starts_with(path, 'moved/') AS masked, count(*) AS files FROM source GROUP BY 1")
Q["layer_overlay"] = lambda s, d: T.overlay(X.tree(s, d, "target"), X.tree(s, d, "source").where("path like 'moved/%'").withColumn("path", F.expr("substr(path, 7)")), "Brand#12/ECONOMY").select("path", "file_id")
O["layer_overlay"] = sql("target source", "SELECT path, file_id FROM target WHERE NOT starts_with(lower(path), 'brand#12/economy/') UNION ALL SELECT 'Brand#12/ECONOMY/' || substring(path, 7), file_id FROM source WHERE starts_with(path, 'moved/')")
Q["path_remap"] = lambda s, d: X.tree(s, d, "source").select(P.remap("path", "moved", "kept/here").alias("path"), P.parent("path").alias("parent"), P.name("path").alias("name"))
O["path_remap"] = sql("source", "SELECT CASE WHEN starts_with(path, 'moved/') THEN 'kept/here/' || substring(path, 7) ELSE path END AS path, regexp_replace(path, '/?[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name FROM source")
Q["path_clean"] = lambda s, d: X.tree(s, d, "base").select("file_id", P.clean(F.concat(F.lit("./x/../"), F.translate("path", "/", "\\"), F.lit("//"))).alias("path"))
O["path_clean"] = sql("base", "SELECT file_id, path FROM base")
Q["hash_buckets"] = lambda s, d: X.tree(s, d, "base").groupBy(P.hash_bucket("hash").alias("bucket")).agg(F.count("*").alias("n"))
O["hash_buckets"] = sql("base", "SELECT CAST(((strpos('0123456789abcdef', substring(hash, 3, 1)) - 1) * 16 + strpos('0123456789abcdef', substring(hash, 4, 1)) - 1) // 4 AS INTEGER) AS bucket, count(*) AS n FROM base GROUP BY 1")


@query(
    "link_expand",
    """SELECT r_regionkey AS repository, 'region/' || r_name || '/' || n_name || '/c' || c_custkey AS path, 1 AS hops FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT r_regionkey, 'region/' || r_name || '/' || n_name || '/suppliers/s' || s_suppkey, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""",
)
def _(s, d):
    """Regions mount nations, which mount their suppliers: links within links."""
    own = X.links(s, d).select((F.col("repository") + 1000).cast("long").alias("repository"), "mount", F.col("target").cast("long").alias("target"))
    inner = X.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("repository"), F.lit("suppliers").alias("mount"), (F.col("n_nationkey") + 5000).cast("long").alias("target"))
    files = X.table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("repository"), F.concat(F.lit("c"), "c_custkey").alias("path"))
    more = X.table(s, d, "supplier").select((F.col("s_nationkey") + 5000).cast("long").alias("repository"), F.concat(F.lit("s"), "s_suppkey").alias("path"))
    found = T.mounted(own.unionByName(inner), files.unionByName(more)).where("repository between 1000 and 4999")
    return found.select((F.col("repository") - 1000).cast("int").alias("repository"), "path", "hops")


CHANGE = ["action", "path", "from_path", "file_id", "hash", "from_hash", "size"]
Q["diff2_raw"] = lambda s, d: diff.diff2(*sides(s, d))
O["diff2_raw"] = sql("chg", "SELECT * FROM chg")
Q["diff2_moves"] = lambda s, d: diff.collected(*sides(s, d))
O["diff2_moves"] = sql("moves", "SELECT * FROM moves")
Q["diff2_summary"] = lambda s, d: diff.summary(diff.with_moves(diff.diff2(*sides(s, d))))
O["diff2_summary"] = sql("moves", "SELECT action, CASE action WHEN 'keep' THEN 'M' WHEN 'add' THEN 'A' WHEN 'delete' THEN 'D' ELSE 'V' END AS code, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM moves GROUP BY action")
Q["diff2_prefix"] = lambda s, d: diff.diff2(*sides(s, d), prefix="Brand#12")
O["diff2_prefix"] = sql("chg", "SELECT * FROM chg WHERE starts_with(lower(path), 'brand#12/')")
Q["diff2_multi"] = lambda s, d: diff.multi(*sides(s, d), ["Brand#12", "Brand#13/PROMO", "moved"])
O["diff2_multi"] = sql("chg", "SELECT * FROM chg WHERE starts_with(lower(path), 'brand#12/') OR starts_with(lower(path), 'brand#13/promo/') OR starts_with(path, 'moved/')")
Q["diff2_reverse"] = lambda s, d: diff.reverse(diff.with_moves(diff.diff2(*sides(s, d)))).orderBy(F.desc("path"))
O["diff2_reverse"] = sql("moves", "SELECT CASE action WHEN 'add' THEN 'delete' WHEN 'delete' THEN 'add' ELSE action END AS action, CASE WHEN action = 'move' THEN from_path ELSE path END AS path, CASE WHEN action = 'move' THEN path END AS from_path, file_id, from_hash AS hash, hash AS from_hash, size FROM moves")
Q["diff2_apply"] = lambda s, d: diff.apply(sides(s, d)[0], diff.with_moves(diff.diff2(*sides(s, d))))
O["diff2_apply"] = sql("source", "SELECT path, file_id, hash, size FROM source")
Q["diff2_revert"] = lambda s, d: diff.apply(sides(s, d)[1], diff.reverse(diff.with_moves(diff.diff2(*sides(s, d))))).select("path", "file_id", "hash")
O["diff2_revert"] = sql("base", "SELECT path, file_id, hash FROM base")
Q["diff2_deletes_deepest"] = lambda s, d: diff.deletes_deepest_first(diff.diff2(*sides(s, d))).select("path", "file_id")
O["diff2_deletes_deepest"] = sql("chg", "SELECT path, file_id FROM chg WHERE action = 'delete'")
Q["diff3_changes"] = lambda s, d: diff.diff3(*trees3(s, d)).where("not conflict").select(*CHANGE)
O["diff3_changes"] = sql("d3", "SELECT action, path, from_path, file_id, hash, from_hash, size FROM d3 WHERE NOT same AND NOT conflict")
Q["diff3_conflicts"] = lambda s, d: diff.diff3(*trees3(s, d)).where("conflict").select("action", "path", "from_path")
O["diff3_conflicts"] = sql("d3", "SELECT action, path, from_path FROM d3 WHERE NOT same AND conflict")
Q["diff3_include_same"] = lambda s, d: diff.diff3(*trees3(s, d), include_same=True).select("action", "path", "conflict", (F.col("side") == "both").alias("same"))
O["diff3_include_same"] = sql("d3", "SELECT action, path, conflict, same FROM d3")
Q["diff3_all_sides"] = lambda s, d: diff.diff3(*trees3(s, d), target_scope="all").where("side = 'target'").select("action", "path", "hash")
O["diff3_all_sides"] = sql("ours tchg", "SELECT action, path, hash FROM tchg WHERE path NOT IN (SELECT path FROM ours)")
Q["diff3_move_pass"] = lambda s, d: diff.diff3(*trees3(s, d)).where("action = 'move'").select("path", "from_path", "hash", "conflict")
O["diff3_move_pass"] = sql("d3", "SELECT path, from_path, hash, conflict FROM d3 WHERE NOT same AND action = 'move'")
Q["diff3_resolved"] = lambda s, d: diff.resolved(diff.diff3(*trees3(s, d)), X.tree(s, d, "source").where("file_id % 2 = 0").select("path", F.when(F.col("file_id") % 4 == 0, "mine").otherwise("theirs").alias("answer"))).select("path", "action", "conflict")
O["diff3_resolved"] = sql("d3 source", "SELECT d.path, d.action, d.conflict AND s.path IS NULL AS conflict FROM d3 d LEFT JOIN source s ON s.path = d.path AND s.file_id % 2 = 0 WHERE NOT same AND NOT (d.conflict AND s.path IS NOT NULL AND s.file_id % 4 = 0)")
Q["merge_apply_clean"] = lambda s, d: diff.merged(X.tree(s, d, "target"), diff.diff3(*trees3(s, d))).select("path", "file_id", "hash")
O["merge_apply_clean"] = sql(
    "d3 target",
    """, c AS (SELECT * FROM d3 WHERE NOT same AND NOT conflict), g AS (SELECT path FROM c UNION SELECT from_path FROM c WHERE from_path IS NOT NULL)
    SELECT path, file_id, hash FROM target WHERE path NOT IN (SELECT path FROM g) UNION ALL SELECT path, file_id, hash FROM c WHERE action <> 'delete'""",
)


@query("diff_filesystem", sql("base source", """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.size <> b.size THEN 'modified' WHEN a.file_id % 2 = b.file_id % 3 THEN 'same' WHEN a.hash <> b.hash THEN 'modified' ELSE 'same' END AS state FROM base a FULL JOIN source b ON a.path = b.path"""))
def _(s, d):
    base, source = sides(s, d)
    return diff.case_ladder(base.withColumn("mtime", F.col("file_id") % 2), source.withColumn("mtime", F.col("file_id") % 3))


@query("flag_actions", sql("base", "SELECT file_id, CASE WHEN file_id & 1 <> 0 THEN 'delete' WHEN file_id & 2 <> 0 THEN 'add' WHEN file_id & 4 <> 0 THEN 'move' WHEN file_id & 8 <> 0 THEN 'copy' ELSE 'keep' END AS action, file_id & 128 <> 0 AS conflict FROM base"))
def _(s, d):
    return X.tree(s, d, "base").select("file_id", P.flag_action(F.col("file_id")).alias("action"), P.has_flag(F.col("file_id"), "conflict").alias("conflict"))


QUERIES, ORACLES = Q, O
