"""Queries on the content store, mutable tables, text and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from grove.functions.paths import block_of, decoded, has_conflict_marker, salted, stack_points, url_parts
from grove.operators import chunks, contents, store, tables, texts
from grove.plans._sql import sql
from grove.session import checkpointed, shared_dir
from grove.sources import fixtures as X
from grove.streaming import events as E

Q, O = {}, {}


def query(name: str, oracle: str):
    def put(f):
        Q[name], O[name] = f, oracle
        return f

    return put



def half(s, d):
    """A store of half of the documents' fragments."""
    return X.fragments(s, d).where("doc_id % 2 = 0")


Q["fragment_rows"] = lambda s, d: X.fragments(s, d)
O["fragment_rows"] = sql("frag", "SELECT doc_id, part, seq, hash, sz FROM frag")
Q["store_match_level"] = lambda s, d: store.match_level(X.fragments(s, d), half(s, d)).groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("hashes"))
O["store_match_level"] = sql(
    "frag",
    """, h AS (SELECT * FROM frag WHERE doc_id % 2 = 0), a AS (SELECT hash, part, doc_id FROM frag),
    l AS (SELECT a.hash, CASE WHEN (a.hash, a.part, a.doc_id) IN (SELECT hash, part, doc_id FROM h) THEN 3 WHEN (a.hash, a.part) IN (SELECT hash, part FROM h) THEN 2 WHEN a.hash IN (SELECT hash FROM h) THEN 1 ELSE 0 END AS level FROM a)
    SELECT CAST(level AS INTEGER) AS level, count(*) AS n, count(DISTINCT hash) AS hashes FROM l GROUP BY level""",
)
Q["store_put"] = lambda s, d: store.put(half(s, d), X.fragments(s, d)).select("hash", "part", "doc_id")
O["store_put"] = sql("frag", "SELECT DISTINCT hash, part, doc_id FROM frag WHERE (hash, part, doc_id) NOT IN (SELECT hash, part, doc_id FROM frag WHERE doc_id % 2 = 0)")
Q["store_new_fragments"] = lambda s, d: store.new_hashes(X.fragments(s, d), half(s, d), X.fragments(s, d).where("doc_id % 7 = 0"))
O["store_new_fragments"] = sql("frag", "SELECT DISTINCT hash FROM frag WHERE hash NOT IN (SELECT hash FROM frag WHERE doc_id % 2 = 0 OR doc_id % 7 = 0)")
Q["store_copy"] = lambda s, d: store.copy(X.fragments(s, d), "de", "en").select("hash", "part", "doc_id")
O["store_copy"] = sql("frag", "SELECT DISTINCT hash, 'en' AS part, doc_id FROM frag WHERE part = 'de' AND (hash, doc_id) NOT IN (SELECT hash, doc_id FROM frag WHERE part = 'en')")


def payloads(s, d):
    docs = X.table(s, d, "documents").where("length(text) > 0")
    rows = docs.select("text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 256).cast("int"))).alias("n"))
    chunk = F.substr("text", F.col("n") * 256 + 1, F.lit(256))
    return rows.select(F.sha2(chunk, 256).alias("hash"), chunk.alias("payload")).dropDuplicates(["hash"])


def large(s, d):
    """Contents of hundreds of kilobytes: 300 documents each, in order of their ids."""
    docs = X.table(s, d, "documents").where("text is not null").groupBy(F.floor(F.col("doc_id") / 300).cast("string").alias("name"))
    return docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "").alias("content"))


LARGE = "WITH l AS (SELECT CAST(doc_id // 300 AS VARCHAR) AS name, string_agg(text, '' ORDER BY doc_id) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1)"


def laid(s, d):
    return checkpointed(contents.put(large(s, d), "name", "content"))


Q["content_put"] = lambda s, d: contents.references(laid(s, d)).groupBy("key").agg(F.sum("size").alias("size"), (F.count("*") > 1).alias("listed"), (F.max("size") <= 262144).alias("bounded"), (F.min("start") == 0).alias("from_zero"))
O["content_put"] = LARGE + " SELECT name AS key, CAST(octet_length(encode(content)) AS BIGINT) AS size, octet_length(encode(content)) > 262144 AS listed, TRUE AS bounded, TRUE AS from_zero FROM l"
Q["content_tiles"] = lambda s, d: contents.references(laid(s, d)).withColumn("before", F.lag(F.col("start") + F.col("size")).over(Window.partitionBy("key").orderBy("seq"))).groupBy("key").agg(F.bool_and(F.col("start") == F.coalesce("before", F.lit(0))).alias("tiles"), F.max(F.col("start") + F.col("size")).alias("end"))
O["content_tiles"] = LARGE + " SELECT name AS key, TRUE AS tiles, CAST(octet_length(encode(content)) AS BIGINT) AS end FROM l"


@query("content_get", LARGE + " SELECT name AS key, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS digest, TRUE AS valid FROM l")
def _(s, d):
    """Contents put and read again, chunk by chunk, each held against its digest."""
    rows = laid(s, d)
    return contents.joined(contents.parts(contents.references(rows), contents.fragments(rows)))


@query("content_range", LARGE + " SELECT name AS key, CAST(greatest(least(octet_length(encode(content)), 300000) - 250000, 0) AS BIGINT) AS size FROM l WHERE octet_length(encode(content)) > 250000")
def _(s, d):
    """Bytes 250,000 to 300,000 of each content, from the chunks that hold them alone."""
    rows = laid(s, d)
    return contents.joined(contents.parts(contents.references(rows), contents.fragments(rows), 250_000, 300_000)).select("key", "size")


Q["content_fixed"] = lambda s, d: contents.references(contents.put(large(s, d), "name", "content", fixed=65_536)).groupBy("key").agg(F.count("*").alias("chunks"), F.max("size").alias("largest"))
O["content_fixed"] = LARGE + ", z AS (SELECT name, octet_length(encode(content)) AS n FROM l) SELECT name AS key, CASE WHEN n > 262144 THEN (n + 65535) // 65536 ELSE 1 END AS chunks, CAST(CASE WHEN n > 262144 THEN 65536 ELSE n END AS BIGINT) AS largest FROM z"


def listed(s, d):
    """All documents' fragments, below lists of documents, below one root."""
    own = X.fragments(s, d).select(F.concat(F.lit("doc"), "doc_id").alias("list_hash"), "hash")
    return own.unionByName(own.select(F.lit("all").alias("list_hash"), F.col("list_hash").alias("hash")).distinct())


Q["store_status"] = lambda s, d: store.status(listed(s, d), "all", half(s, d), X.fragments(s, d).where("doc_id % 3 = 0"))
O["store_status"] = sql("frag", """, h AS (SELECT DISTINCT hash FROM frag) SELECT DISTINCT 'doc' || doc_id AS hash, 1 AS depth, CAST(0 AS INTEGER) AS status FROM frag
    UNION ALL SELECT hash, 2, CAST(CASE WHEN hash IN (SELECT hash FROM frag WHERE doc_id % 2 = 0) THEN 1 ELSE 0 END + CASE WHEN hash IN (SELECT hash FROM frag WHERE doc_id % 3 = 0) THEN 2 ELSE 0 END AS INTEGER) FROM h""")  # fmt: skip
Q["store_point"] = lambda s, d: store.point(X.fragments(s, d), X.fragments(s, d).agg(F.min("hash")).first()[0]).select("doc_id", "seq", "sz")
O["store_point"] = sql("frag", "SELECT doc_id, seq, sz FROM frag WHERE hash = (SELECT min(hash) FROM frag)")
Q["store_flags"] = lambda s, d: store.sanitised(X.fragments(s, d).select("doc_id", "seq", (F.col("seq") * 40961 + F.col("doc_id") * 65537).alias("flags")))
O["store_flags"] = sql("frag", "SELECT doc_id, seq, CAST((seq * 40961 + doc_id * 65537) & 65535 AS BIGINT) AS flags, CAST((seq * 40961 + doc_id * 65537) & 4294901760 AS BIGINT) AS asked FROM frag")
Q["dedup_stats"] = lambda s, d: store.statistics(X.fragments(s, d))
O["dedup_stats"] = sql("frag", ", h AS (SELECT hash, count(*) AS n, CAST(max(sz) AS BIGINT) AS sz FROM frag GROUP BY hash) SELECT CAST(sum(n) AS BIGINT) AS refs, count(*) AS distinct_hashes, CAST(sum(n * sz) AS BIGINT) AS raw_bytes, CAST(sum(sz) AS BIGINT) AS distinct_bytes, CAST(sum(n - 1) AS BIGINT) AS dedup_refs, CAST(sum((n - 1) * sz) AS BIGINT) AS dedup_bytes FROM h")
Q["chunk_histogram"] = lambda s, d: store.histogram(X.fragments(s, d), 256)
O["chunk_histogram"] = sql("frag", ", h AS (SELECT hash, max(sz) AS sz FROM frag GROUP BY hash) SELECT CAST(least(sz * 64 // 256, 63) AS INTEGER) AS bucket, count(*) AS fragments, CAST(sum(sz) AS BIGINT) AS bytes FROM h GROUP BY 1")
Q["list_validate"] = lambda s, d: store.valid_lists(X.fragments(s, d).where("(doc_id + seq) % 11 <> 0"), 256)
O["list_validate"] = sql("frag", ", f AS (SELECT * FROM frag WHERE (doc_id + seq) % 11 <> 0) SELECT doc_id, count(*) >= 2 AND min(seq) = 0 AND max(seq) = count(*) - 1 AS valid FROM f GROUP BY doc_id")


def accessed(s, d):
    return X.fragments(s, d).select((F.col("doc_id") % 16).alias("bucket"), F.concat_ws("-", "doc_id", "seq").alias("hash"), (F.col("doc_id") * 7 % 101 + F.col("seq")).alias("last_access"), (F.col("seq") % 5 != 0).alias("durable"), "sz")


ACCESSED = ", f AS (SELECT doc_id % 16 AS bucket, doc_id || '-' || seq AS hash, doc_id * 7 % 101 + seq AS last_access, seq % 5 <> 0 AS durable, sz FROM frag)"
def cut(count: str, where: str) -> str:
    """Rows that go: in each bucket over 70 of those that count, all up to the time of the one that brings it down to 70."""
    return f""", c AS (SELECT bucket, list_sort(list(last_access)) AS t FROM f WHERE {where} GROUP BY bucket HAVING count(*) > 70)
    SELECT f.bucket, f.hash, f.last_access FROM f JOIN c ON c.bucket = f.bucket WHERE {where} AND f.last_access <= c.t[len(c.t) - 70]{count}"""


Q["evict_lru"] = lambda s, d: store.evictable(accessed(s, d), 100).select("bucket", "hash", "last_access")
O["evict_lru"] = sql("frag", ACCESSED + cut("", "durable"))
Q["evict_unprotected"] = lambda s, d: store.evictable(accessed(s, d), 100, protect=False).select("bucket", "hash", "last_access")
O["evict_unprotected"] = sql("frag", ACCESSED + cut("", "TRUE"))


@query("gc", sql("frag", ACCESSED + ", g AS (" + cut("", "durable").replace(", c AS (", "WITH c AS (", 1) + "), l AS (SELECT * FROM f WHERE (bucket, hash) NOT IN (SELECT bucket, hash FROM g)) SELECT (SELECT count(*) FROM l) AS fragments, (SELECT count(DISTINCT hash) FROM l) AS payloads"))
def _(s, d):
    """Compaction and eviction: fragments and payloads that are left, of a store that also has payloads nothing names."""
    held = accessed(s, d).select("hash", F.lit("x").alias("payload"))
    left, kept = store.collected_garbage(accessed(s, d), held.unionByName(held.select(F.concat(F.lit("unnamed-"), "hash").alias("hash"), "payload")), 100)
    return left.agg(F.count("*").alias("fragments")).join(kept.agg(F.count("*").alias("payloads")))


Q["compact"] = lambda s, d: store.compacted(half(s, d), payloads(s, d)).agg(F.count("*").alias("kept"))
O["compact"] = sql("frag", "SELECT count(DISTINCT hash) AS kept FROM frag WHERE doc_id % 2 = 0")
Q["rebalance"] = lambda s, d: store.rebalanced(X.fragments(s, d), 1024).groupBy("bucket").agg(F.count("*").alias("n"))
O["rebalance"] = sql("frag", "SELECT CAST(CAST('0x' || substring(hash, 1, 6) AS BIGINT) >> 14 AS BIGINT) AS bucket, count(*) AS n FROM frag GROUP BY 1")
Q["durable_mark"] = lambda s, d: store.made_durable(accessed(s, d), accessed(s, d).where("bucket = 3")).groupBy("bucket").agg(F.count_if("durable").alias("durable"))
O["durable_mark"] = sql("frag", ACCESSED + " SELECT bucket, count(*) FILTER (durable OR bucket = 3) AS durable FROM f GROUP BY bucket")
Q["evict_by_size"] = lambda s, d: store.reclaim(accessed(s, d), 5000).select("bucket", "hash")
O["evict_by_size"] = sql("frag", ACCESSED + ", r AS (SELECT *, sum(sz) OVER (PARTITION BY bucket ORDER BY last_access, hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sz AS freed FROM f) SELECT bucket, hash FROM r WHERE freed < 5000")
Q["fan_out_level"] = lambda s, d: store.fan_out(X.fragments(s, d).groupBy(F.substr("hash", F.lit(1), F.lit(2)).alias("b")).agg(F.count("*").alias("n")), 256, 16)
O["fan_out_level"] = sql("frag", ", b AS (SELECT substring(hash, 1, 2) AS b, count(*) AS n FROM frag GROUP BY 1), m AS (SELECT max(n) AS largest FROM b) SELECT largest, CAST(CASE WHEN largest * 16 <= 256 THEN 256 WHEN largest * 16 <= 1024 THEN 1024 WHEN largest * 16 <= 4096 THEN 4096 WHEN largest * 16 <= 16384 THEN 16384 ELSE 65536 END AS INTEGER) AS level FROM m")
Q["verify_store"] = lambda s, d: store.corrupt(X.table(s, d, "documents").select(F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 10 == 3, F.upper("text")).otherwise(F.col("text")).alias("payload"), F.length("text").alias("sz"), "doc_id")).select("doc_id")
O["verify_store"] = "SELECT doc_id FROM documents WHERE doc_id % 10 = 3 AND upper(text) <> text"
Q["obliterate"] = lambda s, d: store.obliterated(X.fragments(s, d), X.fragments(s, d).where("doc_id % 9 = 0"))[1]
O["obliterate"] = sql("frag", "SELECT count(*) AS fragments, CAST(coalesce(sum(sz), 0) AS BIGINT) AS bytes FROM frag WHERE hash IN (SELECT hash FROM frag WHERE doc_id % 9 = 0)")
Q["tier_choice"] = lambda s, d: store.tiers(payloads(s, d).where("hash < '8'"), payloads(s, d)).groupBy("tier").agg(F.count("*").alias("n"))
O["tier_choice"] = sql("frag", "SELECT CAST(CASE WHEN hash < '8' THEN 0 ELSE 1 END AS INTEGER) AS tier, count(DISTINCT hash) AS n FROM frag GROUP BY 1")
Q["chunk_cdc"] = lambda s, d: chunks.chunked(large(s, d), "name", "content")
Q["compress_ratio"] = lambda s, d: store.compressed(X.table(s, d, "documents"))

Q["event_rows"] = lambda s, d: X.events(s, d).select("event_id", "repository", "kind", "branch", "owner", "resource")
O["event_rows"] = sql("ev", "SELECT event_id, repository, kind, branch, owner, resource FROM ev")
Q["kv_latest"] = lambda s, d: tables.latest(X.events(s, d).where("kind in ('BranchPushed', 'BranchDeleted')").withColumn("value", F.when(F.col("kind") == "BranchPushed", F.col("number"))), ("repository", "branch"), "event_id", "value")
O["kv_latest"] = sql("ev", "SELECT repository, branch, arg_max(event_id, event_id) AS value FROM ev WHERE kind IN ('BranchPushed', 'BranchDeleted') GROUP BY repository, branch HAVING arg_max(kind, event_id) = 'BranchPushed'")
Q["kv_list_type"] = lambda s, d: X.events(s, d).where("repository = 2 and kind = 'BranchPushed'").groupBy("branch").agg(F.max("number").alias("value"))
O["kv_list_type"] = sql("ev", "SELECT branch, max(number) AS value FROM ev WHERE repository = 2 AND kind = 'BranchPushed' GROUP BY branch")
Q["kv_upsert"] = lambda s, d: tables.upsert(X.events(s, d).where("event_id % 2 = 0").groupBy("owner").agg(F.max("number").alias("v")), X.events(s, d).where("event_id % 2 = 1").groupBy("owner").agg(F.max("number").alias("n")).select("owner", F.when(F.col("n") % 4 != 1, F.col("n")).alias("v")), ("owner",), "v")
O["kv_upsert"] = sql("ev", ", o AS (SELECT owner, max(number) AS v FROM ev WHERE event_id % 2 = 0 GROUP BY owner), n AS (SELECT owner, max(number) AS v FROM ev WHERE event_id % 2 = 1 GROUP BY owner) SELECT owner, v FROM o WHERE owner NOT IN (SELECT owner FROM n) UNION ALL SELECT owner, v FROM n WHERE v % 4 <> 1")


def requests(s, d):
    """Requests that expect the value of the request before them, that of two before, or none; every fifth deletes."""
    order = Window.partitionBy("key").orderBy("seq")
    rows = X.events(s, d).select(F.col("branch").alias("key"), F.col("event_id").alias("seq")).withColumn("value", F.when(F.col("seq") % 5 != 0, F.col("seq") + 2**53))
    expected = F.when(F.col("seq") % 3 == 0, F.lag("value").over(order)).when(F.col("seq") % 3 == 1, F.lag("value", 2).over(order))
    return rows.withColumn("expected", expected)


#: A state machine over each key's requests, one after the other.
REPLAY = """, e AS (SELECT branch AS key, event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN event_id + 9007199254740992 END AS value, row_number() OVER (PARTITION BY branch ORDER BY event_id) AS n FROM ev),
    x AS (SELECT *, CASE WHEN seq % 3 = 0 THEN lag(value) OVER w WHEN seq % 3 = 1 THEN lag(value, 2) OVER w END AS expected FROM e WINDOW w AS (PARTITION BY key ORDER BY seq))"""
STEPS = """r AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS now, FALSE AS swapped, CAST(NULL AS BIGINT) AS previous FROM (SELECT DISTINCT key FROM x)
    UNION ALL SELECT x.key, x.n, x.seq, CASE WHEN r.now IS NULL OR r.now = x.expected THEN x.value ELSE r.now END, coalesce(r.now IS NULL OR r.now = x.expected, FALSE), r.now FROM r JOIN x ON x.key = r.key AND x.n = r.n + 1)"""
Q["kv_cas_replay"] = lambda s, d: tables.swaps(requests(s, d))
O["kv_cas_replay"] = sql("ev", "SELECT key, seq, swapped, previous FROM r WHERE n > 0", REPLAY[2:] + ", " + STEPS)


def pushes(s, d):
    """Pushes onto the one before, onto an older one, or the same again; two branches are protected."""
    order = Window.partitionBy("branch").orderBy("seq")
    rows = X.events(s, d).where("kind = 'BranchPushed'").select("branch", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.floor(F.col("event_id") / 8) * 8).otherwise(F.col("event_id")).cast("string").alias("revision"))
    back = F.when(F.col("seq") % 5 == 0, 2).otherwise(1)
    return rows.withColumn("parent", F.when(back == 2, F.lag("revision", 2).over(order)).otherwise(F.lag("revision").over(order))).withColumn("protected", F.col("branch") > 4).withColumn("service", F.col("seq") % 2 == 0)


PUSHES = """e AS (SELECT branch, event_id AS seq, CAST(CASE WHEN event_id % 4 = 0 THEN event_id // 8 * 8 ELSE event_id END AS VARCHAR) AS revision, row_number() OVER (PARTITION BY branch ORDER BY event_id) AS n FROM ev WHERE kind = 'BranchPushed'),
    x AS (SELECT *, CASE WHEN seq % 5 = 0 THEN lag(revision, 2) OVER w ELSE lag(revision) OVER w END AS parent, branch > 4 AND seq % 2 <> 0 AS barred FROM e WINDOW w AS (PARTITION BY branch ORDER BY seq)),
    r AS (SELECT branch, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS result, CAST(NULL AS VARCHAR) AS head, CAST(0 AS BIGINT) AS number FROM (SELECT DISTINCT branch FROM x)
    UNION ALL SELECT branch, n, seq, result, CASE WHEN result = 'accepted' THEN revision ELSE head END, number + CASE WHEN result = 'accepted' THEN 1 ELSE 0 END FROM
        (SELECT x.branch, x.n, x.seq, x.revision, r.head, r.number, CASE WHEN x.barred THEN 'denied' WHEN r.head = x.revision THEN 'noop' WHEN r.head IS NULL AND x.parent IS NOT NULL THEN 'missing' WHEN r.head IS NOT DISTINCT FROM x.parent THEN 'accepted' ELSE 'behind' END AS result
         FROM r JOIN x ON x.branch = r.branch AND x.n = r.n + 1))"""
Q["push_replay"] = lambda s, d: tables.pushed(pushes(s, d))
O["push_replay"] = sql("ev", "SELECT branch, seq, result, head, number FROM r WHERE n > 0", PUSHES)
Q["lock_state"] = lambda s, d: tables.lock_state(X.events(s, d)).drop("locked_at")
O["lock_state"] = sql("lk", "SELECT repository, branch, resource, owner FROM lk")
Q["lock_by_owner"] = lambda s, d: tables.query_locks(tables.lock_state(X.events(s, d)), owner=12).select("repository", "branch", "resource")
O["lock_by_owner"] = sql("lk", "SELECT repository, branch, resource FROM lk WHERE owner = 12")
Q["lock_by_branch"] = lambda s, d: tables.query_locks(tables.lock_state(X.events(s, d)), branch=3, resources=[1, 4, 7]).select("repository", "resource", "owner")
O["lock_by_branch"] = sql("lk", "SELECT repository, resource, owner FROM lk WHERE branch = 3 AND resource IN (1, 4, 7)")


def wanted(s, d):
    return X.events(s, d).where("kind = 'ResourceLocked'").select((F.col("owner") * 1000 + F.col("branch")).alias("request"), "repository", "branch", "resource", "owner").distinct()


WANTED = """, q AS (SELECT DISTINCT owner * 1000 + branch AS request, repository, branch, resource, owner FROM ev WHERE kind = 'ResourceLocked'),
    f AS (SELECT repository, branch, resource, min(request) AS first FROM q GROUP BY ALL),
    j AS (SELECT q.*, lk.owner AS holder, coalesce(lk.owner <> q.owner, q.request <> f.first) AS clash FROM q LEFT JOIN lk ON lk.repository = q.repository AND lk.branch = q.branch AND lk.resource = q.resource
          JOIN f ON f.repository = q.repository AND f.branch = q.branch AND f.resource = q.resource)"""
Q["lock_conflicts"] = lambda s, d: tables.acquire(tables.lock_state(X.events(s, d)), wanted(s, d))[1]
O["lock_conflicts"] = sql("ev lk", WANTED + " SELECT request, repository, branch, resource, owner, holder FROM j WHERE clash")
Q["lock_acquired"] = lambda s, d: tables.acquire(tables.lock_state(X.events(s, d)), wanted(s, d))[0]
O["lock_acquired"] = sql("ev lk", WANTED + " SELECT request, repository, branch, resource, owner FROM j WHERE holder IS NULL AND request NOT IN (SELECT request FROM j WHERE clash)")
Q["lock_released"] = lambda s, d: tables.release(tables.lock_state(X.events(s, d)), tables.lock_state(X.events(s, d)).where("owner % 2 = 0").select("repository", "branch", "resource", "owner")).select("repository", "branch", "resource", "owner")
O["lock_released"] = sql("lk", "SELECT repository, branch, resource, owner FROM lk WHERE owner % 2 <> 0")
Q["lock_by_description"] = lambda s, d: tables.query_locks(tables.lock_state(X.events(s, d)).withColumn("description", F.concat(F.lit("Res/"), "resource")), repository=2, like="res/1*").select("branch", "resource", "owner")
O["lock_by_description"] = sql("lk", "SELECT branch, resource, owner FROM lk WHERE repository = 2 AND starts_with('res/' || resource, 'res/1')")
Q["metadata_shown"] = lambda s, d: tables.shown(X.revision_metadata(s, d).withColumn("flag", F.col("num") % 2 == 0).withColumn("raw", F.encode("str", "UTF-8")).withColumn("type", F.when(F.col("key") == "change-request", "binary").otherwise(F.col("type"))).unionByName(X.revisions(s, d).select("revision", F.lit("self").alias("key"), F.lit("hash").alias("type"), F.upper("revision").alias("str"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("binary").alias("raw"))))
O["metadata_shown"] = sql("rk", """SELECT revision, 'created-by' AS key, 'string' AS type, CAST(o_custkey AS VARCHAR) AS value FROM rk UNION ALL SELECT revision, 'timestamp', 'numeric', CAST(epoch_ms(o_orderdate) AS VARCHAR) FROM rk
    UNION ALL SELECT revision, 'change-request', 'binary', lower(hex(o_orderpriority)) FROM rk UNION ALL SELECT revision, 'self', 'hash', revision FROM rk""")  # fmt: skip
Q["metadata_typed"] = lambda s, d: tables.typed(X.revision_metadata(s, d)).select("revision", F.col("entries")["created-by"].alias("created_by"), F.col("entries")["timestamp"].alias("at"))
O["metadata_typed"] = sql("rk", "SELECT revision, CAST(o_custkey AS VARCHAR) AS created_by, CAST(epoch_ms(o_orderdate) AS VARCHAR) AS at FROM rk")
Q["metadata_walk"] = lambda s, d: X.revision_metadata(s, d).groupBy("key", "type").agg(F.count("*").alias("n"), F.countDistinct("str").alias("texts"))
O["metadata_walk"] = sql("rk", "SELECT 'created-by' AS key, 'string' AS type, count(*) AS n, count(DISTINCT o_custkey) AS texts FROM rk UNION ALL SELECT 'timestamp', 'numeric', count(*), 0 FROM rk UNION ALL SELECT 'change-request', 'string', count(*), count(DISTINCT o_orderpriority) FROM rk")
Q["metadata_set"] = lambda s, d: tables.set_metadata(X.revision_metadata(s, d), X.revision_metadata(s, d).where("key <> 'created-by'").withColumn("str", F.lit("new"))).groupBy("key", "str").agg(F.count("*").alias("n")).where("key <> 'created-by'")
O["metadata_set"] = sql("rk", "SELECT 'change-request' AS key, 'new' AS str, count(*) AS n FROM rk UNION ALL SELECT 'timestamp', NULL, count(*) FROM rk")

Q["text_unified_diff"] = lambda s, d: texts.diffs(X.table(s, d, "documents").select("doc_id", "text", F.regexp_replace("text", "(?m)^T", "t").alias("new")), "doc_id", "text", "new")
Q["text_merge3"] = lambda s, d: texts.merges(X.table(s, d, "documents").select("doc_id", "text", F.regexp_replace("text", "^.", "x").alias("ours"), F.concat("text", F.lit("\nmore")).alias("theirs")), "doc_id", "text", "ours", "theirs")
Q["text_diffable"] = lambda s, d: X.table(s, d, "pages").withColumn("raw", F.when(F.col("page_id") % 5 == 1, F.concat(F.unhex(F.lit("C328FF")), F.encode("html", "UTF-8"))).otherwise(F.encode(F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-").otherwise(""), "html"), "UTF-8"))).select("page_id", texts.diffable("raw").alias("diffable"), texts.mime("raw").alias("mime"))
O["text_diffable"] = """WITH k AS (SELECT page_id, html, CASE WHEN page_id % 5 = 1 THEN 'application/octet-stream' WHEN page_id % 3 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime FROM pages)
    SELECT page_id, length(html) > 0 AND mime = 'text/plain' AS diffable, mime FROM k WHERE html IS NOT NULL"""
Q["text_decoded"] = lambda s, d: X.table(s, d, "conversations").where("text is not null").select("conv_id", "turn", decoded(F.when(F.col("turn") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("turn") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))).alias("text"))
O["text_decoded"] = "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL"
Q["url_split"] = lambda s, d: X.table(s, d, "pages").select("page_id", url_parts("url").alias("u")).select("page_id", "u.remote", "u.name")
O["url_split"] = "SELECT page_id, nullif(regexp_extract(rtrim(url, '/'), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/[^/]+)*)/[^/]+$', 1), '') AS remote, CASE WHEN regexp_matches(rtrim(url, '/'), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(/[^/]+)*/[^/]+$') THEN regexp_extract(rtrim(url, '/'), '[^/]*$') END AS name FROM pages"
Q["key_salted"] = lambda s, d: X.table(s, d, "nation").select("n_nationkey", salted("store", "branch", "n_name", "n_regionkey").alias("key"))
O["key_salted"] = "SELECT n_nationkey, sha256('store' || chr(31) || 'branch' || chr(31) || n_name || chr(31) || n_regionkey) AS key FROM nation"
Q["stack_decoded"] = lambda s, d: X.branches(s, d).select("id", F.explode_outer(stack_points(F.unhex(F.array_join(F.transform("stack", lambda x: F.concat(F.lpad(F.hex(x["branch"]), 32, "0"), x["revision"])), "")))).alias("p")).select("id", "p.branch", "p.revision")
O["stack_decoded"] = sql("rk tips", "SELECT t.branch AS id, CASE WHEN t.branch > 0 THEN repeat('0', 32) END AS branch, r.revision FROM tips t LEFT JOIN rk r ON t.branch > 0 AND r.branch = 0 AND r.n = 10 * t.branch")
Q["block_index"] = lambda s, d: X.tree(s, d, "base").select("file_id", block_of("file_id")[0].alias("block"), block_of("file_id")[1].alias("at"))
O["block_index"] = sql("base", "SELECT file_id, file_id >> 10 AS block, file_id & 1023 AS at FROM base")
Q["text_conflict_markers"] = lambda s, d: X.table(s, d, "conversations").select("conv_id", "turn", has_conflict_marker(F.concat(F.when(F.col("turn") % 2 == 0, "a\n<<<<<<< ours\n").otherwise("x <<<<<<< "), "text")).alias("marked"))
O["text_conflict_markers"] = "SELECT conv_id, turn, text IS NOT NULL AND turn % 2 = 0 AS marked FROM conversations"

Q["stream_latest_pointer"] = lambda s, d: E.drained(E.latest_pointers(E.source(s, f"{d}/events.parquet")))
O["stream_latest_pointer"] = sql("ev", "SELECT repository, branch, max(number) AS number FROM ev WHERE kind = 'BranchPushed' GROUP BY repository, branch")
Q["stream_event_counts"] = lambda s, d: E.drained(E.counts(E.source(s, f"{d}/events.parquet")))
O["stream_event_counts"] = sql("ev", "SELECT repository, kind, count(*) AS n FROM ev GROUP BY repository, kind")
Q["stream_subscription"] = lambda s, d: E.drained(E.subscribed(E.source(s, f"{d}/events.parquet"), 2, ("BranchPushed",)), "append").select("event_id", "branch")
O["stream_subscription"] = sql("ev", "SELECT event_id, branch FROM ev WHERE repository = 2 AND kind = 'BranchPushed'")
Q["stream_windowed_counts"] = lambda s, d: E.drained(E.windowed(E.source(s, f"{d}/events.parquet")), "append").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n")
O["stream_windowed_counts"] = sql("ev", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, kind, count(*) AS n FROM ev WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM ev) GROUP BY 1, 2")


@query("stream_acknowledged", sql("ev", "SELECT event_id, kind FROM ev WHERE repository = 3"))
def _(s, d):
    """Events published in two parts and read by one subscriber after each: all of its repository, once."""
    path, rows = f"{shared_dir(s)}/published-{uuid.uuid4().hex}", X.table(s, d, "events")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        E.published(rows.where(part), f"{path}/in")
        out = E.drained(E.subscribed(E.source(s, f"{path}/in"), 3), "append", f"{path}/out")
    return out.select("event_id", "kind")


QUERIES, ORACLES = Q, O
