"""The fixtures in the checking engine's SQL."""

from __future__ import annotations



def above(files: str, mode: str) -> str:
    """Directories above files; of paths that differ in case alone the first."""
    return f"""SELECT min(path) AS path, 'dir' AS kind, 0 AS file_id, 'dir' AS hash, 0 AS size, {mode} AS mode FROM (SELECT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path
        FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM {files})) GROUP BY lower(path)"""


def changes(a: str, b: str) -> str:
    """Changes of nodes: a change of kind is a delete and an add."""
    cols = "coalesce(b.path, a.path) AS path, CASE WHEN a.path <> b.path THEN a.path END AS from_path"
    return f"""SELECT CASE WHEN a.path <> b.path THEN 'move' ELSE 'keep' END AS action, {cols}, b.kind, b.file_id, b.hash, a.hash AS from_hash, b.size, b.mode, a.mode AS from_mode
        FROM {a} a JOIN {b} b ON lower(a.path) = lower(b.path) AND a.kind = b.kind WHERE a.path <> b.path OR a.mode <> b.mode OR (a.kind = 'file' AND (a.hash <> b.hash OR a.file_id <> b.file_id))
        UNION ALL SELECT 'delete', a.path, NULL, a.kind, a.file_id, NULL, a.hash, a.size, NULL, a.mode FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE lower(a.path) = lower(b.path) AND a.kind = b.kind)
        UNION ALL SELECT 'add', b.path, NULL, b.kind, b.file_id, b.hash, NULL, b.size, b.mode, NULL FROM {b} b WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE lower(a.path) = lower(b.path) AND a.kind = b.kind)"""


CTES = {
    "p": "SELECT p_partkey AS k, p_brand || '/' || p_type || '/p' || p_partkey || '.txt' AS path, p_name || '|' || p_size AS body FROM part",
    "base": "SELECT path, k AS file_id, sha256(body) AS hash, CAST(length(body) AS INTEGER) AS size FROM p WHERE k % 10 <> 0",
    "source": """SELECT CASE WHEN k % 11 = 0 THEN 'moved/' || path WHEN k % 23 = 0 THEN upper(path) ELSE path END AS path, k AS file_id, sha256(b) AS hash, CAST(length(b) AS INTEGER) AS size
        FROM (SELECT *, CASE WHEN k % 7 = 0 THEN body || '|A' ELSE body END AS b FROM p) WHERE (k % 10 <> 0 OR k % 20 = 0) AND k % 17 <> 0""",
    "target": """SELECT path, k AS file_id, sha256(b) AS hash, CAST(length(b) AS INTEGER) AS size
        FROM (SELECT *, CASE WHEN k % 35 = 0 THEN body || '|A' WHEN k % 5 = 1 THEN body || '|B' ELSE body END AS b FROM p) WHERE (k % 10 <> 0 OR k % 30 = 0) AND k % 19 <> 0""",
    # Files' directories: every path is brand/type/file, or that under moved/.
    "dirs": """SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path
        FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM source)""",
    "nodes": """SELECT path, 'file' AS kind, file_id, hash, size FROM source UNION ALL SELECT path, 'dir', NULL, NULL, NULL FROM dirs""",
    "chg": """SELECT CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' WHEN a.path <> b.path THEN 'move' ELSE 'keep' END AS action,
        coalesce(b.path, a.path) AS path, CASE WHEN a.path <> b.path THEN a.path END AS from_path, coalesce(b.file_id, a.file_id) AS file_id,
        b.hash AS hash, a.hash AS from_hash, coalesce(b.size, a.size) AS size
        FROM base a FULL JOIN source b ON lower(a.path) = lower(b.path) WHERE a.path IS NULL OR b.path IS NULL OR a.path <> b.path OR a.hash <> b.hash OR a.file_id <> b.file_id""",
    "tchg": """SELECT CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'keep' END AS action,
        coalesce(b.path, a.path) AS path, coalesce(b.file_id, a.file_id) AS file_id, b.hash AS hash, a.hash AS from_hash, coalesce(b.size, a.size) AS size
        FROM base a FULL JOIN target b ON lower(a.path) = lower(b.path) WHERE a.hash IS DISTINCT FROM b.hash""",
    "pairs": """SELECT a.path AS path, d.path AS from_path FROM (SELECT * FROM chg WHERE action = 'add' AND file_id <> 0) a
        JOIN (SELECT * FROM chg WHERE action = 'delete' AND file_id <> 0) d ON a.file_id = d.file_id""",
    "moves": """SELECT 'move' AS action, c.path, m.from_path, c.file_id, c.hash, d.from_hash, c.size FROM chg c JOIN pairs m ON c.path = m.path AND c.action = 'add' JOIN chg d ON d.path = m.from_path AND d.action = 'delete'
        UNION ALL SELECT * FROM chg c WHERE NOT (c.action = 'add' AND c.path IN (SELECT path FROM pairs)) AND NOT (c.action = 'delete' AND c.path IN (SELECT from_path FROM pairs))""",
    "ours": "SELECT * FROM moves WHERE action = 'move' OR hash IS DISTINCT FROM from_hash",
    "d3": """SELECT o.action, o.path, o.from_path, o.file_id, CASE WHEN x.action = 'keep' AND o.hash IS NOT DISTINCT FROM o.from_hash THEN x.hash ELSE o.hash END AS hash, o.from_hash, o.size,
        (t.path IS NOT NULL AND o.hash IS DISTINCT FROM t.hash) OR coalesce(x.action = 'delete' OR (x.action = 'keep' AND o.hash IS DISTINCT FROM o.from_hash), FALSE) AS conflict,
        t.path IS NOT NULL AND o.hash IS NOT DISTINCT FROM t.hash AS same
        FROM ours o LEFT JOIN tchg t ON o.path = t.path LEFT JOIN tchg x ON o.action = 'move' AND o.from_path = x.path""",
    # Nodes: files and the directories above them, with modes.
    "fsource": "SELECT CASE WHEN file_id % 29 = 0 THEN path || '/inner.txt' ELSE path END AS path, CASE WHEN file_id % 29 = 0 THEN file_id + 1000000 ELSE file_id END AS file_id, hash, size FROM source",
    "nbase": f"SELECT path, 'file' AS kind, file_id, hash, size, 420 AS mode FROM base UNION ALL {above('base', '493')}",
    "nsource": f"SELECT path, 'file' AS kind, file_id, hash, size, 420 AS mode FROM fsource UNION ALL {above('fsource', 'CASE WHEN length(min(path)) % 5 = 0 THEN 448 ELSE 493 END')}",
    "ntarget": f"SELECT path, 'file' AS kind, file_id, hash, size, CASE WHEN file_id % 31 = 0 THEN 493 ELSE 420 END AS mode FROM target UNION ALL {above('target', '493')}",
    "nchg": changes("nbase", "nsource"),
    "ntchg": changes("nbase", "ntarget"),
    "npairs": """SELECT a.path AS path, d.path AS from_path FROM (SELECT * FROM nchg WHERE action = 'add' AND file_id <> 0) a
        JOIN (SELECT * FROM nchg WHERE action = 'delete' AND file_id <> 0) d ON a.file_id = d.file_id""",
    "nmoves": """SELECT 'move' AS action, c.path, m.from_path, c.kind, c.file_id, c.hash, d.from_hash, c.size, c.mode, d.from_mode FROM nchg c JOIN npairs m ON c.path = m.path AND c.action = 'add' JOIN nchg d ON d.path = m.from_path AND d.action = 'delete'
        UNION ALL SELECT * FROM nchg c WHERE NOT (c.action = 'add' AND c.path IN (SELECT path FROM npairs)) AND NOT (c.action = 'delete' AND c.file_id <> 0 AND c.path IN (SELECT from_path FROM npairs))""",
    "nours": "SELECT * FROM nmoves WHERE action = 'move' OR hash IS DISTINCT FROM from_hash",
    "ntheirs": "SELECT * FROM ntchg WHERE hash IS DISTINCT FROM from_hash",
    "n3equal": """SELECT o.*, CASE WHEN t.path IS NULL THEN NULL WHEN o.action = 'delete' AND t.action = 'delete' THEN FALSE WHEN o.kind <> t.kind THEN TRUE
        WHEN o.kind = 'dir' THEN FALSE ELSE o.hash IS DISTINCT FROM t.hash END AS clash FROM nours o LEFT JOIN ntheirs t ON o.path = t.path""",
    "n3": """SELECT action, path, from_path, kind, file_id, hash, from_hash, size, mode, from_mode, coalesce(clash, EXISTS (SELECT 1 FROM ntheirs t WHERE starts_with(o.path, t.path || '/')
          AND ((t.kind = 'dir' AND t.action = 'delete' AND o.kind = 'file' AND o.action <> 'delete') OR (t.kind = 'file' AND t.action <> 'delete' AND o.kind = 'dir')))) AS conflict
        FROM n3equal o WHERE clash IS DISTINCT FROM FALSE""",
    "rn": "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_custkey % 4 AS branch, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) AS n FROM orders",
    "rk": "SELECT *, n + 10 * branch AS number, sha256(CAST(o_orderkey AS VARCHAR)) AS revision FROM rn",
    "rev": """SELECT r.branch, r.number, r.revision,
        CASE WHEN r.branch > 0 AND r.n = 1 THEN t.revision ELSE b.revision END AS parent_self, m.revision AS parent_other
        FROM rk r LEFT JOIN rk b ON b.branch = r.branch AND b.n = r.n - 1
        LEFT JOIN rk t ON t.branch = 0 AND r.branch > 0 AND r.n = 1 AND t.n = 10 * r.branch
        LEFT JOIN rk m ON m.branch = 0 AND r.branch > 0 AND r.n % 25 = 0 AND m.n = r.n""",
    "tips": "SELECT branch, arg_max(revision, number) AS latest FROM rev GROUP BY branch",
    "dep": """SELECT DISTINCT source, target, tag FROM (SELECT l_partkey AS source, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS target, l_returnflag AS tag
        FROM lineitem) WHERE source <> target""",
    "frag": """SELECT doc_id, lang AS part, seq, sha256(substring(text, seq * 256 + 1, 256)) AS hash, CAST(length(substring(text, seq * 256 + 1, 256)) AS INTEGER) AS sz
        FROM (SELECT doc_id, lang, text, unnest(range(0, CAST(floor((length(text) - 1) / 256) AS BIGINT) + 1)) AS seq FROM documents WHERE length(text) > 0)""",
    "ev": """SELECT event_id, ts, user_id % 5 AS repository, CASE event_type WHEN 'signup' THEN 'BranchCreated' WHEN 'purchase' THEN 'BranchPushed' WHEN 'error' THEN 'BranchDeleted' WHEN 'click' THEN 'ResourceLocked' WHEN 'view' THEN 'ResourceUnlocked' END AS kind,
        user_id % 7 AS branch, event_id AS number, user_id AS owner, CAST(regexp_extract(props, '"k": (-?[0-9]+)', 1) AS BIGINT) % 20 AS resource FROM events""",
    "lk": """SELECT repository, branch, resource, owner, ts AS locked_at FROM (SELECT *, row_number() OVER (PARTITION BY repository, branch, resource ORDER BY event_id DESC) AS n FROM ev WHERE kind IN ('ResourceLocked', 'ResourceUnlocked'))
        WHERE n = 1 AND kind = 'ResourceLocked'""",
    "live": """SELECT repository, branch FROM ev GROUP BY repository, branch
        HAVING max(CASE WHEN kind IN ('BranchCreated', 'BranchPushed') THEN event_id END) > coalesce(max(CASE WHEN kind = 'BranchDeleted' THEN event_id END), -1)""",
}
NEEDS = {
    "base": ["p"], "source": ["p"], "target": ["p"], "dirs": ["source"], "nodes": ["source", "dirs"], "chg": ["base", "source"], "tchg": ["base", "target"],
    "pairs": ["chg"], "moves": ["chg", "pairs"], "ours": ["moves"], "d3": ["ours", "tchg"], "rk": ["rn"], "fsource": ["source"], "nbase": ["base"], "nsource": ["fsource"], "ntarget": ["target"], "nchg": ["nbase", "nsource"], "ntchg": ["nbase", "ntarget"],
    "npairs": ["nchg"], "nmoves": ["nchg", "npairs"], "nours": ["nmoves"], "ntheirs": ["ntchg"], "n3equal": ["nours", "ntheirs"], "n3": ["n3equal", "ntheirs"],
    "rev": ["rk"], "tips": ["rev"], "lk": ["ev"], "live": ["ev"],
}


def sql(names: str, body: str, recursive: str = "") -> str:
    """A query with the fixtures it needs before it, and a recursive table (its definition) after them."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body


#: Names of the three snapshots and of what is made of them, for a merge of other roles.
ROLES = ("base", "source", "target", "chg", "tchg", "pairs", "moves", "ours", "d3")


def roles(base: str, source: str, target: str, body: str) -> str:
    """A query on d3 and target with other snapshots in the parts of base, source and target."""
    import re

    part = {"base": base, "source": source, "target": target}
    other = {n: f"{n}_x" for n in ROLES}
    renamed = lambda text: re.sub(r"\b(" + "|".join(ROLES) + r")\b", lambda m: other[m[1]], text)
    made = [f"{n}_x AS (SELECT * FROM {part[n]})" for n in part] + [f"{n}_x AS ({renamed(CTES[n])})" for n in ROLES[3:]]
    return sql("base source target", ", " + ", ".join(made) + " " + body)
