"""Operators whose results SQL can't say, or on odd inputs."""

import datetime
import itertools
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grove.functions import paths as P
from grove.operators import catalogs, chunks, contents, diff, filters, graph, history, nodes, store, tables, texts, tree

TREE = "path string, file_id long, hash string, size int"


def test_clean(spark):
    given_ = {"a/./b//c": "a/b/c", "..\\x\\y/../z": "x/z", "": "", "../..": "", "/a/": "a"}
    rows = spark.createDataFrame([(k, v) for k, v in given_.items()], "p string, want string")
    assert all(r.got == r.want for r in rows.select("want", P.clean("p").alias("got")).collect())


def test_ancestors_and_names(spark):
    row = spark.createDataFrame([("a/b/c",)], "p string").select(P.ancestors("p").alias("a"), P.name("p").alias("n"), P.parent("p").alias("d"), P.ancestors(F.lit("x")).alias("none")).first()
    assert (row.a, row.n, row.d, row.none) == (["a", "a/b"], "c", "a/b", [])


def test_branch_names(spark):
    names = {"main": True, "": False, "a" * 1000: True, "é" * 501: False, "0" * 32: True, "1" * 32: False}
    rows = spark.createDataFrame(list(names.items()), "n string, want boolean").select("want", P.branch_name_ok("n").alias("got")).collect()
    assert all(r.want == r.got for r in rows)


@pytest.mark.parametrize(
    ("rules", "path", "out"),
    [
        (["*.tmp"], "a/B/x.TMP", True), (["/a"], "a/x", True), (["a/*"], "a/b/c", True), (["a/*"], "b/a/c", False), (["**/x/y"], "q/x/y/z", True), (["a/**", "!a/b"], "a/b/c", False),
        (["a/**", "!a/b"], "a/c", True), (["[!a]*.txt"], "b1.txt", True), (["[!a]*.txt"], "a1.txt", False), (["?x"], "ax", True), ([], "a", False), (["# c", ""], "a", False), ([], "a/.grove/b", True), (["d/"], "d/x", True), (["d/"], "d", False),
    ],
)
def test_rules(spark, rules, path, out):
    assert spark.createDataFrame([(path,)], "path string").select(filters.excluded("path", filters.parse(rules)).alias("x")).first().x is out


def test_inclusions_may_not_start_anywhere():
    with pytest.raises(ValueError):
        filters.parse(["!**/a"])


def test_moves_pair_in_order_and_only_with_ids(spark):
    before = spark.createDataFrame([("a", 1, "h", 1), ("b", 1, "h", 1), ("z", 0, "h", 1), ("n", None, "h", 1)], TREE)
    after = spark.createDataFrame([("c", 1, "h", 1), ("d", 1, "g", 1), ("e", 1, "h", 1), ("y", 0, "h", 1)], TREE)
    rows = diff.with_moves(diff.diff2(before, after)).collect()
    assert sorted((r.action, r.path, r.from_path or "") for r in rows) == [("add", "e", ""), ("add", "y", ""), ("delete", "n", ""), ("delete", "z", ""), ("move", "c", "a"), ("move", "d", "b")]
    again = diff.apply(before, diff.with_moves(diff.diff2(before, after)))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)


def test_conflicts(spark):
    base = spark.createDataFrame([("same", 1, "o", 1), ("both", 2, "o", 1), ("gone", 3, "o", 1), ("edit", 4, "o", 1), ("m1", 5, "o", 1), ("m2", 6, "o", 1), ("m3", 7, "o", 1)], TREE)
    source = spark.createDataFrame([("same", 1, "n", 1), ("both", 2, "a", 1), ("edit", 4, "a", 1), ("t1", 5, "o", 1), ("t2", 6, "o", 1), ("t3", 7, "a", 1)], TREE)
    target = spark.createDataFrame([("same", 1, "n", 1), ("both", 2, "b", 1), ("m1", 5, "x", 1), ("m3", 7, "x", 1)], TREE)
    rows = {r.path: (r.action, r.conflict, r.hash) for r in diff.diff3(base, source, target).collect()}
    assert rows == {"both": ("keep", True, "a"), "edit": ("keep", True, "a"), "t1": ("move", False, "x"), "t2": ("move", True, "o"), "t3": ("move", True, "a")}


def test_cycles(spark):
    deps = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 1, "b"), (3, 4, "a"), (5, 3, "a")], "source long, target long, tag string")
    assert sorted(r.node for r in graph.on_cycles(deps).collect()) == [1, 2, 3]
    assert graph.makes_cycle(deps, 4, 5) and not graph.makes_cycle(deps, 5, 4) and graph.makes_cycle(deps, 9, 9)


def test_resolve_finds_nothing(spark):
    revs = spark.createDataFrame([(0, 1, "a" * 64, None, None)], "branch long, number long, revision string, parent_self string, parent_other string")
    branches = spark.createDataFrame([(0, "main", "a" * 64)], "id long, name string, latest string")
    for spec, n in [("main@1", 1), ("main@2", 0), ("aa", 1), ("AA~", 0), ("", 0), ("x y", 0), ("@HEAD", 1), ("latest", 1), ("a" * 64, 1), ("b" * 64, 0)]:
        assert history.resolve(revs, branches, spec).count() == n, spec


def test_swaps(spark):
    rows = [("k", 1, None, 5), ("k", 2, 4, 6), ("k", 3, 5, 6), ("k", 4, 6, None), ("k", 5, 9, 7), ("j", 1, 3, 3)]
    found = sorted(map(tuple, tables.swaps(spark.createDataFrame(rows, "key string, seq long, expected long, value long")).collect()))
    assert found == [("j", 1, True, None), ("k", 1, True, None), ("k", 2, False, 5), ("k", 3, True, 5), ("k", 4, True, 6), ("k", 5, True, None)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_chunks_cover(data):
    ends = chunks.cuts(data, 64, 256, 1024)
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(s <= 1024 for s in sizes) and all(s > 64 for s in sizes[:-1])


def test_chunks_find_their_place_again():
    import random

    data = random.Random(1).randbytes(200_000)
    parts = lambda x: {x[i:j] for i, j in itertools.pairwise([0, *chunks.cuts(x, 512, 2048, 8192)])}
    a, b = parts(data), parts(b"inserted" + data)
    assert len(a & b) > 0.9 * len(a)


@pytest.mark.parametrize(("old", "new"), [("a\nb\nc\n", "a\nB\nc\n"), ("", "x\n"), ("x\n", ""), ("a\nb", "a\nb\n"), ("1\n2\n3\n4\n5\n6\n7\n8\n9\n", "1\n2\n3\n4\n5\n6\n7\n8\nnine\n")])
def test_unified_patches_apply(tmp_path, old, new):
    (tmp_path / "f").write_text(old)
    (tmp_path / "p").write_text(texts.unified(old, new).replace("original", "f").replace("modified", "f"))
    done = subprocess.run(["git", "apply", "--unidiff-zero", "p"], cwd=tmp_path, capture_output=True, text=True, timeout=20)
    assert done.returncode == 0, done.stderr
    assert ((tmp_path / "f").read_text() if (tmp_path / "f").exists() else "") == new


def test_unified_spaces():
    assert texts.unified("a  b\n", "a b\n", spaces="collapse") == "" and texts.unified("a b\n", "ab\n", spaces="ignore") == "" and texts.unified("a\n", "a\n") == ""


def test_merge3():
    assert texts.merge3("a\nb\nc\n", "A\nb\nc\n", "a\nb\nC\n") == ("A\nb\nC\n", 0)
    assert texts.merge3("a\n", "a\n", "a\nb\n") == ("a\nb\n", 0)
    text, n = texts.merge3("a\n", "b\n", "c\n")
    assert n == 1 and "<<<<<<< ours\nb\n" in text
    assert texts.merge3("a\n", "b\n", "b\n") == ("b\n", 0)


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("ab" + "0" * 62, "x"), ("cd" + "0" * 62, "y")], "hash string, payload string")
    store.write(rows, f"{tmp_path}/s")
    one = store.read(spark, f"{tmp_path}/s", "ab" + "0" * 62)
    assert [r.payload for r in one.collect()] == ["x"]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_links_within_links(spark):
    links = spark.createDataFrame([(1, "l", 2), (2, "m", 3), (3, "n", 1)], "repository long, mount string, target long")
    files = spark.createDataFrame([(2, "x"), (3, "y")], "repository long, path string")
    found = {r.path for r in tree.mounted(links, files, 3).where("repository = 1").collect()}
    assert {"l/x", "l/m/y"} <= found


def test_empty_trees(spark):
    none = spark.createDataFrame([], TREE)
    assert diff.collected(none, none).collect() == [] and tree.dir_hashes(none).collect() == [] and tree.dir_sizes(none).collect() == []
    assert diff.diff3(none, none, none).collect() == [] and filters.minimal(none).collect() == []


def test_swaps_keep_values_as_they_are(spark):
    """Values beyond 2^53 and texts; a null key keeps its state."""
    big = 2**53 + 1
    rows = [(None, 1, None, big), (None, 2, big - 1, 5), (None, 3, big, 7), (None, 4, 7, None), (None, 5, 9, 9)]
    found = sorted(map(tuple, tables.swaps(spark.createDataFrame(rows, "key long, seq long, expected long, value long")).collect()), key=lambda r: r[1])
    assert found == [(None, 1, True, None), (None, 2, False, big), (None, 3, True, big), (None, 4, True, 7), (None, 5, True, None)]
    texts_ = spark.createDataFrame([(1, 1, None, "ab"), (1, 2, "ab", "cd"), (1, 3, "ab", "ef")], "key long, seq long, expected string, value string")
    assert [tuple(r) for r in tables.swaps(texts_).orderBy("seq").collect()] == [(1, 1, True, None), (1, 2, True, "ab"), (1, 3, False, "cd")]
    assert tables.swaps(texts_.limit(0)).collect() == []


def test_pushes(spark):
    schema = "branch long, seq long, parent string, revision string, protected boolean, service boolean"
    rows = [(1, 1, None, "a", False, False), (1, 2, "a", "b", False, False), (1, 3, "a", "c", False, False), (1, 4, "b", "b", False, False), (1, 5, "b", "d", True, False), (1, 6, "b", "d", True, True), (2, 1, "x", "y", False, False)]
    found = [tuple(r) for r in tables.pushed(spark.createDataFrame(rows, schema)).orderBy("branch", "seq").collect()]
    assert found == [(1, 1, "accepted", "a", 1), (1, 2, "accepted", "b", 2), (1, 3, "behind", "b", 2), (1, 4, "noop", "b", 2), (1, 5, "denied", "b", 2), (1, 6, "accepted", "d", 3), (2, 1, "missing", None, 0)]


def test_protected_rows_neither_count_nor_go(spark):
    rows = [(1, f"p{i}", i, False) for i in range(50)] + [(1, f"d{i}", i, True) for i in range(9)] + [(2, f"e{i}", i // 2, True) for i in range(8)]
    frame = spark.createDataFrame(rows, "bucket long, hash string, last_access long, durable boolean")
    names = lambda df: sorted(r.hash for r in df.collect())
    assert names(store.evictable(frame, 10)) == ["d0", "d1", "e0", "e1"]  # 9 and 8 rows over 7: two go, and of ties both
    assert len(names(store.evictable(frame, 10, protect=False))) >= 52
    assert names(store.evictable(frame, 100)) == []
    assert {r.hash for r in store.made_durable(frame, frame.where("hash = 'p3'")).where("durable and hash like 'p%'").collect()} == {"p3"}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(34)} | {(40, 40), (41, 42), (42, 41)}
    reach = {a: {b for x, b in edges if x == a} for a in range(50)}
    for _ in range(50):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    found = graph.on_cycles(spark.createDataFrame([(a, b, "t") for a, b in edges], "source long, target long, tag string")).collect()
    assert sorted(r.node for r in found) == sorted(a for a, r in reach.items() if a in r)


def dag(seed):
    import random

    rng = random.Random(seed)
    rows = [(0, 1, "r0", None, None)]
    for i in range(1, 40):
        rows.append((i % 3, i + 1, f"r{i}", f"r{rng.randrange(max(0, i - 4), i)}", f"r{rng.randrange(i)}" if rng.random() < 0.3 else None))
    return rows


REVISION = "branch long, number long, revision string, parent_self string, parent_other string"


@pytest.mark.parametrize("seed", range(2))
def test_ancestors_against_brute_force(spark, seed):
    rows = dag(seed)
    parents = {r[2]: [p for p in r[3:] if p] for r in rows}

    def up(x):
        return {x}.union(*(up(p) for p in parents[x]))

    revs = spark.createDataFrame(rows, REVISION)
    tips = revs.where("revision in ('r39', 'r30', 'r5')").select("revision")
    found = {}
    for r in history.ancestors(revs, tips).collect():
        found.setdefault(r.start, []).append(r.revision)
    assert {k: sorted(v) for k, v in found.items()} == {t: sorted(up(t)) for t in ("r39", "r30", "r5")}
    both = up("r39") & up("r30")
    best = max(both, key=lambda x: int(x[1:]))
    assert history.merge_base(revs, revs.where("revision = 'r39'"), revs.where("revision = 'r30'")).first().revision == best
    chain, at = [], "r39"
    while at:
        chain.append(at)
        at = next(r[3] for r in rows if r[2] == at)
    assert [r.revision for r in history.history(revs, revs.where("revision = 'r39'"), limit=4).collect()] == chain[:4]
    assert [r.revision for r in history.history(revs, revs.where("revision = 'r39'"), limit=None).collect()] == chain


def test_a_files_chain_over_moves_and_a_delete(spark):
    revs = spark.createDataFrame([(0, i, f"r{i}", f"r{i - 1}" if i > 1 else None, None) for i in range(1, 10)], REVISION)
    deltas = spark.createDataFrame([("r1", "a", None, "add"), ("r2", "a", None, "delete"), ("r3", "a", None, "add"), ("r4", "a", None, "keep"), ("r5", "b", "a", "move"), ("r6", "x", None, "add"), ("r7", "b", None, "keep"), ("r8", "c", "b", "move"), ("r9", "c", None, "delete")], "revision string, path string, from_path string, action string")
    found = history.file_chain(revs, deltas, revs.where("number = 9"), spark.createDataFrame([("c",), ("x",), ("none",)], "path string"))
    rows = [(r.asked, r.revision, r.path, r.action) for r in found.orderBy("asked", "back").collect()]
    assert rows == [("c", "r9", "c", "delete"), ("c", "r8", "c", "move"), ("c", "r7", "b", "keep"), ("c", "r5", "b", "move"), ("c", "r4", "a", "keep"), ("c", "r3", "a", "add"), ("x", "r6", "x", "add")]


def test_pages_at_the_ends(spark):
    revs = spark.createDataFrame([(0, i, f"r{i}", f"r{i - 1}" if i > 1 else None, None) for i in range(1, 26)], REVISION)
    page = lambda **how: [(r.number, r.parent_number, r.next) for r in history.page(revs, 0, step=10, **how).orderBy("number").collect()]
    assert page(at=12) == [(11, 10, 10), (12, 11, 10)]
    assert page(at=3)[0] == (1, None, None)
    assert page(at=25, newer=True) == [(25, 24, None)] and page(at=9, newer=True)[-1] == (10, 9, 11)
    tip = revs.where("number = 25")
    assert [r.has_more for r in history.listed(revs, tip, revs.limit(0), limit=30).limit(1).collect()] == [False]
    assert history.listed(revs, tip, revs.where("number = 20"), limit=3).count() == 3


NODE = "path string, kind string, file_id long, hash string, size int, mode int"


def node(path, kind="file", i=0, h="h", mode=420):
    return (path, kind, i, "dir" if kind == "dir" else h, 1, 493 if kind == "dir" and mode == 420 else mode)


def test_kinds_modes_and_directories(spark):
    before = [node("d", "dir"), node("d/a", i=1), node("k", i=2), node("m", "dir"), node("gone", "dir"), node("gone/x", i=3), node("f", i=4)]
    after = [node("d", "dir"), node("d/a", i=1), node("k", "dir"), node("k/in", i=9), node("M", "dir"), node("f", i=4, mode=493), node("new/x", i=3), node("new", "dir")]
    rows = nodes.collected(spark.createDataFrame(before, NODE), spark.createDataFrame(after, NODE)).collect()
    assert sorted((r.action, r.kind, r.path, r.from_path or "") for r in rows) == [
        ("add", "dir", "k", ""), ("add", "dir", "new", ""), ("add", "file", "k/in", ""), ("delete", "dir", "gone", ""), ("delete", "file", "k", ""), ("keep", "file", "f", ""), ("move", "dir", "M", "m"), ("move", "file", "new/x", "gone/x"),
    ]


def test_conflicts_of_kinds(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), NODE)
    base = frame(node("d", "dir"), node("d/a", i=1), node("p", i=2), node("e", "dir"), node("e/b", i=5))
    source = frame(node("d", "dir"), node("d/a", i=1), node("d/new", i=8), node("p", "dir"), node("p/x", i=7))
    target = frame(node("p", i=2, h="other"), node("e", "dir"), node("e/b", i=5, h="changed"))
    rows = nodes.diff3(base, source, target)
    found = {(r.action, r.kind, r.path): r.conflict for r in rows.collect()}
    assert found == {
        ("add", "file", "d/new"): True,  # the target deleted the directory
        ("delete", "file", "p"): True, ("add", "dir", "p"): True,  # a file here, a directory there
        ("add", "file", "p/x"): False, ("delete", "dir", "e"): False, ("delete", "file", "e/b"): True,
    }
    left = {(r.action, r.path) for r in nodes.without_covered(rows).collect()}
    assert ("delete", "e") not in left and len(left) == 5


def test_settled_by_history(spark):
    changes = spark.createDataFrame([("add", "a", "n", None, True), ("keep", "b", "n", "o", True), ("keep", "c", "n", "o", True), ("keep", "d", "n", "o", False)], "action string, path string, hash string, from_hash string, conflict boolean")
    at = lambda **x: spark.createDataFrame([(k, v) for k, v in x.items()], "path string, number long")
    target = spark.createDataFrame([("a", "t")], "path string, hash string")
    rows = nodes.history_pass(changes, at(a=9, b=3, c=9), at(a=2, b=9, c=9), at(a=1, b=3), at(a=2, c=8), target).collect()
    assert sorted(map(tuple, rows)) == [("keep", "a", "n", "t", False), ("keep", "c", "n", "o", True), ("keep", "d", "n", "o", False)]


def test_contents(spark, tmp_path):
    import hashlib
    import random

    rng = random.Random(5)
    large = rng.randbytes(900_000)
    data = {"large": large, "again": large[:600_000] + b"!" + large[600_000:], "small": b"x" * 100_000, "empty": b"", "none": None}
    frame = spark.createDataFrame(list(data.items()), "name string, content binary")
    rows = contents.put(frame, "name", "content").cache()
    refs, kept = contents.references(rows), contents.fragments(rows).cache()
    many = {k: n for k, n in refs.groupBy("key").count().collect()}
    assert many["small"] == many["empty"] == 1 and many["large"] > 5 and "none" not in many
    assert kept.count() < refs.count()  # chunks in common are kept once
    got = {r.key: (r.size, r.digest, r.valid) for r in contents.joined(contents.parts(refs, kept)).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest(), True) for k, v in data.items() if v is not None}
    some = contents.parts(refs.where("key = 'large'"), kept, 200_001, 500_003)
    assert b"".join(r.raw for r in some.orderBy("start").collect()) == large[200_001:500_003]
    assert some.count() < many["large"]
    spoilt = kept.withColumn("payload", F.when(F.col("size") == 100_000, F.unhex(F.lit("00FF"))).otherwise(F.col("payload")))
    assert {r.key for r in contents.parts(refs, spoilt).where("not valid").collect()} == {"small"}
    written = contents.write_files(contents.parts(refs, kept), f"{tmp_path}/out")
    assert {r.key: r.bytes for r in written.collect()} == {k: len(v) for k, v in data.items() if v is not None}
    files = {r.path: (r.size, r.hash) for r in contents.scanned(spark, f"{tmp_path}/out").collect()}
    assert files == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items() if v}
    assert contents.put(frame.limit(0), "name", "content").collect() == []
    assert [r["size"] for r in contents.put(frame.where("name = 'large'"), "name", "content", fixed=400_000).orderBy("seq").collect()] == [400_000, 400_000, 100_000]


def test_cuts_against_a_loop():
    """The same boundaries from a sum that is rolled on a byte at a time."""
    import random

    data = random.Random(8).randbytes(40_000) + b"z" * 9_000 + random.Random(9).randbytes(5_000)
    least, average, largest = 512, 2048, 8192
    gear, bits, mask = [int(x) for x in chunks.GEAR], 11, 2**64 - 1
    out, at, n = [], 0, len(data)
    sums, window = [], 32
    for i in range(n):
        sums.append(sum(gear[data[i - k]] << k for k in range(min(window, i + 1))) & mask)
    while n - at > least:
        end = min(at + largest, n)
        for i in range(at + least, end + 1):
            zero = bits + 1 if i <= min(at + average, n) else bits - 1
            if sums[i - 1] >> (64 - zero) == 0:
                end = i
                break
        out.append(end)
        at = end
    assert chunks.cuts(data, least, average, largest) == (out if at == n else [*out, n])


def test_hooks_backends_and_sinks(spark):
    hooks, told = catalogs.Hooks(), []
    hooks.veto("push", F.col("branch") == 1, "protected")
    hooks.tell("push", lambda rows: told.append(rows.count()))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "branch long, revision string")
    assert sorted(r.revision for r in hooks.passed("push", rows).collect()) == ["b", "c"] and told == [2]
    with pytest.raises(KeyError):
        hooks.veto("nowhere", F.lit(True), "")
    catalogs.backend("store", "memory", dict)
    assert catalogs.backend("store", "memory")() == {}
    seen = []
    assert catalogs.each_row(rows.orderBy("revision"), seen.append) == 3 and seen[0] == {"branch": 1, "revision": "a"}
    doubled = catalogs.sink(rows, lambda: lambda batches: (b for batch in batches for b in (batch, batch)), "branch long, revision string")
    assert doubled.count() == 6


def test_filter_files_and_sidecars(spark, tmp_path):
    (tmp_path / "rules").write_text("# none of these\r\n*.tmp\n!keep/a.tmp\n")
    rules = filters.load(spark, f"{tmp_path}/rules")
    rows = spark.createDataFrame([("x.tmp",), ("keep/a.tmp",), ("x.txt",), ("x.txt.mine",), ("mine",)], "path string")
    assert sorted(r.path for r in rows.where(~filters.excluded("path", rules)).collect()) == ["keep/a.tmp", "mine", "x.txt"]
    allowed = spark.createDataFrame([(1,), (1,)], "repository long")
    assert filters.readable(spark.createDataFrame([(1, "a"), (2, "b")], "repository long, path string"), allowed).count() == 1
    assert [r.mount for r in filters.viewed_links(spark.createDataFrame([("a/b",), ("c",)], "mount string"), filters.parse(["a/*"])).collect()] == ["c"]


def test_texts_by_their_marks(spark):
    rows = spark.createDataFrame([(b"\xff\xfea\x00", "a"), (b"\xfe\xff\x00a", "a"), (b"\xef\xbb\xbfa", "a"), (b"a", "a"), (b"\xc3\x28", None), (b"", ""), (None, None)], "raw binary, want string")
    assert all(r.want == r.got for r in rows.select("want", P.decoded("raw").alias("got")).collect())


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace as Box

    from grove.session import shared_dir

    box = lambda master, folder: Box(sparkContext=Box(master=master), conf=Box(get=lambda k, d: folder, set=lambda k, v: None))
    assert shared_dir(box("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    with pytest.raises(ValueError):
        shared_dir(box("spark://x", None))


def test_late_rows_are_dropped(spark, tmp_path):
    """A row that comes hours behind the watermark takes no part in its window."""
    from grove.streaming import events as E

    early, late = "2024-01-01 10:10:00", "2024-01-01 20:00:00"
    row = lambda i, ts: (i, datetime.datetime.fromisoformat(ts), 1, "click", 1.0, '{"k": 3}')
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for n, batch in enumerate(([row(1, early), row(2, late)], [row(3, early)], [row(4, "2024-01-02 09:00:00")])):
        E.published(spark.createDataFrame(batch, schema), f"{tmp_path}/in")
        out = E.drained(E.windowed(E.source(spark, f"{tmp_path}/in")), "append", f"file://{tmp_path}/out")
    assert sorted((str(r.start), r.n) for r in out.collect()) == [("2024-01-01 10:00:00", 1), ("2024-01-01 20:00:00", 1)]
