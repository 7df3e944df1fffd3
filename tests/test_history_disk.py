"""Walks along parents: what they write, and their results on odd histories against plain loops."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from grove import session
from grove.operators import history
from grove.plans.catalog import QUERIES
from grove.sources import fixtures

SF = "/root/testdata/sf0.01"
REVISION = "branch long, number long, revision string, parent_self string, parent_other string"


def written(spark) -> int:
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


@pytest.mark.parametrize("name", ["history_linear", "last_modified", "layer_match", "bisect_midpoint", "branch_point_sides", "common_ancestors", "file_chain", "last_merged_files", "merge_base", "divergence_distance", "file_history", "history_only_branch", "history_since", "revision_matched"])
def test_a_walk_writes_each_revision_about_once(spark, name):
    """A table of pairs for each power of two had over 100 bytes a revision and power."""
    before, many = written(spark), QUERIES["revision_rows"](spark, SF).count()
    assert QUERIES[name](spark, SF).count() > 0
    assert written(spark) - before < 300 * many


def odd(seed: int) -> list:
    """Revisions of four branches with numbers that repeat, parents anywhere before them or nowhere, and names that are hex, half hex and not hex."""
    r, rows = random.Random(seed), []
    names = [f"{i:02x}" * 3 if i % 3 == 0 else f"r{i}" if i % 3 == 1 else f"A{i:02x}" for i in range(90)]
    last = {}
    for i, name in enumerate(names):
        branch = r.choice([0, 1, 2, None])
        up = last.get(branch) if r.random() < 0.7 else r.choice([*names[:i], "lost", None])
        rows.append((branch, i // 2, name, up, r.choice([*names[:i], "gone"]) if r.random() < 0.2 else None))
        last[branch] = name
    return rows


@pytest.mark.parametrize("span", [3, 65536])
@pytest.mark.parametrize("seed", range(2))
def test_walks_against_loops(spark, monkeypatch, seed, span):
    monkeypatch.setattr(history, "SPAN", span)
    rows = odd(seed)
    parents = {x[2]: x[3] for x in rows}
    both = {x[2]: [p for p in x[3:] if p] for x in rows}
    starts = [rows[-1][2], rows[-2][2], rows[40][2], "absent"]
    revs, asked = spark.createDataFrame(rows, REVISION), spark.createDataFrame([(x,) for x in starts], "revision string")
    chain, reach = set(), set()
    for s in starts:
        at, d, todo = s, 0, [s]
        while at is not None:
            chain.add((s, at, d))
            at, d = parents.get(at), d + 1
        while todo:
            if (s, x := todo.pop()) not in reach:
                reach.add((s, x))
                todo += both.get(x, [])
    assert sorted(map(tuple, history.first_parents(revs, asked).collect())) == sorted(chain)
    assert sorted(map(tuple, history.first_parents(revs, asked, most=5).collect())) == sorted(x for x in chain if x[2] <= 5)
    assert sorted(map(tuple, history.ancestors(revs, asked).collect())) == sorted(reach)


def numbered(seed: int) -> list:
    """Revisions of four branches with unique numbers, with gaps between some, and parents that are mostly the one before."""
    r, rows, last, at = random.Random(seed), [], {}, {}
    for i in range(90):
        branch, name, before = r.choice([0, 1, 2, None]), f"{i:02x}" * 3, [x[2] for x in rows]
        at[branch] = at.get(branch, -3) + (1 if r.random() < 0.8 else r.randrange(2, 5))
        up = last.get(branch) if r.random() < 0.8 else r.choice([*before, "lost", None])
        rows.append((branch, at[branch], name, up, r.choice([*before, "gone"]) if r.random() < 0.2 else None))
        last[branch] = name
    return rows


@pytest.mark.parametrize("span", [3, 65536])
def test_walks_by_ranges_of_numbers_against_loops(spark, monkeypatch, span):
    """Where numbers are unique, runs are found by number and no revision is stored."""
    monkeypatch.setitem(globals(), "odd", numbered)
    monkeypatch.setattr(history, "numbered", None)
    test_walks_against_loops(spark, monkeypatch, 7, span)


@pytest.mark.parametrize("name", ["last_modified", "layer_match", "file_chain", "bisect_midpoint", "merge_base", "file_history", "history_since", "common_ancestors", "divergence_distance", "history_only_branch"])
def test_a_walk_stores_no_table_of_revisions(spark, name):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {*folder.glob("runs-*")}
    assert QUERIES[name](spark, SF).count() > 0
    assert {*folder.glob("runs-*")} == before


def shuffled(spark) -> int:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle" in found.apply(i).getName() for i in range(found.length()))


@pytest.mark.parametrize("write", [lambda df: session.stored(df, "t"), session.checkpointed])
def test_what_is_written_leaves_no_shuffle(spark, write):
    """Shuffle files stayed until the driver's garbage was collected."""
    before = shuffled(spark)
    out = write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if (left := shuffled(spark)) <= before:
            break
        time.sleep(0.1)
    assert left <= before
    assert out.count() == 7


def test_parts_of_a_join_are_the_join(spark):
    one = spark.range(100).select(F.encode(F.col("id").cast("string"), "utf-8").alias("_key"), "id")
    two = one.where("id % 3 = 0").select("_key", F.lit(1).alias("x")).unionByName(spark.createDataFrame([(None, 2)], "_key binary, x int"))
    assert sorted(x.id for x in history.met(one, two, "t").collect()) == [*range(0, 100, 3)]


def shuffled_bytes(spark) -> int:
    """Of all stages so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.length()))


def chains(spark):
    """Two branches of 20,000 revisions in the order of their numbers, the second from the first's revision 10,000 on, with a merge from it at every 1000th."""
    name = lambda i: F.sha2(i.cast("string"), 256)
    i, n = F.col("id"), F.col("id") % 20000
    up = F.when(i == 20000, name(F.lit(10000))).when(i > 0, name(i - 1))
    other = F.when((i > 20000) & (n % 1000 == 0), name(n))
    return spark.range(0, 40000, 1, 4).select((i / 20000).cast("long").alias("branch"), n.alias("number"), name(i).alias("revision"), up.alias("parent_self"), other.alias("parent_other"))


def of_chains(spark, name: str):
    revs = chains(spark)
    at = lambda b, n: history.by_number(revs, b, n)
    times = revs.select("revision", (F.col("number") - F.col("branch") + 1).alias("num"))
    return {
        "revision_matched": lambda: history.matched(revs, at(1, 19999), F.col("parent_other").isNotNull()),
        "branch_point_sides": lambda: history.branch_point(revs, at(0, 19999), at(1, 19999)).groupBy("side").count(),
        "divergence_distance": lambda: history.divergence(revs, at(0, 19999), at(1, 19999)),
        "common_ancestors": lambda: history.common_ancestors(revs, at(0, 19999), at(1, 19999)),
        "last_merged_files": lambda: history.last_merged_files(revs, revs.select("revision", F.lit("f").alias("path")), at(1, 19999), 0),
        "history_only_branch": lambda: history.history(revs, at(1, 19999), only_branch=True),
        "history_since": lambda: history.history(revs, at(1, 19999), since=(times, 2)),
    }[name]()


@pytest.mark.parametrize("name, rows", [("revision_matched", 1), ("branch_point_sides", 3), ("divergence_distance", 1), ("common_ancestors", 19001), ("last_merged_files", 1), ("history_only_branch", 100), ("history_since", 100)])
def test_a_walk_shuffles_no_names_of_all_revisions(spark, name, rows):
    """To find its runs it had the names of each revision and its parent in a shuffle; 66 bytes that hardly compress."""
    before = shuffled_bytes(spark)
    assert of_chains(spark, name).count() == rows
    assert shuffled_bytes(spark) - before < 20 * 40000


@pytest.mark.parametrize("at", range(6))
def test_stretches_of_any_batches_make_the_same_runs(spark, at):
    """Dealt over batches in any order, with a number that is there twice, one that is null, a branch that is null, and branches by name."""
    rows = [(b, i, f"{b}{i:03x}", None if i == 0 or i % 40 == 0 else f"{b}{i - 1:03x}") for b in ("a", "b", None) for i in range(100) if i != 55]
    rows += [("a", 7, "twice", "a006")] if at == 4 else [("a", None, "none", None)] if at == 5 else []
    if at:
        random.Random(at).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", (10_000, 10_000, 7, 1, 7, 7)[at])
    try:
        df = spark.createDataFrame(rows, "branch string, number long, revision string, parent_self string").repartition(3) if at % 2 else spark.createDataFrame(rows, "branch string, number long, revision string, parent_self string")
        table = history.ranged(df.select("branch", "number", F.floor(F.col("number") / history.SPAN).alias("_block"), history.key("revision").alias("_key"), history.key("parent_self").alias("_up")))
        if at > 3:
            assert table is None
        else:
            assert sorted((x.branch or "", x.low, x.next) for x in table.collect()) == [(b, *x) for b in ("", "a", "b") for x in ((0, 40), (40, 56), (56, 80), (80, None))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_where_chains_meet_in_what_is_no_revision(spark):
    rows = [(0, i, f"{i:04x}", f"{i - 1:04x}" if i else "lost", None) for i in range(30)] + [(1, i, f"1{i:03x}", f"1{i - 1:03x}" if i > 11 else "000a", None) for i in range(11, 40)]
    revs = spark.createDataFrame([*rows, (2, 5, "2005", "lost", None), (2, 6, "2006", "2005", None)], REVISION)
    for a, b, found in (("001d", "1027", ("000a", 19, 29)), ("2006", "0002", ("lost", 2, 3)), ("zz", "zz", ("zz", 0, 0)), ("0005", "0005", ("0005", 0, 0))):
        assert [tuple(x) for x in history.divergence(revs, *(spark.createDataFrame([(x,)], "revision string") for x in (a, b))).collect()] == [found]


def bytes_of(spark, df) -> int:
    """What a query shuffles, its making included."""
    before = shuffled_bytes(spark)
    df().write.format("noop").mode("overwrite").save()
    return shuffled_bytes(spark) - before


def test_common_ancestors_shuffles_keys_once(spark):
    """Orders were shuffled three times by branch, and names of all that point at the trunk: 11.5 bytes a revision to list them, 74 in this query."""
    many = QUERIES["revision_rows"](spark, SF).count()
    assert bytes_of(spark, lambda: QUERIES["revision_rows"](spark, SF)) < 9 * many
    assert bytes_of(spark, lambda: QUERIES["common_ancestors"](spark, SF)) < 55 * many


def test_divergence_distance_finds_tips_without_revisions(spark):
    """All revisions were made and shuffled to find the last of each branch: 172,330 bytes here."""
    assert bytes_of(spark, lambda: fixtures.branches(spark, SF)) < 5000
    rows = fixtures.revisions(spark, SF)
    tips = {x.branch: x.latest for x in rows.groupBy("branch").agg(F.max_by("revision", "number").alias("latest")).collect()}
    points = {x.number // 10: x.revision for x in rows.where("branch = 0 and number in (10, 20, 30)").collect()}
    found = fixtures.branches(spark, SF).collect()
    assert {x.id: x.latest for x in found} == tips and len(found) == len(tips)
    assert {x.id: [tuple(y) for y in x.stack] for x in found} == {b: [(0, points[b])] if b else [] for b in tips}
    assert bytes_of(spark, lambda: QUERIES["divergence_distance"](spark, SF)) < 50 * 15000


def records_read(spark) -> int:
    """By all stages so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).inputRecords() for i in range(stages.length()))


def test_history_only_branch_reads_no_revisions_to_find_its_end(spark, tmp_path):
    """Before its result it read all revisions five times, two of them for the first revision of another branch, which the runs have."""
    chains(spark).write.parquet(str(tmp_path / "revs"))
    revs = spark.read.parquet(str(tmp_path / "revs"))
    start = spark.createDataFrame(history.by_number(revs, 1, 19999).collect(), "revision string")
    before = records_read(spark)
    rows = history.history(revs, start, limit=None, only_branch=True)
    assert records_read(spark) - before < 4 * 40000
    assert rows.count() == 20001


def test_history_since_shuffles_no_names_of_what_is_older(spark):
    """Names of the walk and of all that is older met in a shuffle."""
    revs = chains(spark)
    times = revs.select("revision", (F.col("number") - F.col("branch") + 1).alias("num"))
    start = spark.createDataFrame(history.by_number(revs, 1, 19999).collect(), "revision string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert bytes_of(spark, lambda: history.history(revs, start, limit=None, since=(times, 19900))) < 10 * 40000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("near", [1, 4, 65536])
def test_first_of_a_walk_against_loops(spark, monkeypatch, near):
    """The first marked revision is near for some walks, far for others, and nowhere."""
    monkeypatch.setattr(history, "NEAR", near)
    rows = [(b, i, f"{b}{i:03x}", f"{b}{i - 1:03x}" if i else None, None) for b in range(4) for i in range(40)]
    marked = {"0026", "0003", "1005", "1004", "2027"}
    starts = ["0027", "1027", "2027", "3027", "100a", "absent"]
    revs, asked = spark.createDataFrame(rows, REVISION), spark.createDataFrame([(x,) for x in starts], "revision string")
    table, some = history.runs(revs), spark.createDataFrame([(x,) for x in marked], "revision string").select(history.key("revision").alias("_key"))
    for most in (None, 3, 20):
        expected = set()
        for s in starts[:-1]:
            b, n = int(s[0]), int(s[1:], 16)
            hits = [n - i for i in range(n + 1) if f"{b}{i:03x}" in marked and (most is None or n - i <= most)]
            expected |= {(s, min(hits))} if hits else set()
        found = history.first_of(table, history.reached(table, asked, most), some, most).collect()
        assert len(found) == len(expected) and {tuple(x) for x in found} == expected


def test_last_merged_files_shuffles_keys_once(spark):
    """It had 59 bytes a revision."""
    assert bytes_of(spark, lambda: QUERIES["last_merged_files"](spark, SF)) < 50 * 15000
