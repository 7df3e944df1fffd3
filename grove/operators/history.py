"""Revisions: walks along parents, ranges, pages, names of revisions, common ancestors.

Walks go by runs: revisions of a branch that follow each other, each the first parent of the next. A run is one row however long it is,
walks over runs double their step in each round, and only what they reach is made into revisions again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from grove.session import FEW, checkpointed, few, stored, stored_parts

#: Numbers of a branch that a run spans at most, so that no task holds all of a branch.
SPAN = 65536
#: Below every place in a run.
LOWEST = -(1 << 63)
#: Runs in SPAN numbers of a branch at most for which a revision's run is looked up by its number.
DENSE = 256
#: Parts in which large tables are joined by revision, one after the other.
PARTS = 2
#: Revisions of a walk that are looked up first.
NEAR = 65536


def key(revision: str) -> Column:
    """A revision's name in few bytes, one for each name: the bytes that an even number of lower-case hex digits stands for, else the text's."""
    raw = F.unhex(revision)
    plain = F.concat(F.lit(b"\0"), F.encode(revision, "utf-8"))
    return F.when(F.lower(F.hex(raw)) == F.col(revision), F.concat(F.lit(b"\1"), raw)).when(F.col(revision).isNotNull(), plain)


def named(key_: str) -> Column:
    """The name that key() was made of."""
    rest = F.substr(F.col(key_), F.lit(2))
    return F.when(F.substr(F.col(key_), F.lit(1), F.lit(1)) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "utf-8"))


class Runs(NamedTuple):
    """Revisions by runs.

    rows: (run, at, _key, branch, number, _up, more): revisions with the run that each is in and its place there; _up is the first parent of a run's first revision.
    hops: for 1, 2, 4 ... runs: (run, head, run_to, at_to, far): from a run's first revision, at head, the place in another that is `far` first parents on.
    lost: (run, head, _up): runs whose first revision has a parent that is no revision.
    """

    rows: DataFrame
    hops: list[DataFrame]
    lost: DataFrame


def located(rows: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """wanted with the place (run_to, at_to) of the revision whose key is in a column; without those that are none."""
    return rows.select(F.col("_key").alias(by), F.col("run").alias("run_to"), F.col("at").alias("at_to")).join(wanted, by)


def runs(revs: DataFrame, *more: Column) -> Runs:
    """more: columns that rows keep beside the branch and number.

    Where numbers of a branch are unique and runs are few, only the runs are written, with the numbers they begin at: rows are revs with the run that has
    a revision's number, made anew from revs at each use. Else rows are stored.
    """
    block = F.floor(F.col("number") / SPAN).alias("_block")
    rows = revs.select("branch", "number", block, key("revision").alias("_key"), key("parent_self").alias("_up"), *more)
    ranges = ranged(rows.select("branch", "number", "_block", "_key", "_up"))
    rows = placed(rows, ranges) if ranges is not None else numbered(rows)
    heads = rows.select("run", F.col("at").alias("head"), "_up") if ranges is None else ranges.select(by_low(), F.col("low").alias("head"), "_up")
    heads = few(heads.where("_up is not null"))
    table = checkpointed(located(rows, heads, "_up").select("run", "head", "run_to", "at_to", F.lit(1).cast("long").alias("far")))
    lost = checkpointed(heads.join(table.select("run"), "run", "left_anti"))
    hops = []
    while not table.isEmpty():
        hops.append(table)
        second = table.select(F.col("run").alias("run_to"), F.col("head").alias("_h"), F.col("run_to").alias("_r"), F.col("at_to").alias("_a"), F.col("far").alias("_f"))
        on = table.join(second, "run_to").select("run", "head", F.col("_r").alias("run_to"), F.col("_a").alias("at_to"), (F.col("far") + F.col("at_to") - F.col("_h") + F.col("_f")).alias("far"))
        table = checkpointed(on)
    return Runs(rows, hops, lost)


def by_low() -> Column:
    """A run that is known by the number it begins at."""
    return F.struct("branch", F.col("_block").alias("block"), F.col("low").alias("part")).alias("run")


def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revisions (branch, _block, number, _key, _up) as stretches (branch, _block, low, high, _up, _key): numbers of a block that follow each other within a
    batch, each the first parent of the next; _up is the first one's parent, _key the last one's key. A stretch has all numbers from low to high."""
    for batch in batches:
        rows = pa.table({name: batch.column(name) for name in batch.schema.names}).sort_by([("branch", "ascending"), ("number", "ascending")])
        n = rows.num_rows
        if not n:
            continue
        one, two = rows.slice(0, n - 1), rows.slice(1)
        alike = pc.or_(pc.fill_null(pc.equal(one["branch"], two["branch"]), False), pc.and_(one["branch"].is_null(), two["branch"].is_null()))
        for follows in (pc.equal(one["_block"], two["_block"]), pc.equal(pc.add(one["number"], 1), two["number"]), pc.equal(one["_key"], two["_up"])):
            alike = pc.and_(alike, pc.fill_null(follows, False))
        ends = pc.invert(alike).combine_chunks() if n > 1 else pa.array([], pa.bool_())
        first, last = rows.filter(pa.concat_arrays([pa.array([True]), ends])), rows.filter(pa.concat_arrays([ends, pa.array([True])]))
        out = pa.table({"branch": first["branch"], "_block": first["_block"], "low": first["number"], "high": last["number"], "_up": first["_up"], "_key": last["_key"]})
        yield from out.combine_chunks().to_batches()


def ranged(rows: DataFrame) -> DataFrame | None:
    """(branch, _block, low, next, _up): runs whose numbers follow each other, by their first number and that of the next in the block; none if a branch has
    a number twice or rows without one, or if runs are many.

    Only stretches are shuffled: far fewer than revisions where these come in the order of their numbers. Two stretches of a branch overlap only if it has a number twice.
    """
    order = Window.partitionBy("branch", "_block").orderBy("low", "high")
    rows = rows.select("branch", "_block", F.col("number").cast("long").alias("number"), "_key", "_up")
    kinds = rows.schema
    heads = rows.mapInArrow(stretches, StructType([kinds["branch"], kinds["_block"], *(StructField(c, LongType()) for c in ("low", "high")), kinds["_up"], kinds["_key"]]))
    before = F.lag("high").over(order)
    heads = heads.withColumn("_on", F.coalesce((F.lag("_key").over(order) == F.col("_up")) & (before + 1 == F.col("low")), F.lit(False)))
    heads = heads.withColumn("_odd", F.coalesce(before >= F.col("low"), F.lit(False)) | F.col("low").isNull())
    heads = checkpointed(heads.where("not _on").select("branch", "_block", "low", "_up", "_odd").limit(FEW + 1))
    if heads.count() > FEW or not heads.where("_odd").isEmpty() or not heads.groupBy("branch", "_block").count().where(F.col("count") > DENSE).isEmpty():
        return None
    return F.broadcast(checkpointed(heads.select("branch", "_block", "low", F.lead("low").over(Window.partitionBy("branch", "_block").orderBy("low")).alias("next"), "_up")))


def placed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with the run that has their number; a place in a run is the number."""
    r = ranges.select(F.col("branch").alias("_b"), F.col("_block").alias("_n"), "low", "next")
    within = F.col("branch").eqNullSafe(F.col("_b")) & (F.col("_block") == F.col("_n")) & (F.col("number") >= F.col("low")) & (F.col("next").isNull() | (F.col("number") < F.col("next")))
    kept = [c for c in rows.columns if c not in ("_block", "_key", "_up")]
    return rows.join(F.broadcast(r), within).select(by_low(), F.col("number").cast("long").alias("at"), "_key", F.when(F.col("number") == F.col("low"), F.col("_up")).alias("_up"), *kept)


def numbered(rows: DataFrame) -> DataFrame:
    """rows stored with the run that each is in and its place there, whatever their numbers are."""
    order = Window.partitionBy("branch", "_block").orderBy("number", "_key")
    rows = rows.withColumn("_first", ~F.coalesce(F.lag("_key").over(order) == F.col("_up"), F.lit(False))).withColumn("at", F.row_number().over(order).cast("long"))
    part = F.sum(F.col("_first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = F.struct("branch", F.col("_block").alias("block"), part.alias("part"))
    kept = [c for c in rows.columns if c not in ("_block", "_key", "_up", "_first", "at")]
    return stored(rows.select(run.alias("run"), "at", "_key", F.when(F.col("_first"), F.col("_up")).alias("_up"), *kept), "runs")


def met(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    """one and two joined by _key and stored: in PARTS by a hash of the key, each of which reads both anew, so that a part's shuffle alone is on disk at a time."""
    part = lambda df, i: df.where(F.pmod(F.xxhash64("_key"), F.lit(PARTS)) == i)
    return stored_parts([part(one, i).join(part(two, i), "_key") for i in range(PARTS)], name)


class Reach(NamedTuple):
    """What walks along first parents from starts go through.

    runs: (start, run, top, far): the runs, each from `top` down, which is `far` steps from the start.
    none: (start, _key, distance): where a walk meets what is no revision, as a parent or as its start.
    """

    runs: DataFrame
    none: DataFrame


def reached(table: Runs, starts: DataFrame, most: int | None = None) -> Reach:
    """The runs along first parents from each of starts (revision), those `most` steps away at most."""
    asked = few(starts.select(F.col("revision").alias("start"), key("revision").alias("_key")))
    reach = located(table.rows, asked, "_key").select("start", F.col("run_to").alias("run"), F.col("at_to").alias("top"), F.lit(0).cast("long").alias("far"))
    here = reach = checkpointed(reach)
    for hop in table.hops:
        further = reach.join(hop.withColumnRenamed("far", "_far"), "run").select("start", F.col("run_to").alias("run"), F.col("at_to").alias("top"), (F.col("far") + F.col("top") - F.col("head") + F.col("_far")).alias("far"))
        reach = checkpointed(reach.unionByName(further if most is None else further.where(F.col("far") <= most)))
    reach = few(reach)
    up = table.lost.join(reach, "run").select("start", F.col("_up").alias("_key"), (F.col("far") + F.col("top") - F.col("head") + 1).alias("distance"))
    none = asked.join(here.select("start"), "start", "left_anti").select("start", "_key", F.lit(0).cast("long").alias("distance"))
    none = up.unionByName(none)
    return Reach(reach, none if most is None else none.where(F.col("distance") <= most))


def walked(table: Runs, starts: DataFrame, most: int | None = None, whole: bool = False) -> DataFrame:
    """(start, _key, distance and what rows of table have): all revisions along first parents from each of starts (revision), itself at 0,
    `most` steps away at most. whole: with parents and starts that are no revisions, without branch and number."""
    return listed_from(table, reached(table, starts, most), most, whole)


def listed_from(table: Runs, reach: Reach, most: int | None = None, whole: bool = False) -> DataFrame:
    """The revisions of walked()."""
    rows = table.rows.join(reach.runs, "run").where("at <= top").withColumn("distance", F.col("far") + F.col("top") - F.col("at")).drop("run", "at", "_up", "top", "far")
    rows = rows if most is None else rows.where(F.col("distance") <= most)
    return rows.unionByName(reach.none, allowMissingColumns=True) if whole else rows


def first_parents(revs: DataFrame, starts: DataFrame, table: Runs | None = None, most: int | None = None) -> DataFrame:
    """(start, revision, distance): all revisions along first parents from each of starts (revision), itself at 0, `most` steps away at most.

    table: the runs of revs, where several walks share them.
    """
    return walked(table or runs(revs), starts, most, whole=True).select("start", named("_key").alias("revision"), "distance")


def history(revs: DataFrame, start: DataFrame, *, limit: int | None = 100, only_branch: bool = False, since: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(revision, number, branch, distance), newest first, along first parents from start (revision).

    only_branch: up to and with the first revision of another branch. since: (times (revision, num), epoch ms) up to
    before the first revision that is older. limit: so many at most.
    """
    table, most = runs(revs), None if limit is None else max(0, limit - 1)
    reach = reached(table, start, most)
    walk = listed_from(table, reach, most)
    if only_branch:
        # A run is of one branch, so where another comes in is known from the runs.
        entered = reach.runs.select("start", F.col("run.branch").alias("branch"), "far")
        own = entered.where("far = 0").select("start", F.col("branch").alias("own"))
        end = few(entered.join(own, "start").where("branch <> own").groupBy("start").agg(F.min("far").alias("end")))
        walk = walk.join(end, "start", "left").where("end is null or distance <= end")
    if since is not None:
        times, least = since
        older = first_of(table, reach, times.where(F.col("num") < least).select(key("revision").alias("_key")), most)
        walk = walk.join(older, "start", "left").where("old is null or distance < old")
    rows = walk.select("_key", "number", "branch", "distance").orderBy("distance").select(named("_key").alias("revision"), "number", "branch", "distance")
    return rows if limit is None else rows.limit(limit)


def first_of(table: Runs, reach: Reach, marked: DataFrame, most: int | None = None) -> DataFrame:
    """(start, old): the distance of the first revision of each walk that is marked (_key), those `most` steps away at most; no row where none is.

    The first NEAR revisions of a walk are sent to where marked is. Only of walks that have none there is the rest joined, in PARTS by a hash of the key.
    """
    least = lambda walk, some: walk.join(some, "_key").groupBy("start").agg(F.min("distance").alias("old"))
    near = few(listed_from(table, reach, NEAR - 1 if most is None else min(most, NEAR - 1)).select("start", "_key", "distance"))
    found = few(least(near, marked))
    on = few(near.where(F.col("distance") == NEAR - 1).select("start").distinct().join(found, "start", "left_anti"))
    if (most is not None and most < NEAR) or on.isEmpty():
        return found
    rest = listed_from(table, reach, most).where(F.col("distance") >= NEAR).join(on, "start", "left_semi").select("start", "_key", "distance")
    part = lambda df, i: df.where(F.pmod(F.xxhash64("_key"), F.lit(PARTS)) == i)
    for i in range(PARTS):
        found = found.unionByName(checkpointed(least(part(rest, i), part(marked, i))))
    return few(found.groupBy("start").agg(F.min("old").alias("old")))


def nth_ancestor(revs: DataFrame, start: DataFrame, n: int) -> DataFrame:
    return first_parents(revs, start, most=n).where(F.col("distance") == n).select("revision")


def covered(table: Runs, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((start, run, top), (start, _key)): how far into each run each start (start, _key) reaches over either parent, and the parents reached that are no revisions.

    rows of table have _other. A round goes along first parents from all that is new at once, then over the merges found there: as many rounds as merges nest.
    """
    merges = stored(table.rows.where("_other is not null").select("run", "at", "_other"), "merges")
    place = few(located(table.rows, few(merges.select("_other").distinct()), "_other"))
    known = checkpointed(merges.join(place, "_other").select("run", "at", "run_to", "at_to"))
    farthest = lambda df: df.groupBy("start", "run").agg(F.max("top").alias("top"))
    reached = lambda df: df.select("start", F.col("run_to").alias("run"), F.col("at_to").alias("top"))
    seen, over = None, checkpointed(farthest(reached(located(table.rows, few(starts), "_key"))))
    while True:
        for hop in table.hops:
            over = checkpointed(farthest(over.unionByName(reached(over.join(hop, "run")))))
        old = seen.withColumnRenamed("top", "old") if seen is not None else over.select("start", "run", F.col("top").alias("old")).limit(0)
        new = few(over.join(old, ["start", "run"], "left").withColumn("old", F.coalesce("old", F.lit(LOWEST))).where("top > old"))
        seen = new.drop("old") if seen is None else checkpointed(farthest(seen.unionByName(new.drop("old"))))
        over = farthest(reached(known.join(new, "run").where("at <= top and at > old")))
        over = checkpointed(over.join(seen.withColumnRenamed("top", "had"), ["start", "run"], "left").where("had is null or top > had").drop("had"))
        if over.isEmpty():
            up = seen.join(table.lost, "run").select("start", F.col("_up").alias("_key"))
            gone = merges.join(place.select("_other"), "_other", "left_anti").join(few(seen), "run").where("at <= top").select("start", F.col("_other").alias("_key"))
            return seen, up.unionByName(gone)


def ancestors(revs: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, revision): all revisions reachable over either parent, the start included.

    A start has a row for each revision it reaches, however many ways there are.
    """
    table = runs(revs, key("parent_other").alias("_other"))
    asked = checkpointed(starts.select(F.col("revision").alias("start"), key("revision").alias("_key")).distinct())
    reach, others = covered(table, asked)
    rows = table.rows.join(few(reach), "run").where("at <= top").select("start", "_key")
    # The start itself and parents that are no revisions have no place in a run.
    alone = others.unionByName(asked).distinct()
    alone = alone.join(table.rows.join(few(alone.select("_key").distinct()), "_key", "left_semi").select("_key"), "_key", "left_anti")
    return rows.unionByName(alone.select("start", "_key")).select("start", named("_key").alias("revision"))


def common_ancestors(revs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(revision, number) reachable from both."""
    table = runs(revs, key("parent_other").alias("_other"))
    asked = lambda x: checkpointed(x.select(key("revision").alias("_key"), F.col("revision").alias("start")).distinct())
    one, two = asked(a), asked(b)
    reach, _ = covered(table, one.unionByName(two).distinct())
    own = lambda x, n: reach.join(x.select("start"), "start", "left_semi").groupBy("run").agg(F.max("top").alias(n))
    both = few(own(one, "_one").join(own(two, "_two"), "run").select("run", F.least("_one", "_two").alias("top")))
    return table.rows.join(both, "run").where("at <= top").select(named("_key").alias("revision"), "number")


def merge_base(revs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(revision, number): the common ancestor with the highest number, of equals the one with the smallest hash."""
    return common_ancestors(revs, a, b).orderBy(F.desc("number"), "revision").limit(1)


def divergence(revs: DataFrame, a: DataFrame, b: DataFrame, *, most: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """(revision, ahead, behind): the nearest revision on both first-parent chains with its distance from each.

    most: so many revisions of each side are looked at; where none is on both, the base (revision) with distances 0.
    """
    steps = None if most is None else most - 1
    table = runs(revs)
    found = nearest(table, reached(table, a, steps), reached(table, b, steps), steps)
    if base is None:
        return found
    none = base.select("revision", F.lit(0).cast("long").alias("ahead"), F.lit(0).cast("long").alias("behind"))
    return found.withColumn("_o", F.lit(0)).unionByName(none.withColumn("_o", F.lit(1))).orderBy("_o").limit(1).drop("_o")


def nearest(table: Runs, one: Reach, two: Reach, most: int | None = None) -> DataFrame:
    """(revision, ahead, behind): the nearest revision that is on two walks, with its distance in each, `most` at most.

    In a run that both go through it is where the later of them comes in, so only runs are compared, and one revision is looked up.
    """
    there = two.runs.select("run", F.col("top").alias("_top"), F.col("far").alias("_far"))
    at = F.least("top", "_top")
    met = one.runs.join(there, "run").select("run", at.alias("at"), F.lit(None).cast("binary").alias("_none"), (F.col("far") + F.col("top") - at).alias("ahead"), (F.col("_far") + F.col("_top") - at).alias("behind"))
    none = one.none.select("_key", F.col("distance").alias("ahead")).join(two.none.select("_key", F.col("distance").alias("behind")), "_key")
    met = met.unionByName(none.select(F.col("_key").alias("_none"), "ahead", "behind"), allowMissingColumns=True)
    met = met if most is None else met.where((F.col("ahead") <= most) & (F.col("behind") <= most))
    best = few(met.orderBy("ahead", "behind").limit(1))
    rows = table.rows.select("run", "at", "_key").join(best, ["run", "at"]).select("_key", "ahead", "behind")
    rows = rows.unionByName(best.where("_none is not null").select(F.col("_none").alias("_key"), "ahead", "behind"))
    return checkpointed(rows.select(named("_key").alias("revision"), "ahead", "behind"))


def branch_point(revs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, revision, distance): the nearest revision on both chains (side `point`, distance 0), and those of each side before it."""
    table = runs(revs)
    one, two = reached(table, a), reached(table, b)
    point = F.broadcast(nearest(table, one, two).withColumnRenamed("revision", "point"))
    own = lambda reach, side, end: listed_from(table, reach, whole=True).join(point, F.col("distance") < F.col(end)).select(F.lit(side).alias("side"), named("_key").alias("revision"), "distance")
    return own(one, "a", "ahead").unionByName(own(two, "b", "behind")).unionByName(point.select(F.lit("point").alias("side"), F.col("point").alias("revision"), F.lit(0).cast("long").alias("distance")))


def bisect(revs: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """(revision, steps, done): the revision half-way back from bad to good along first parents; none if good is no ancestor."""
    walk = walked(runs(revs), bad, whole=True).select("_key", "distance")
    end = walk.join(few(good.select(key("revision").alias("_key"))), "_key", "left_semi").select(F.col("distance").alias("steps"))
    return walk.join(few(end.limit(1))).where(F.col("distance") == F.floor(F.col("steps") / 2)).select(named("_key").alias("revision"), "steps", (F.col("steps") <= 1).alias("done"))


def segments(revs: DataFrame, step: int = 100) -> DataFrame:
    """(branch, segment, first, last, revisions): runs of `step` numbers, with the boundary each is keyed by."""
    segment = (F.ceil(F.col("number") / step) * step).cast("long")
    return revs.groupBy("branch", segment.alias("segment")).agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("revisions"))


def by_number(revs: DataFrame, branch: int, number: int) -> DataFrame:
    return revs.where((F.col("branch") == branch) & (F.col("number") == number)).select("revision")


def by_prefix(revs: DataFrame, prefix: str, branch: int | None = None) -> DataFrame:
    """The revision whose hash starts with the digits (any case): on the branch first, the newest first."""
    rows = revs.where(F.startswith("revision", F.lit(prefix.lower())))
    return rows.orderBy(F.col("branch") != F.lit(branch) if branch is not None else F.lit(0), F.desc("number"), "revision").limit(1).select("revision")


def by_metadata(metadata: DataFrame, key: str, value: str) -> DataFrame:
    """Revisions whose string entry has the value."""
    return metadata.where((F.col("key") == key) & (F.col("type") == "string") & (F.col("str") == value)).select("revision")


def resolve(revs: DataFrame, branches: DataFrame, text: str, current: int = 0) -> DataFrame:
    """The revision (revision) that a text names; no rows if none.

    64 hex digits: that revision; `branch@N`, `branch@LATEST` or `@HEAD` in any case, `@N` on the current branch; fewer digits: a prefix;
    then `~` for the parent and `~n` for n steps back.
    """
    m = re.fullmatch(r"(.*?)((?:~\d*)*)", text)
    back = sum(int(x or 1) for x in re.findall(r"~(\d*)", m[2]))
    spec = m[1]
    if "@" in spec:
        name, _, at = spec.partition("@")
        own = branches.where(F.col("name") == name if name else F.col("id") == current)
        if at.upper() in ("LATEST", "HEAD"):
            found = own.select(F.col("latest").alias("revision"))
        elif at.isdigit():
            found = revs.join(own.select(F.col("id").alias("branch")), "branch", "left_semi").where(F.col("number") == int(at)).select("revision")
        else:
            found = revs.limit(0).select("revision")
    elif spec.upper() in ("LATEST", "HEAD"):
        found = branches.where(F.col("id") == current).select(F.col("latest").alias("revision"))
    elif re.fullmatch("[0-9a-fA-F]{64}", spec):
        found = revs.where(F.col("revision") == spec.lower()).select("revision")
    elif re.fullmatch("[0-9a-fA-F]{1,63}", spec):
        found = by_prefix(revs, spec, current)
    else:
        found = revs.limit(0).select("revision")
    return nth_ancestor(revs, found, back) if back else found


def next_number(revs: DataFrame) -> DataFrame:
    """(revision, number, expected): each number against the largest of its parents' and one."""
    n = revs.select(F.col("revision").alias("p"), F.col("number").alias("pn"))
    one, two = n.select(F.col("p").alias("p1"), F.col("pn").alias("n1")), n.select(F.col("p").alias("p2"), F.col("pn").alias("n2"))
    met = revs.join(one, revs["parent_self"] == one["p1"], "left").join(two, revs["parent_other"] == two["p2"], "left")
    return met.select("revision", "number", (F.greatest(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))) + 1).alias("expected"))


def file_history(revs: DataFrame, changed: DataFrame, start: DataFrame) -> DataFrame:
    """(file, revision, number, back): revisions along first parents from start that changed each file (revision, file), newest first."""
    walk = walked(runs(revs), start).select("_key", "number", "distance")
    rows = met(walk, changed.select(key("revision").alias("_key"), "file"), "changed")
    return rows.select("file", "_key", "number", F.row_number().over(Window.partitionBy("file").orderBy("distance")).alias("back")).select("file", named("_key").alias("revision"), "number", "back")


def last_modified(revs: DataFrame, changed: DataFrame, start: DataFrame) -> DataFrame:
    """(file, revision, number): the newest of those."""
    rows = met(walked(runs(revs), start).select("_key", "number"), changed.select(key("revision").alias("_key"), "file"), "changed")
    return rows.groupBy("file").agg(F.max_by("_key", "number").alias("_key"), F.max("number").alias("number")).select("file", named("_key").alias("revision"), "number")


def common_branch(branches: DataFrame, a: int, b: int) -> DataFrame:
    """(branch, a_revision, b_revision): the first branch in a's stack, itself first, that is in b's too."""

    def stack(i: int, n: str) -> DataFrame:
        own = F.array(F.struct(F.col("id").alias("branch"), F.col("latest").alias("revision")))
        return branches.where(F.col("id") == i).select(F.posexplode(F.concat(own, "stack")).alias(f"{n}_at", "s")).select(f"{n}_at", F.col("s.branch").alias("branch"), F.col("s.revision").alias(f"{n}_revision"))

    met = stack(a, "a").join(stack(b, "b"), "branch")
    return met.orderBy("a_at", "b_at").limit(1).select("branch", "a_revision", "b_revision")


def two_way(branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, two_way): whether a diff of two branches' tips (a, b) needs no base: one branch, none named on a side (null), or one tip is a point
    in the other's stack."""
    side = lambda n: branches.select(F.col("id").alias(n), F.col("latest").alias(f"l{n}"), F.transform("stack", lambda s: s["revision"]).alias(f"s{n}"))
    met = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    plain = (F.col("a") == F.col("b")) | F.col("a").isNull() | F.col("b").isNull()
    point = F.coalesce(F.array_contains("sb", F.col("la")), F.lit(False)) | F.coalesce(F.array_contains("sa", F.col("lb")), F.lit(False))
    return met.select("a", "b", (F.coalesce(plain, F.lit(False)) | point).alias("two_way"))


def page(revs: DataFrame, branch: int, *, at: int, step: int = 100, newer: bool = False) -> DataFrame:
    """(revision, number, parent_number, next): a page of a branch's revisions, newest first, `step` at most: those of the segment of number `at` up to it.

    Segments end at multiples of step. next is the number at which the page before (newer: after) begins, null at an end. With newer
    the page is the rest of the segment from `at` on.
    """
    floor = max(-(-at // step) * step - step, 0) + 1
    top = max(-(-at // step) * step, step)
    low, high = (at, top) if newer else (floor, at)
    own = revs.where(F.col("branch") == branch)
    rows = own.where(F.col("number").between(low, high))
    beyond = own.where(F.col("number") > top).agg(F.min("number").alias("next")) if newer else own.where(F.col("number") < floor).agg(F.max("number").alias("next"))
    parents = own.select(F.col("revision").alias("p"), F.col("number").alias("parent_number"))
    return rows.join(parents, rows["parent_self"] == parents["p"], "left").join(F.broadcast(beyond)).select("revision", "number", "parent_number", "next")


def listed(revs: DataFrame, start: DataFrame, end: DataFrame, *, limit: int = 100) -> DataFrame:
    """(revision, number, parent_number, other_number, has_more): revisions along first parents from start to before end (revision; none: to the root), newest first."""
    walk = first_parents(revs, start, most=limit).join(revs, "revision")
    stop = F.broadcast(walk.join(end.select("revision"), "revision", "left_semi").agg(F.min("distance").alias("stop")))
    numbers = revs.select(F.col("revision").alias("p"), F.col("number").alias("n"))
    one, two = numbers.select(F.col("p").alias("p1"), F.col("n").alias("parent_number")), numbers.select(F.col("p").alias("p2"), F.col("n").alias("other_number"))
    rows = walk.join(stop).where("stop is null or distance < stop")
    more = F.broadcast(rows.agg(F.coalesce(F.max("distance") >= limit, F.lit(False)).alias("has_more")))
    kept = rows.where(F.col("distance") < limit).join(more)
    return kept.join(one, kept["parent_self"] == one["p1"], "left").join(two, kept["parent_other"] == two["p2"], "left").select("revision", "number", "parent_number", "other_number", "has_more", "distance").orderBy("distance").drop("distance")


def segment_lists(revs: DataFrame, step: int = 100) -> DataFrame:
    """(branch, segment, revisions): each segment's revisions as a list, newest first: what a page cache holds. A list has `step` at most."""
    segment = (F.ceil(F.col("number") / step) * step).cast("long")
    entry = F.struct((-F.col("number")).alias("n"), F.col("revision"))
    return revs.groupBy("branch", segment.alias("segment")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["revision"]).alias("revisions"))


def latest_list(pointers: DataFrame, limit: int = 10) -> DataFrame:
    """(branch, revision, number, back): the last `limit` values of each branch's pointer (branch, revision, number), newest first."""
    return pointers.withColumn("back", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("number")))).where(F.col("back") <= limit).select("branch", "revision", "number", "back")


def newer(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(branch, revision, number, side): of a branch's local and remote pointers the one with the higher number, the local one of equals."""
    both = local.select("branch", "revision", "number", F.lit("local").alias("side")).unionByName(remote.select("branch", "revision", "number", F.lit("remote").alias("side")))
    best = both.groupBy("branch").agg(F.max_by(F.struct("revision", "number", "side"), F.struct("number", F.col("side") == "local")).alias("x"))
    return best.select("branch", "x.*")


def matched(revs: DataFrame, start: DataFrame, match: Column, *, abort: Column | None = None, limit: int | None = None) -> DataFrame:
    """(revision, number, distance): the first revision along first parents that match holds for, if no earlier one says abort; both are conditions on a revision's columns."""
    table = runs(revs, match.alias("_match"), (abort if abort is not None else F.lit(False)).alias("_abort"))
    walk = walked(table, start, None if limit is None else limit - 1)
    end = few(walk.where("_abort").agg(F.min("distance").alias("_end")))
    return walk.where("_match").join(end).where("_end is null or distance <= _end").orderBy("distance").limit(1).select(named("_key").alias("revision"), "number", "distance")


def file_chain(revs: DataFrame, deltas: DataFrame, start: DataFrame, paths: DataFrame) -> DataFrame:
    """(asked, path, revision, number, action, back): the revisions along first parents from start that changed a file, newest first, up to its add.

    deltas (revision, path, from_path, action) are what revisions changed; paths (path) are asked. A move goes on under the old path; a file
    that is gone at start has its delete as the newest. A round a name that a file once had.
    """
    changes = deltas.select(key("revision").alias("_key"), "path", "from_path", "action")
    walk = met(walked(runs(revs), start).select("_key", "number", "distance"), changes, "deltas")
    asked = paths.select(F.col("path").alias("asked"), "path", F.lit(-1).cast("long").alias("since")).distinct()
    done = None
    while True:
        own = walk.join(few(asked), "path").where(F.col("distance") > F.col("since"))
        ends = own.where("action in ('add', 'move')").groupBy("asked", "path").agg(F.min("distance").alias("end"))
        rows = checkpointed(own.join(ends, ["asked", "path"], "left").where("end is null or distance <= end").select("asked", "path", "from_path", "_key", "number", "action", "distance"))
        done = rows if done is None else checkpointed(done.unionByName(rows))
        asked = checkpointed(rows.where("action = 'move'").select("asked", F.col("from_path").alias("path"), F.col("distance").alias("since")))
        if asked.isEmpty():
            back = F.row_number().over(Window.partitionBy("asked").orderBy("distance"))
            return done.select("asked", "path", named("_key").alias("revision"), "number", "action", back.alias("back"))


def delta_of(deltas: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (revision, path) with what the revision did to the path: (revision, path, action), null where nothing."""
    return asked.select("revision", "path").join(deltas.select("revision", "path", "action"), ["revision", "path"], "left")


def last_merged_files(revs: DataFrame, deltas: DataFrame, tip: DataFrame, source: int) -> DataFrame:
    """(path, revision, number): the newest revision along first parents from tip that changed a file and merged a revision of the source branch; number is the merged one's."""
    table = runs(revs, key("parent_other").alias("_other"))
    merges = few(walked(table, tip).where("_other is not null").select("_key", "_other", "distance"))
    theirs = table.rows.where(F.col("branch") == source).select(F.col("_key").alias("_other"), F.col("number").alias("merged"))
    walk = few(theirs.join(merges, "_other").select("_key", "merged", "distance"))
    rows = deltas.select(key("revision").alias("_key"), "path").join(walk, "_key")
    best = rows.groupBy("path").agg(F.min_by("_key", "distance").alias("_key"), F.min_by("merged", "distance").alias("number"))
    return best.select("path", named("_key").alias("revision"), "number")
