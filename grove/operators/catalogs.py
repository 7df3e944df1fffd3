"""Repositories, working copies, links and layers as rows; the points where a caller adds its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.paths import under


def repositories(rows: DataFrame, creator: int | None = None) -> DataFrame:
    """Repositories (id, name, creator, deleted) that are there, of a creator or of all."""
    live = rows.where("not deleted")
    return live if creator is None else live.where(F.col("creator") == creator)


def with_repository(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with new repositories; a name that is taken isn't given again, of new rows of one name the smallest id has it."""
    first = new.groupBy("name").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "name")), "id").alias("r")).select("name", "r.*")
    return rows.unionByName(first.join(repositories(rows).select("name"), "name", "left_anti").select(*rows.columns))


def without_repository(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows with repositories (id) marked as deleted."""
    ids = gone.select("id", F.lit(True).alias("_g")).distinct()
    return rows.join(ids, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_g", F.lit(False))).select(*rows.columns)


def pruned(instances: DataFrame, paths: DataFrame) -> DataFrame:
    """Working copies (instance, repository, path) whose path is still there (path)."""
    return instances.join(paths.select("path").distinct(), "path", "left_semi").select(*instances.columns)


def relocated(instances: DataFrame, moves: DataFrame) -> DataFrame:
    """Working copies with new paths (instance, path)."""
    to = moves.select("instance", F.col("path").alias("_to"))
    return instances.join(to, "instance", "left").withColumn("path", F.coalesce("_to", "path")).select(*instances.columns)


def mount_added(mounts: DataFrame, new: DataFrame) -> DataFrame:
    """Links or layers (repository, mount, target, ...) with new ones in place of those at the same mount; one within another's mount is refused."""
    inside = new.alias("n").join(mounts.alias("m"), (F.col("n.repository") == F.col("m.repository")) & F.startswith(F.lower("n.mount"), F.concat(F.lower("m.mount"), F.lit("/")))).select("n.repository", "n.mount").distinct()
    able = new.join(inside, ["repository", "mount"], "left_anti")
    return mounts.join(able.select("repository", "mount"), ["repository", "mount"], "left_anti").select(*mounts.columns).unionByName(able.select(*mounts.columns))


def mount_removed(mounts: DataFrame, gone: DataFrame) -> DataFrame:
    return mounts.join(gone.select("repository", "mount"), ["repository", "mount"], "left_anti").select(*mounts.columns)


def layer_pins(layers: DataFrame, tips: DataFrame) -> DataFrame:
    """Layers (mount, branch, revision) brought to their branch's tip (branch, revision): (mount, branch, revision, previous)."""
    new = tips.select("branch", F.col("revision").alias("_r"))
    return layers.join(new, "branch", "left").select("mount", "branch", F.coalesce("_r", "revision").alias("revision"), F.col("revision").alias("previous"))


def of_mounts(changes: DataFrame, mounts: list[str]) -> DataFrame:
    """Changes under the mounts alone: what a commit of a link or layer takes."""
    keep = F.lit(False)
    for m in mounts:
        keep = keep | under("path", F.lit(m))
    return changes.where(keep)


class Hooks:
    """What callers hang on an engine's points: each a condition that vetoes rows, or a function of a DataFrame that is told of it.

    veto gives rows and reasons as columns, so that it is part of the plan; told functions run once a batch, after it.
    """

    POINTS = ("push", "lock", "branch", "commit", "obliterate")

    def __init__(self) -> None:
        self.vetoes: dict[str, list[tuple[Column, str]]] = {p: [] for p in self.POINTS}
        self.told: dict[str, list[Callable[[DataFrame], None]]] = {p: [] for p in self.POINTS}

    def veto(self, point: str, condition: Column, message: str) -> None:
        self.vetoes[point].append((condition, message))

    def tell(self, point: str, function: Callable[[DataFrame], None]) -> None:
        self.told[point].append(function)

    def judged(self, point: str, rows: DataFrame) -> DataFrame:
        """rows with `vetoed`: the message of the first condition that holds, null if none does."""
        out = F.lit(None).cast("string")
        for condition, message in reversed(self.vetoes[point]):
            out = F.when(F.coalesce(condition, F.lit(False)), F.lit(message)).otherwise(out)
        return rows.withColumn("vetoed", out)

    def passed(self, point: str, rows: DataFrame) -> DataFrame:
        """rows that no condition vetoes, after those told have been told."""
        kept = self.judged(point, rows).where("vetoed is null").drop("vetoed")
        for function in self.told[point]:
            function(kept)
        return kept


#: Backends by kind and name: functions from options to what reads or writes.
BACKENDS: dict[tuple[str, str], Callable] = {}


def backend(kind: str, name: str, factory: Callable | None = None) -> Callable:
    """Registers a factory of a kind (store, table, lock, notification) under a name, or gives the registered one."""
    if factory is not None:
        BACKENDS[kind, name] = factory
    return BACKENDS[kind, name]


def each_row(rows: DataFrame, callback: Callable[[dict], None]) -> int:
    """Calls back with each row in turn, a partition at a time on the driver; how many there were."""
    n = 0
    for row in rows.toLocalIterator():
        callback(row.asDict())
        n += 1
    return n


def sink(rows: DataFrame, make: Callable[[], Callable[[Iterable], Iterator]], schema: str) -> DataFrame:
    """rows through a producer that a factory makes once a partition: it takes Arrow batches and gives others, as a table function does."""

    def run(batches: Iterable) -> Iterator:
        yield from make()(batches)

    return rows.mapInArrow(run, schema)
