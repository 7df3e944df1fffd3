"""Mutable tables: keys and values, locks, metadata, branches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions.paths import glob_regex


def latest(writes: DataFrame, key: tuple[str, ...], order: str, value: str) -> DataFrame:
    """(key, value): the last value written; a null last value deletes the key. Aggregated, not sorted: no list by key."""
    last = writes.groupBy(*key).agg(F.max_by(F.struct(value), order).alias("v"))
    return last.select(*key, F.col(f"v.{value}").alias(value)).where(F.col(value).isNotNull())


def upsert(table: DataFrame, new: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """The table with new rows in place of those of equal keys; null values delete."""
    rest = table.join(new.select(*key), list(key), "left_anti")
    return rest.select(*key, value).unionByName(new.where(F.col(value).isNotNull()).select(*key, value))


def swaps(requests: DataFrame, key: str = "key") -> DataFrame:
    """(key, seq, swapped, previous) of compare-and-swap requests (key, seq, expected, value), in order of seq within a key.

    A swap takes place where the current value is the expected one or the key is missing; a null value deletes the key. Values are of any
    type that can be compared, and stay as they are; a null key is a key. Requests of one key depend on each other, so a key is one
    task's, streamed in order with one value kept.
    """
    kinds = dict(requests.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for rows in batches:
            done, previous = [], []
            for k, expected, value in zip(*(rows.column(c).to_pylist() for c in ("key", "expected", "value")), strict=True):
                if at != (k,):
                    at, now = (k,), None
                ok = now is None or now == expected
                previous.append(now)
                done.append(ok)
                now = value if ok else now
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("seq"), pa.array(done, pa.bool_()), pa.array(previous, rows.schema.field("value").type)], ["key", "seq", "swapped", "previous"])

    rows = requests.select(F.col(key).alias("key"), F.col("seq").cast("long").alias("seq"), F.col("expected").cast(kinds["value"]).alias("expected"), "value").repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInArrow(run, f"key {kinds[key]}, seq long, swapped boolean, previous {kinds['value']}").withColumnRenamed("key", key)


def lock_state(events: DataFrame) -> DataFrame:
    """(repository, branch, resource, owner, locked_at): resources whose last event (by event_id) locked them."""
    last = events.where(F.col("kind").isin("ResourceLocked", "ResourceUnlocked")).groupBy("repository", "branch", "resource").agg(F.max_by(F.struct("kind", "owner", "ts"), "event_id").alias("e"))
    return last.where("e.kind = 'ResourceLocked'").select("repository", "branch", "resource", F.col("e.owner").alias("owner"), F.col("e.ts").alias("locked_at"))


def query_locks(locks: DataFrame, *, branch: int | None = None, owner: int | None = None, resources: list[int] | None = None, repository: int | None = None, like: str | None = None) -> DataFrame:
    """Locks that all given conditions hold for; like: a glob of the resource's description. None: all."""
    out = locks
    for column, value in (("repository", repository), ("branch", branch), ("owner", owner)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if like is not None:
        out = out.where(F.lower("description").rlike(glob_regex(like)))
    return out.where(F.col("resource").isin(*resources)) if resources is not None else out


def acquire(locks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicts) for requests (request, repository, branch, resource, owner): a request gets all of its resources or none.

    A resource that its owner holds already is passed over; one held by another fails the request. Of requests for one free
    resource the smallest is served.
    """
    key = ["repository", "branch", "resource"]
    held = locks.select(*key, F.col("owner").alias("holder"))
    first = wanted.groupBy(*key).agg(F.min("request").alias("first"))
    met = wanted.join(held, key, "left").join(first, key)
    clash = (F.col("holder") != F.col("owner")) | (F.col("holder").isNull() & (F.col("first") != F.col("request")))
    judged = met.withColumn("clash", F.coalesce(clash, F.lit(False)))
    failed = judged.where("clash").select("request").distinct()
    return judged.join(failed, "request", "left_anti").where("holder is null").select("request", *key, "owner"), judged.where("clash").select("request", *key, "owner", "holder")


def release(locks: DataFrame, gone: DataFrame) -> DataFrame:
    """Locks without those released (repository, branch, resource, owner) by their owner."""
    return locks.join(gone, ["repository", "branch", "resource", "owner"], "left_anti")


def typed(metadata: DataFrame) -> DataFrame:
    """(revision, entries by key as text): metadata pivoted to a map, each value shown by its type."""
    shown = F.when(F.col("type") == "numeric", F.col("num").cast("string")).otherwise(F.col("str"))
    return metadata.groupBy("revision").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", shown.alias("value"))))).alias("entries"))


def set_metadata(metadata: DataFrame, new: DataFrame, read_only: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """metadata with new entries in place of those of the same revision and key; read-only keys stay as they are."""
    able = new.where(~F.col("key").isin(*read_only))
    return metadata.join(able.select("revision", "key"), ["revision", "key"], "left_anti").unionByName(able)


def merge_metadata(own: DataFrame, source: DataFrame) -> DataFrame:
    """Entries of the source over one's own."""
    return own.join(source.select("revision", "key"), ["revision", "key"], "left_anti").unionByName(source)


def live_branches(events: DataFrame) -> DataFrame:
    """(repository, branch): branches whose last creation or push is newer than their last deletion."""
    at = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("event_id")))
    rows = events.groupBy("repository", "branch").agg(at("BranchCreated", "BranchPushed").alias("made"), at("BranchDeleted").alias("gone"))
    return rows.where("made is not null and (gone is null or made > gone)").select("repository", "branch")


def archived_branches(events: DataFrame) -> DataFrame:
    """Branches once created or pushed that aren't live."""
    known = events.where(F.col("kind").isin("BranchCreated", "BranchPushed")).select("repository", "branch").distinct()
    return known.join(live_branches(events), ["repository", "branch"], "left_anti")


def pushed(pushes: DataFrame) -> DataFrame:
    """(branch, seq, result, head, number) of pushes (branch, seq, parent, revision, number, protected, service), in order of seq within a branch.

    A push is a `noop` where the branch has the revision, `denied` where the branch is protected and it isn't a service account's,
    `missing` where the branch isn't there and the push has a parent, `accepted` where its parent is the head and else `behind`. head is the branch's revision after it,
    number its number: one more than that of the head before, whatever the pushed one says. A branch is one task's, streamed in order.
    """
    names = ["branch", "seq", "parent", "revision", "protected", "service"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, number = None, None, 0
        for rows in batches:
            out: list[tuple] = []
            for branch, seq, parent, revision, protected, service in zip(*(rows.column(c).to_pylist() for c in names), strict=True):
                if at != (branch,):
                    at, head, number = (branch,), None, 0
                if protected and not service:
                    result = "denied"
                elif head == revision:
                    result = "noop"
                elif head is None and parent is not None:
                    result = "missing"
                elif head == parent:
                    result, head, number = "accepted", revision, number + 1
                else:
                    result = "behind"
                out.append((result, head, number))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([rows.column("branch"), rows.column("seq"), *columns], ["branch", "seq", "result", "head", "number"])

    rows = pushes.select("branch", F.col("seq").cast("long").alias("seq"), *names[2:]).repartition("branch").sortWithinPartitions("branch", "seq")
    return rows.mapInArrow(run, f"branch {dict(pushes.dtypes)['branch']}, seq long, result string, head string, number long")


#: Types of metadata values, as they are shown.
SHOWN = {"numeric": "num", "bool": "flag", "string": "str", "hash": "str", "context": "str", "address": "str", "binary": "raw"}


def shown(metadata: DataFrame) -> DataFrame:
    """(revision, key, type, value): each entry's value as text by its type: numbers and truth values as they are, digests in lower case, bytes in hex."""
    value = F.when(F.col("type") == "numeric", F.col("num").cast("string")).when(F.col("type") == "bool", F.col("flag").cast("string")).when(F.col("type") == "binary", F.lower(F.hex("raw")))
    value = value.when(F.col("type").isin("hash", "context", "address"), F.lower("str")).otherwise(F.col("str"))
    return metadata.select("revision", "key", "type", value.alias("value"))
