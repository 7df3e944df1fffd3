"""The content-addressed store: matches, puts, reads, statistics, eviction, verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.session import checkpointed

#: Matches in order; fragments' largest size and the histogram's number of buckets.
NONE, HASH, PARTITION, FULL = 0, 1, 2, 3
LARGEST, BUCKETS = 262_144, 64


def match_level(asked: DataFrame, store: DataFrame) -> DataFrame:
    """asked (hash, part, doc_id) with its best match in the store: none, the hash, its partition too, its context too.

    The store is first reduced to three sets of keys, so that one with many copies of an address gives one row each.
    """
    asked = asked.select("hash", "part", "doc_id")
    full = store.select("hash", "part", "doc_id").distinct().withColumn("_f", F.lit(FULL))
    part = store.select("hash", "part").distinct().withColumn("_p", F.lit(PARTITION))
    any_ = store.select("hash").distinct().withColumn("_h", F.lit(HASH))
    met = asked.join(full, ["hash", "part", "doc_id"], "left").join(part, ["hash", "part"], "left").join(any_, "hash", "left")
    return met.select("hash", "part", "doc_id", F.coalesce("_f", "_p", "_h", F.lit(NONE)).alias("level"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that the store doesn't fully hold, each address once."""
    key = ["hash", "part", "doc_id"]
    return new.dropDuplicates(key).join(store.select(*key), key, "left_anti")


def new_hashes(new: DataFrame, *parents: DataFrame) -> DataFrame:
    """(hash) of new that none of the parents has."""
    out = new.select("hash").distinct()
    for p in parents:
        out = out.join(p.select("hash"), "hash", "left_anti")
    return out


def copy(store: DataFrame, part: str, to: str) -> DataFrame:
    """Rows that put a partition's content under another: what is there already isn't copied."""
    moved = store.where(F.col("part") == part).withColumn("part", F.lit(to))
    return put(store, moved)


def expand(lists: DataFrame, root: str, most: int = 16) -> DataFrame:
    """(hash, depth): all fragments below a list, from references (list_hash, hash), lists within lists too."""
    level = lists.where(F.col("list_hash") == root).select("hash", F.lit(1).alias("depth")).distinct()
    done, d = level, 1
    while d < most:
        d += 1
        level = lists.join(level.select(F.col("hash").alias("list_hash")), "list_hash", "left_semi").select("hash", F.lit(d).alias("depth")).distinct().join(done.select("hash"), "hash", "left_anti")
        level = checkpointed(level)
        if level.isEmpty():
            break
        done = checkpointed(done.unionByName(level))
    return done


def statistics(refs: DataFrame) -> DataFrame:
    """(refs, distinct_hashes, raw_bytes, distinct_bytes, dedup_refs, dedup_bytes) of references (hash, sz)."""
    by_hash = refs.groupBy("hash").agg(F.count("*").alias("n"), F.max("sz").cast("long").alias("sz"))
    return by_hash.agg(
        F.sum("n").alias("refs"), F.count("*").alias("distinct_hashes"), F.sum(F.col("n") * F.col("sz")).alias("raw_bytes"), F.sum("sz").alias("distinct_bytes"),
        F.sum(F.col("n") - 1).alias("dedup_refs"), F.sum((F.col("n") - 1) * F.col("sz")).alias("dedup_bytes"),
    )


def histogram(refs: DataFrame, largest: int = LARGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, fragments, bytes): distinct fragments by size, in equal steps up to the largest; that one counts in the last."""
    sizes = refs.groupBy("hash").agg(F.max("sz").alias("sz"))
    bucket = F.least(F.floor(F.col("sz") * buckets / largest), F.lit(buckets - 1)).cast("int")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("fragments"), F.sum("sz").alias("bytes"))


def valid_lists(refs: DataFrame, width: int) -> DataFrame:
    """(doc_id, valid): a list has two references or more, whose offsets, seq * width, rise strictly from 0."""
    before = F.lag("seq").over(Window.partitionBy("doc_id").orderBy("seq"))
    bad = (F.coalesce(before, F.lit(-1)) + 1 != F.col("seq")) | (F.col("seq") * width < 0)
    rows = refs.withColumn("_bad", bad)
    return rows.groupBy("doc_id").agg((~F.bool_or("_bad") & (F.count("*") >= 2)).alias("valid"))


def evictable(fragments: DataFrame, capacity: int, share: float = 0.7, protect: bool = True) -> DataFrame:
    """Rows of fragments (bucket, hash, last_access, durable) to evict, so that buckets go down to a share of their capacity.

    With protect rows that aren't durable stay and don't count. The cutoff is the time of the last row that must go, and all
    rows that count up to it go, so ties over-evict.
    """
    target = int(capacity * share)
    able = fragments.where("durable") if protect else fragments
    counted = able.withColumn("_n", F.count("*").over(Window.partitionBy("bucket"))).where(F.col("_n") > target)
    rank = F.rank().over(Window.partitionBy("bucket").orderBy("last_access"))
    return counted.withColumn("_r", rank).where(F.col("_r") <= F.col("_n") - target).drop("_n", "_r")


def compacted(fragments: DataFrame, payloads: DataFrame) -> DataFrame:
    """payloads (hash, payload) that some row of fragments (hash) still names, each once."""
    return payloads.join(fragments.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])


def collected_garbage(fragments: DataFrame, payloads: DataFrame, capacity: int, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(fragments, payloads) after compaction and eviction: payloads that nothing names go, then evicted rows and what only they named."""
    gone = evictable(fragments, capacity, share).select("bucket", "hash")
    left = fragments.join(gone, ["bucket", "hash"], "left_anti")
    return left, compacted(left, compacted(fragments, payloads))


def rebalanced(fragments: DataFrame, level: int) -> DataFrame:
    """fragments with their bucket at a fan-out level: the leading bits of the digest's first three bytes (levels up to 2^24)."""
    bits = level.bit_length() - 1
    return fragments.withColumn("bucket", F.shiftright(F.conv(F.substr("hash", F.lit(1), F.lit(6)), 16, 10).cast("long"), 24 - bits))


def made_durable(fragments: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """fragments flagged durable: those of hashes (hash), or all."""
    if hashes is None:
        return fragments.withColumn("durable", F.lit(True))
    named = hashes.select("hash").distinct().withColumn("_d", F.lit(True))
    return fragments.join(named, "hash", "left").withColumn("durable", F.col("durable") | F.coalesce("_d", F.lit(False))).drop("_d").select(*fragments.columns)


def status(lists: DataFrame, root: str, local: DataFrame, durable: DataFrame) -> DataFrame:
    """(hash, depth, status) of all fragments below a list: bit 1 if the local store has it, bit 2 if the durable one has (both: hash)."""
    here, there = local.select("hash", F.lit(1).alias("_l")).distinct(), durable.select("hash", F.lit(2).alias("_d")).distinct()
    met = expand(lists, root).join(here, "hash", "left").join(there, "hash", "left")
    return met.select("hash", "depth", (F.coalesce("_l", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias("status"))


def point(store: DataFrame, hash_: str, part: str | None = None, context: int | None = None) -> DataFrame:
    """A fragment's rows at a required match: of the hash, of its partition, of its context too. Each condition reaches the scan."""
    out = store.where(F.col("hash") == hash_)
    out = out if part is None else out.where(F.col("part") == part)
    return out if context is None else out.where(F.col("doc_id") == context)


#: Bits of a fragment's flags, those that say how it is stored and those that ask for a behaviour.
STORED_FLAGS, ASKED_FLAGS = 0x0000FFFF, 0xFFFF0000


def sanitised(fragments: DataFrame, flags: str = "flags") -> DataFrame:
    """fragments with flags split: those of storage stay, those that ask for a behaviour are in `asked`."""
    bits = F.col(flags).cast("long")
    return fragments.withColumn("asked", bits.bitwiseAND(F.lit(ASKED_FLAGS))).withColumn(flags, bits.bitwiseAND(F.lit(STORED_FLAGS)))


def reclaim(fragments: DataFrame, wanted: int) -> DataFrame:
    """Rows of fragments (bucket, hash, sz, last_access) to drop, the longest unused of each bucket, until a bucket has freed wanted bytes."""
    freed = F.sum("sz").over(Window.partitionBy("bucket").orderBy("last_access", "hash").rowsBetween(Window.unboundedPreceding, -1))
    return fragments.withColumn("_freed", F.coalesce(freed, F.lit(0))).where(F.col("_freed") < wanted).drop("_freed")


def fan_out(counts: DataFrame, level: int, threshold: int, ladder: tuple[int, ...] = (256, 1024, 4096, 16384, 65536)) -> DataFrame:
    """(largest, level): the least step of the ladder that brings the largest bucket (n) under the threshold."""
    need = F.ceil(F.col("largest") * level / threshold)
    step = F.lit(ladder[-1])
    for x in reversed(ladder[:-1]):
        step = F.when(need <= x, x).otherwise(step)
    return counts.agg(F.max("n").alias("largest")).select("largest", step.alias("level"))


def corrupt(payloads: DataFrame) -> DataFrame:
    """Rows of payloads (hash, payload, sz) whose digest or size isn't that of the payload."""
    return payloads.where((F.sha2("payload", 256) != F.col("hash")) | (F.length("payload") != F.col("sz")))


def obliterated(store: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the store without the payloads of the addresses (hash), counts (fragments, bytes) of what went)."""
    gone = addresses.select("hash").distinct()
    went = store.join(gone, "hash", "left_semi").agg(F.count("*").alias("fragments"), F.coalesce(F.sum("sz"), F.lit(0)).alias("bytes"))
    return store.join(gone, "hash", "left_anti"), went


def tiers(*stores: DataFrame) -> DataFrame:
    """Stores by address, the first that has it: (hash, payload, tier)."""
    rows = None
    for n, s in enumerate(stores):
        own = s.select("hash", "payload", F.lit(n).alias("tier"))
        rows = own if rows is None else rows.unionByName(own)
    best = F.row_number().over(Window.partitionBy("hash").orderBy("tier"))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def write(store: DataFrame, path: str) -> None:
    """The store as Parquet, one folder for each leading byte of the hash: a point read opens one."""
    store.withColumn("bucket", F.substr("hash", F.lit(1), F.lit(2))).repartition("bucket").sortWithinPartitions("hash").write.mode("append").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, hash_: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if hash_ is None else rows.where((F.col("bucket") == hash_[:2]) & (F.col("hash") == hash_))


def compressed(rows: DataFrame, key: str = "doc_id", payload: str = "text", level: int = 6) -> DataFrame:
    """(key, raw, stored, kept): zstd sizes; a payload of 32 bytes or fewer, or not under 95 % when compressed, stays as it is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            raw, stored, kept = [], [], []
            for x in batch.column(1).to_pylist():
                data = x.encode() if isinstance(x, str) else x or b""
                size = len(pack.compress(data)) if len(data) > 32 else len(data)
                keep = len(data) > 32 and size < 0.95 * len(data)
                raw.append(len(data))
                stored.append(size if keep else len(data))
                kept.append(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.int64()), pa.array(stored, pa.int64()), pa.array(kept, pa.bool_())], ["key", "raw", "stored", "kept"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), payload).mapInArrow(run, f"key {kind}, raw long, stored long, kept boolean").withColumnRenamed("key", key)
