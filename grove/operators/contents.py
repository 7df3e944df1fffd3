"""Whole contents in and out of the store: chunks above a size, lists of references, compression, ranges, checks on read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators import chunks
from grove.operators.store import LARGEST

REFS = "key string, seq long, start long, size long, hash string, packed boolean, payload binary"
#: Payloads of so many bytes or fewer, or that don't shrink under this share, are stored as they are; the level of compression.
SMALL, SHARE, LEVEL = 32, 0.95, 6


def put(rows: DataFrame, key: str, content: str, *, fixed: int | None = None, largest: int = LARGEST) -> DataFrame:
    """(key, seq, start, size, hash, packed, payload): contents (text or bytes) as they are stored, a row for each reference.

    One fragment up to `largest` bytes, content-defined chunks above (fixed: of that many bytes). hash is of the raw chunk, payload is compressed
    where that saves (packed). Null contents have no row, empty ones one. The fragments to add are fragments() of these; a worker holds one content at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for k, x in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                if not x.is_valid:
                    continue
                data = x.as_py()
                data = data.encode() if isinstance(data, str) else data
                ends = [len(data)] if len(data) <= largest else list(range(fixed, len(data), fixed)) + [len(data)] if fixed else chunks.cuts(data)
                out: dict[str, list] = {c: [] for c in ("start", "size", "hash", "packed", "payload")}
                for a, b in zip([0, *ends], ends, strict=False):
                    raw = data[a:b]
                    small = pack.compress(raw) if len(raw) > SMALL else raw
                    keep = len(small) < SHARE * len(raw)
                    for c, v in (("start", a), ("size", b - a), ("hash", hashlib.sha256(raw).hexdigest()), ("packed", keep), ("payload", small if keep else raw)):
                        out[c].append(v)
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["hash"]), pa.array(out["packed"]), pa.array(out["payload"], pa.binary())],
                    ["key", "seq", "start", "size", "hash", "packed", "payload"],
                )

    return rows.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInArrow(run, REFS)


def fragments(stored: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(hash, size, packed, payload): each distinct fragment once, but those that a store (hash) has."""
    rows = stored.select("hash", "size", "packed", "payload").dropDuplicates(["hash"])
    return rows if known is None else rows.join(known.select("hash"), "hash", "left_anti")


def references(stored: DataFrame) -> DataFrame:
    return stored.select("key", "seq", "start", "size", "hash")


def _open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        raw, valid = [], []
        for h, size, packed, payload in zip(*(batch.column(c).to_pylist() for c in ("hash", "size", "packed", "payload")), strict=True):
            try:
                data = unpack.decompress(payload, max_output_size=size) if packed else payload
            except zstandard.ZstdError:
                data = b""
            valid.append(len(data) == size and hashlib.sha256(data).hexdigest() == h)
            raw.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(raw, pa.binary()), pa.array(valid, pa.bool_())], ["key", "start", "raw", "valid"])


def parts(refs: DataFrame, payloads: DataFrame, begin: int = 0, end: int | None = None) -> DataFrame:
    """(key, start, raw, valid): what references of (key, seq, start, size, hash) hold of bytes [begin, end), a row for each chunk, read from
    payloads (hash, packed, payload). valid: size and digest of the whole chunk are right. Only chunks within the range are read."""
    near = refs.where(F.col("start") + F.col("size") > begin) if begin else refs
    near = near if end is None else near.where(F.col("start") < end)
    met = near.join(payloads.select("hash", "packed", "payload"), "hash").select("key", "start", "size", "hash", "packed", "payload")
    opened = met.mapInArrow(_open, "key string, start long, raw binary, valid boolean")
    low = F.greatest(F.lit(begin) - F.col("start"), F.lit(0))
    most = F.octet_length("raw") if end is None else F.least(F.octet_length("raw"), F.lit(end) - F.col("start"))
    return opened.select("key", (F.col("start") + low).alias("start"), F.substring("raw", (low + 1).cast("int"), F.greatest(most - low, F.lit(0)).cast("int")).alias("raw"), "valid")


def streamed(rows: DataFrame) -> DataFrame:
    """parts in order: those of a content lie in one partition, one after the other, so that a reader needs one chunk at a time."""
    return rows.repartition("key").sortWithinPartitions("key", "start")


def joined(rows: DataFrame) -> DataFrame:
    """(key, size, digest, valid) of contents, from their parts: read chunk by chunk, never whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, digest, valid, out = None, 0, hashlib.sha256(), True, []
        for batch in batches:
            for k, raw, ok in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "valid")), strict=True):
                if now != (k,):
                    if now is not None:
                        out.append((now[0], size, digest.hexdigest(), valid))
                    now, size, digest, valid = (k,), 0, hashlib.sha256(), True
                size, valid = size + len(raw), valid and ok
                digest.update(raw)
        if now is not None:
            out.append((now[0], size, digest.hexdigest(), valid))
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "size", "digest", "valid"])

    return streamed(rows).mapInArrow(run, "key string, size long, digest string, valid boolean")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """(key, bytes): each content written to folder/key, chunk by chunk. The folder is one that all executors mount; a file that a lost task began is begun anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        now, f, out = None, None, {}
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for k, raw in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if now != k:
                    if f:
                        f.close()
                    now, f = k, open(os.path.join(folder, os.path.basename(k)), "wb")
                f.write(raw)
                out[k] = out.get(k, 0) + len(raw)
        if f:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["key", "bytes"])

    return streamed(rows).mapInArrow(run, "key string, bytes long")


def scanned(spark, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime, hash, content): the files under a folder, as a tree's rows; path is relative to it.

    Columns that aren't asked for aren't read. Empty files aren't among them, as the reader passes them over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = folder.split("://")[-1].rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.substr(path, F.locate(root, path) + len(root)).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "content")
