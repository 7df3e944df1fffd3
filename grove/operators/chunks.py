"""Content-defined chunks: boundaries where a rolling sum of the last bytes says so."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least, average and largest chunk in bytes.
LEAST, AVERAGE, LARGEST = 32_768, 65_536, 262_144


def gear() -> np.ndarray:
    """A number for each byte: splitmix64 of its value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = gear()


def rolling(data: bytes, window: int = 32) -> np.ndarray:
    """The sum over the last `window` bytes of their numbers, each shifted by its age: what a byte adds leaves after 64 steps at most."""
    g = GEAR[np.frombuffer(data, np.uint8)]
    out, width = g.copy(), 1
    while width < window:
        older = np.zeros_like(out)
        older[width:] = out[:-width]
        out += older << np.uint64(width)
        width *= 2
    return out


def cuts(data: bytes, least: int = LEAST, average: int = AVERAGE, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks. Up to the average a boundary is rarer, beyond it likelier, so sizes gather about it."""
    if not data:
        return []
    bits = int(np.log2(average))
    top = lambda n: np.uint64(((1 << n) - 1) << (64 - n))
    sums = rolling(data)
    strict, loose = np.flatnonzero(sums & top(bits + 1) == 0) + 1, np.flatnonzero(sums & top(bits - 1) == 0) + 1
    out, at, n = [], 0, len(data)
    while n - at > least:
        middle, end = min(at + average, n), min(at + largest, n)
        i = np.searchsorted(strict, at + least)
        j = np.searchsorted(loose, middle)
        if i < len(strict) and strict[i] <= middle:
            at = int(strict[i])
        elif j < len(loose) and loose[j] <= end:
            at = int(loose[j])
        else:
            at = end
        out.append(at)
    return out if at == n else [*out, n]


def chunked(rows: DataFrame, key: str = "doc_id", content: str = "text", *, least: int = LEAST, average: int = AVERAGE, largest: int = LARGEST) -> DataFrame:
    """(key, seq, start, size, hash): content-defined chunks of each content; null and empty contents have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            at, seq, start, size, digest = [], [], [], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                data = x.encode() if isinstance(x, str) else x or b""
                last = 0
                for n, end in enumerate(cuts(data, least, average, largest)):
                    at.append(i)
                    seq.append(n)
                    start.append(last)
                    size.append(end - last)
                    digest.append(hashlib.sha256(data[last:end]).hexdigest())
                    last = end
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(seq, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())], ["key", "seq", "start", "size", "hash"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), content).mapInArrow(run, f"key {kind}, seq long, start long, size long, hash string").withColumnRenamed("key", key)
