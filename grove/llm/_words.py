"""Words of many texts as numpy arrays, with hashes of words and of runs of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; a longer word is a block of its own.
BLOCK = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below some size over n."""
    return _powers(base, 1 << max(12, n.bit_length()))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't ASCII white space."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SEPARATOR[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = powers(BASES[0], high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTES[raw[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Runs:
    """Hashes of any runs of words: 64 bits from each of the BASES."""

    def __init__(self, words: np.ndarray):
        self.sums, self.down = [], []
        for k, base in enumerate(BASES):
            up, down = powers(base, len(words) + 1)
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum((mix(words + np.uint64(k)) if k else words) * up[: len(words)], out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def hash(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return mix((self.sums[which][end] - self.sums[which][start]) * self.down[which][start] + (end - start).astype(np.uint64))
