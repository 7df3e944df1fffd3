"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model is compiled to transducers: the normaliser (a leading space, and each character's replacement), the pieces (a trie that reads
characters and writes a piece's id when it returns to its root), and byte fallback (from the root, a character that is no
piece writes the pieces of its UTF-8 bytes). For an input they are composed to an acyclic graph: a state is a place in the text
with the piece that ended there, an arc a piece or a character's bytes. Weights are of the tropical semiring: each id that an arc
writes costs 1, a byte arc UNKNOWN_COST more, and a piece after one that it can't follow BARRED more; costs are relaxed from place to
place, and the encoding is the shortest path. One piece can follow another if merging their joined text by rank gives just these
two. In a model of merges (BPE) one path is free of such pairs, the library's; weights of pieces alone would not do, as
merges are by rank and not by the sum of scores. The graph falls apart where no piece has two characters side by side, so
texts are composed stretch by stretch, and paths of stretches seen before are remembered.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm._shared import releasing, table, text_batches

MARK = "▁"
#: Bytes (about) of stretches with their paths that a worker remembers of late; beyond that those not used since as many were last put
#: by are forgotten. Pairs of pieces remembered; beyond that all are forgotten. Stretches of more characters than LONGEST aren't remembered.
#: Results don't depend on it.
REMEMBERED, PAIRS, LONGEST = 80 << 20, 250_000, 64
#: Costs of a byte arc beside its ids, and of a piece after one that it can't follow: over any sum of others.
UNKNOWN_COST, BARRED = 1 << 10, 1 << 50
#: Kinds of pieces, of models and of their settings in a model file (numbers of its fields).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, WHITESPACE_SUFFIX = 3, 35, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message in wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


class Normaliser:
    """One state before a text and one within: an arc into the text writes the prefix, one for each character its replacement."""

    def __init__(self, prefix: str, arcs: dict[str, str]):
        self.prefix, self.arcs = prefix, str.maketrans(arcs)

    def compose(self, text: str) -> str:
        """What the transducer writes for a text (none for the empty one)."""
        return self.prefix + text.translate(self.arcs) if text else ""


class Pieces:
    """A trie: arcs read a character; the arc from a state back to the root (under the key ENDS) writes the id of the piece that was read.

    Characters that are no piece have byte arcs, from the root to the root: they write the pieces of their bytes, or the unknown piece.
    """

    ENDS = ""

    def __init__(self, vocabulary: dict[str, int], byte: dict[int, int] | None, unknown: int):
        self.root: dict = {}
        self.byte, self.unknown = byte, unknown
        for text, i in vocabulary.items():
            state = self.root
            for c in text:
                state = state.setdefault(c, {})
            state[self.ENDS] = i
        self.alone = {c for c, state in self.root.items() if self.ENDS in state}

    def bytes_of(self, c: str) -> list[int]:
        """What the byte arc of a character that is no piece writes."""
        return [self.unknown] if self.byte is None else [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]


class Transducer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        settings = {n: dict(fields(v)) for n, v in model if n in (TRAINER, NORMALIZER)}
        trainer, normalizer = settings.get(TRAINER, {}), settings.get(NORMALIZER, {})
        pieces = [dict(fields(v)) for n, v in model if n == PIECES]
        self.text = [p[PIECE_TEXT].decode() for p in pieces]
        self.kind = [p.get(PIECE_KIND, NORMAL) for p in pieces]
        self.score = [float(np.frombuffer(p.get(PIECE_SCORE, b"\0\0\0\0"), "<f4")[0]) for p in pieces]
        if trainer.get(MODEL_TYPE, 1) != BPE or USER in self.kind or trainer.get(WHITESPACE_SUFFIX, 0):
            raise ValueError("a model of merges without user-defined pieces is asked for")
        if normalizer.get(CHARSMAP) or normalizer.get(REMOVE_SPACES, 1) or not normalizer.get(ESCAPE_SPACES, 1):
            raise ValueError("a normaliser that keeps characters and spaces is asked for")
        #: Spaces stand for the mark on this side, so that texts keep their compact form.
        self.normaliser = Normaliser(" " if normalizer.get(DUMMY_PREFIX, 1) else "", {MARK: " "})
        self.text = [t.replace(MARK, " ") for t in self.text]
        self.vocabulary = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.unknown = self.kind.index(UNKNOWN)
        byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.pieces = Pieces(self.vocabulary, byte if trainer.get(BYTE_FALLBACK, 0) else None, self.unknown)
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.encode() for t, k in zip(self.text, self.kind, strict=True)]
        #: Characters side by side in some piece; between others every path has a state.
        self.inside = {(a, b) for t in self.vocabulary for a, b in zip(t, t[1:], strict=False)}
        self.cut = self._cut()
        self.follows: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _cut(self) -> re.Pattern:
        """What takes a text apart where no piece reaches across: before spaces, at line ends, between words and signs."""
        if any(b == " " != a for a, b in self.inside):
            return re.compile(r"(?s).+")
        signs = [c for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" if not any((a == c and b.isalpha()) or (b == c and a.isalpha()) for a, b in self.inside)]
        alone = "".join(map(re.escape, signs))
        line = "" if any("\n" in pair for pair in self.inside) else "\n"
        return re.compile(rf" *[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{alone}{line} ]|$)| *[^ {line}]+| +|\n")

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: the neighbours whose joined text has the highest score, the first of equals, again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.vocabulary.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.score[p] > best):
                    best, at = self.score[p], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def can_follow(self, before: int, piece: int) -> bool:
        """Whether merging the two pieces' joined text gives the two."""
        known = self.follows.setdefault(before, {}).get(piece)
        if known is None:
            pair = [self.text[before], self.text[piece]]
            known = self.follows[before][piece] = self.merged("".join(pair)) == pair
            self.pairs += 1
        return known

    def shortest(self, text: str, most: int = BARRED) -> tuple[int, bytes]:
        """(cost, ids) of the shortest path over a stretch of those that cost less than most; cost most if there is none.

        reach[place] has, for each piece that ends there (-1: none, or bytes, which any piece can follow), the least cost and the arc it came by:
        costs are relaxed in order of places. A path without a barred pair is what merging gives of the text so far, and there is
        only one of each place: with BARRED the limit, an arc to a place that has such a path is over the limit and not looked at.
        """
        n, root, ends, alone, free = len(text), self.pieces.root, Pieces.ENDS, self.pieces.alone, most <= BARRED
        if self.pairs > PAIRS:
            self.follows, self.pairs = {}, 0
        follows = self.follows
        reach: list[dict] = [{} for _ in range(n + 1)]
        reach[0][-1] = (0, 0, -1)
        for start in range(n):
            here = reach[start]
            if not here:
                continue
            state = root
            known = [(before, at[0] + 1, follows.setdefault(before, {})) for before, at in here.items()]
            for end in range(start, n):
                state = state.get(text[end])
                if state is None:
                    break
                piece = state.get(ends)
                if piece is None:
                    continue
                there = reach[end + 1]
                if free and there:
                    continue
                for before, total, follow in known:
                    if before >= 0:
                        can = follow.get(piece)
                        if not (self.can_follow(before, piece) if can is None else can):
                            total += BARRED
                    if total < most and (piece not in there or total < there[piece][0]):
                        there[piece] = (total, start, before)
            if text[start] not in alone:
                before, at = min(here.items(), key=lambda x: (x[1][0], x[0]))
                total, there = at[0] + len(self.pieces.bytes_of(text[start])) + UNKNOWN_COST, reach[start + 1]
                if total < most and (-1 not in there or total < there[-1][0]):
                    there[-1] = (total, start, before)
        if not reach[n]:
            return most, b""
        at, last = n, min(reach[n].items(), key=lambda x: (x[1][0], x[0]))[0]
        cost, out = reach[n][last][0], []
        while at:
            _, start, before = reach[at][last]
            out += self.pieces.bytes_of(text[start])[::-1] if last < 0 else [last]
            at, last = start, before
        return cost, array("I", out[::-1]).tobytes()

    def stretches(self, chunk: str) -> list[str]:
        cuts = [i for i, pair in enumerate(zip(chunk, chunk[1:], strict=False), 1) if pair not in self.inside]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)] if cuts else [chunk]

    def path(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            parts = self.stretches(chunk)
            if len(parts) == 1:
                cost, ids = self.shortest(chunk)
                if cost >= BARRED:  # every path has a barred pair: the one with the fewest
                    ids = self.shortest(chunk, 1 << 62)[1]
            else:
                ids = b"".join([self.paths.get(p) or self.path(p) for p in parts])
        if len(chunk) <= LONGEST:
            self.held += 160 + 4 * len(chunk) + len(ids)
            if self.held > REMEMBERED:
                self.older, self.paths, self.held = self.paths, {}, 0
            self.paths[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers (null or empty: none)."""
        known, path = self.paths.get, self.path
        return b"".join([known(c) or path(c) for c in self.cut.findall(self.normaliser.compose(text or ""))])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the pieces' characters and bytes, without the leading space that the normaliser adds."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if self.normaliser.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per Python worker."""
    return Transducer(path)


def _names(batch: pa.RecordBatch, leave: str) -> list[str]:
    return [c for c in batch.schema.names if c != leave]


@releasing
def _encode(path: str, check: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in text_batches(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            ids = [t.encode(x) for x in texts]
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            keys = _names(batch, "_text")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            same = [pa.array([t.decode(np.frombuffer(i, "<u4").tolist()) == (x or "") for i, x in zip(ids, texts, strict=True)], pa.bool_())] if check else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), lists, *same], [*keys, "ids", *["restored"] * check])

    return run


@releasing
def _decode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            keys = _names(batch, "ids")
            texts = [None if x is None else t.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(texts, pa.string())], [*keys, "text"])

    return run


@releasing
def _round_trip(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in text_batches(batches, "_text"):
            n, sums, text_sums, same = [], [], [], []
            for x in batch.column("_text").to_pylist():
                raw = t.encode(x)
                back = t.decode(np.frombuffer(raw, "<u4").tolist())
                n.append(len(raw) // 4)
                sums.append(zlib.crc32(raw))
                text_sums.append(zlib.crc32(back.encode()))
                same.append(back == (x or ""))
            keys = _names(batch, "_text")
            made = [pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(text_sums, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *made], [*keys, "n_tokens", "ids_crc32", "text_crc32", "restored"])

    return run


def _rows(docs: DataFrame, keys: tuple[str, ...], text_col: str) -> tuple[DataFrame, list[str]]:
    rows = docs.select(*keys, F.col(text_col).alias("_text"))
    types = dict(rows.dtypes)
    return rows, [f"`{k}` {types[k]}" for k in keys]


def encode(docs: DataFrame, model: str, *, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", check: bool = False) -> DataFrame:
    """(keys, ids array<int>), one row per row of docs: the library's ids of each whole text, without begin or end.

    With check a column `restored` says whether the ids decode to the text (null: to the empty text). Null and empty texts have no ids. Null and repeated keys stay; they must not be named as a result column; other columns are not read.
    """
    rows, kinds = _rows(docs, keys, text_col)
    return rows.mapInArrow(_encode(model, check), ", ".join([*kinds, "ids array<int>", *["restored boolean"] * check]))


def decode(rows: DataFrame, model: str, *, keys: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """(keys, text): the text of each row's ids (null: null). A text without the space mark comes back as it was."""
    given = rows.select(*keys, F.col(ids_col).alias("ids"))
    types = dict(given.dtypes)
    return given.mapInArrow(_decode(model), ", ".join([*(f"`{k}` {types[k]}" for k in keys), "text string"]))


def round_trip(docs: DataFrame, model: str, *, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(keys, n_tokens, ids_crc32, text_crc32, restored): encoding and decoding in one pass.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers, text_crc32 of the decoded text in UTF-8; restored: it is the
    text (null: the empty text).
    """
    rows, kinds = _rows(docs, keys, text_col)
    return rows.mapInArrow(_round_trip(model), ", ".join([*kinds, "n_tokens long, ids_crc32 long, text_crc32 long, restored boolean"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
