"""Repeated passages by sparse suffix arrays.

A suffix is retained where its first K words are the minimiser of some stretch of `least` words: the smallest hash of the
stretch's K-grams, the first of equals. Each stretch of `least` words thus belongs to one retained suffix, at a place
that its own words fix, and a passage that occurs twice has its stretches belong to suffixes of equal beginnings (their anchor).
Suffixes whose whole extension, to the left and right as far as stretches belong to them, is equal match as they are: they are
counted together. Of the others with an anchor in common, one of each extension is sorted by its words to the right, and again
by its words to the left, from the anchor on. In sorted order the longest agreement with any other suffix is that with a
neighbour; partitions are ranges of the order, and the suffixes at their borders are compared in a pass of their own. A suffix
can share a stretch with another only within both agreements: these stretches, no others, are matched by digest, as the two
agreements can be with different suffixes. The union of a document's matching stretches is exactly what occurs again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from grove.llm._shared import packed, partitions, released, releasing, spread, stored, table, text_batches, unpacked
from grove.llm._words import Runs, word_hashes, word_spans

#: Words of a passage at least, and of a suffix's beginning.
LEAST, K = 50, 10
#: Texts are taken into numpy so many bytes at a time.
AT_ONCE = 1 << 20

SUFFIXES = "anchor long, context long, id long, th long, at long"
CONTENTS = "anchor long, id long, th long, at long, n long, to_right binary, to_left binary"
STRETCHES = "w1 long, w2 long, id long, th long, start int, n long"
SPAN = "struct<start: int, end: int>"


class Texts:
    """Words of a batch of texts, one after the other."""

    def __init__(self, texts: pa.Array):
        parts = [(t.as_py() or "").encode() for t in texts]
        self.raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.text_start = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.start, self.end = word_spans(self.raw)
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.text_start[:-1], "left")
        self.words = word_hashes(self.raw, self.start, self.end)


def suffixes(texts: Texts, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(place, low, high, anchor, context) of each retained suffix: word places in the batch; low to high are the starts
    of the stretches that belong to it; anchor is the hash of its beginning, context of its extension."""
    n = len(texts.start)
    if n < least:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams, runs = np.arange(n - k + 1), Runs(texts.words)
    value = runs.hash(grams, grams + k)
    width, reach = least - k + 1, 1
    best, place = value, grams
    while reach * 2 <= width:
        best, place = _smaller(best, place, reach, len(best) - reach)
        reach *= 2
    if reach < width:
        best, place = _smaller(best, place, width - reach, len(best) - (width - reach))
    begin = np.arange(n - least + 1)
    valid = texts.text[begin] == texts.text[begin + least - 1]
    begin, place = begin[valid], place[: n - least + 1][valid]
    if not len(begin):
        return begin, begin, begin, begin.astype(np.uint64), begin.astype(np.uint64)
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)
    at = np.flatnonzero(new)
    low, high, place = begin[at], begin[np.append(at[1:], len(begin)) - 1], place[at]
    context = runs.hash(low, high + least, 1) ^ (place - low).astype(np.uint64)
    return place, low, high, value[place], context


def _smaller(best: np.ndarray, place: np.ndarray, shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    left = best[:size] <= best[shift : shift + size]
    return np.where(left, best[:size], best[shift : shift + size]), np.where(left, place[:size], place[shift : shift + size])


@releasing
def _retain(least: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", AT_ONCE):
            texts = Texts(batch.column("text"))
            place, low, high, anchor, context = suffixes(texts, least, k)
            row = texts.text[place] if len(place) else place
            at = pack(place - texts.first[row], place - high, place - low) if len(place) else place
            ids, th = batch.column("id").take(pa.array(row)), batch.column("th").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), ids, th, pa.array(at)], ["anchor", "context", "id", "th", "at"])

    return run


def pack(place: np.ndarray, least_left: np.ndarray, most_left: np.ndarray) -> np.ndarray:
    """A suffix's place with the fewest and most words that a stretch of its own has left of it: low is place - most_left."""
    return (place << 24) | (most_left << 12) | least_left


LOW = "cast(shiftright(at, 24) - (shiftright(at, 12) & 4095) as int)"
HIGH = "cast(shiftright(at, 24) - (at & 4095) as int)"


@releasing
def _contents(least: int, k: int):
    """Each of a document's own suffixes with the hashes of its words, outwards from the anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", AT_ONCE):
            texts = Texts(batch.column("text"))
            onward, back, n = texts.words.astype(">u8").tobytes(), texts.words[::-1].astype(">u8").tobytes(), len(texts.words)
            lists = batch.column("own")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            at = flat.field("at").to_numpy()
            place = (at >> 24) + texts.first[row]
            low, high = place - ((at >> 12) & 4095), place - (at & 4095)
            right = [onward[8 * a : 8 * b] for a, b in zip((place + k).tolist(), (high + least).tolist(), strict=True)]
            left = [back[8 * a : 8 * b] for a, b in zip((n - place).tolist(), (n - low).tolist(), strict=True)]
            take = pa.array(row)
            columns = [flat.field("anchor"), batch.column("id").take(take), batch.column("th").take(take), flat.field("at"), flat.field("n"), pa.array(right, pa.binary()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "id", "th", "at", "n", "to_right", "to_left"])

    return run


def agreement(anchors: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Words that each row has in common with the next, from the first on; -1 where the anchors differ."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n) // 8
    width = int(length.max(initial=0))
    grid = np.frombuffer(b"".join(w.ljust(8 * width, b"\0") for w in words), np.uint64).reshape(n, width) if width else np.zeros((n, 0), np.uint64)
    both = np.minimum(length[:-1], length[1:])
    equal = (grid[:-1] == grid[1:]) & (np.arange(width) < both[:, None])
    common = np.where(equal.all(axis=1), width, equal.argmin(axis=1)) if width else np.zeros(max(0, n - 1), np.int64)
    return np.where(anchors[:-1] == anchors[1:], common, -1)


@releasing
def neighbours(column: str):
    """Adds `reach` to rows that come sorted by anchor and the column's words: the most words in common with the row before or after.

    `border` numbers the first and last row of each partition, in the order of partitions; it is null elsewhere.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, border = None, -1, 2 * TaskContext.get().partitionId()

        def out(rows: pa.Table, reach: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
            mark = np.full(rows.num_rows, -1, np.int64)
            if last and rows.num_rows:
                mark[-1] = border + 1
            if first and rows.num_rows:
                mark[0] = border
            more = rows.append_column("reach", pa.array(reach.astype(np.int32))).append_column("border", pa.array(mark, pa.int64(), mask=mark < 0))
            yield from more.to_batches()

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            common = agreement(rows.column("anchor").to_numpy(), rows.column(column).to_pylist())
            reach = np.maximum(np.append(before, common[:-1]), common) if len(common) else np.zeros(0, np.int64)
            yield from out(rows.slice(0, len(common)), reach, first and len(common) > 0, False)
            first = first and not len(common)
            held, before = rows.slice(len(common)), int(common[-1]) if len(common) else before
        if held is not None:
            yield from out(held, np.array([before]), first, True)

    return run


def reached(contents: DataFrame, column: str, name: str) -> DataFrame:
    """contents with the longest agreement (name, in words) of each row's column with any other row of its anchor."""
    ordered = contents.repartitionByRange(partitions(contents), "anchor", column, "id", "th", "at").sortWithinPartitions("anchor", column, "id", "th", "at")
    kinds = ", ".join(f"{c} {t}" for c, t in contents.dtypes) + ", reach int, border long"
    compared = stored(ordered.mapInArrow(neighbours(column), kinds), f"by-{name}")
    # Two rows of each partition that has any: compared over the partitions' borders in one task.
    edges = compared.where("border is not null").select("anchor", column, F.col("border").alias("at")).coalesce(1).sortWithinPartitions("at")
    over = edges.mapInArrow(neighbours(column), f"anchor long, {column} binary, at long, reach int, border long").select(F.col("at").alias("border"), F.col("reach").alias("over"))
    both = F.greatest("reach", F.coalesce("over", F.lit(-1)))
    return compared.join(F.broadcast(over), "border", "left").select(*contents.columns, both.alias(name))


@releasing
def _stretches(least: int, k: int):
    """Digests of a suffix's stretches that lie within both of its agreements."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, right, left = (batch.column(c).to_numpy() for c in ("at", "right", "left"))
            fewest, most = np.maximum(at & 4095, least - k - right), np.minimum((at >> 12) & 4095, left)
            rows = np.flatnonzero(fewest <= most)
            if not len(rows):
                continue
            anchors = batch.column("anchor").to_numpy().view(np.uint64)
            words, middle = [], []
            n = 0
            for r in rows.tolist():
                before = np.frombuffer(batch.column("to_left")[r].as_py(), ">u8")[::-1]
                after = np.frombuffer(batch.column("to_right")[r].as_py(), ">u8")
                middle.append(n + len(before))
                words += [before.astype(np.uint64), anchors[r : r + 1], after.astype(np.uint64)]
                n += len(before) + 1 + len(after)
            # The anchor counts as one word: equal stretches have it in the same place.
            runs = Runs(np.concatenate(words))
            many = most[rows] - fewest[rows] + 1
            which = np.repeat(np.arange(len(rows)), many)
            to_left = fewest[rows][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            first = np.array(middle, np.int64)[which] - to_left
            w1, w2 = (runs.hash(first, first + least - k + 1, i).view(np.int64) for i in (0, 1))
            take = pa.array(rows[which])
            begin = (at[rows][which] >> 24) - to_left
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), batch.column("id").take(take), batch.column("th").take(take), pa.array(begin.astype(np.int32)), batch.column("n").take(take)], ["w1", "w2", "id", "th", "start", "n"])

    return run


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What a document goes by: its id or, where that is null, a negative hash of the text; a hash of the text whose last bit says that the id is null."""
    none = F.col(id_col).isNull()
    own = F.xxhash64(F.lit("null"), text_col).bitwiseOR(F.lit(-(2**63)))
    return F.coalesce(F.col(id_col).cast("long"), own), F.xxhash64(text_col).bitwiseAND(F.lit(-2)).bitwiseOR(none.cast("long"))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = K) -> DataFrame:
    """(id, key, th, repeated, removable): of each document that shares a stretch of `least` words, the spans of words
    (arrays of start and end) that lie in stretches which occur twice or more, in one document or several, and of those
    the spans that lie in a stretch which isn't the first of its equals by id, hash of the text and place.

    Words are compared as they are. (key, th) are 127 bits that tell documents apart: see _key. Rows that share id and text are one
    document: their stretches count for each row, but all keep the same part. Null ids come before ids that aren't negative, in order of a hash;
    null and short texts share nothing. Whole texts are used; other columns are not read. A class of equal stretches is only ever counted, never listed.
    """
    if not k <= least <= 2048:
        raise ValueError("a passage has k words at least and 2048 at most")
    own_id, own_text = _key(id_col, text_col)
    rows = docs.select(own_id.alias("id"), own_text.alias("th"), F.col(text_col).alias("text"))
    kept = stored(rows.mapInArrow(_retain(least, k), SUFFIXES), "suffixes")
    groups = stored(kept.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "at")).alias("first")), "extensions")
    # Where a beginning has one extension alone, every stretch of it matches and the first place is known.
    mixed = groups.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    apart = groups.join(mixed, "anchor", "left_semi").select("first.id", "first.th", F.struct("anchor", F.col("first.at").alias("at"), "n").alias("own"))
    wanted = apart.groupBy("id", "th").agg(F.collect_list("own").alias("own"))
    met = rows.dropDuplicates(["id", "th"]).join(wanted, ["id", "th"]).select("id", "th", "text", "own")
    contents = met.mapInArrow(_contents(least, k), CONTENTS)
    both = reached(reached(contents, "to_right", "right"), "to_left", "left")
    stretches = stored(both.mapInArrow(_stretches(least, k), STRETCHES), "stretches")
    same = stretches.groupBy("w1", "w2").agg(F.sum("n").alias("c"), F.min(F.struct("id", "th", "start")).alias("first")).where("c > 1")
    place = lambda x: F.struct("id", "th", x)
    by_one = spread(stretches, same.select("w1", "w2", "first"), ["w1", "w2"], F.col("id"), 8).select("id", "th", F.col("start").alias("low"), F.col("start").alias("high"), (~place("start").eqNullSafe(F.col("first"))).alias("later"))
    several = groups.where("n > 1").select("anchor", "context", "first")
    by_all = spread(kept, several, ["anchor", "context"], F.col("id"), 8).select("id", "th", F.expr(LOW).alias("low"), F.expr(HIGH).alias("high"), (~place("at").eqNullSafe(F.col("first"))).alias("later"))
    found = by_one.union(by_all).groupBy("id", "th").agg(F.collect_set(F.struct("low", "high", "later")).alias("found"))
    merged = found.mapInArrow(_merge(least), f"id long, th long, repeated array<{SPAN}>, removable array<{SPAN}>")
    shown = F.when(F.col("th").bitwiseAND(F.lit(1)) == 0, F.col("id"))
    return merged.select(shown.alias("id"), F.col("id").alias("key"), "th", "repeated", "removable")


def union(low: np.ndarray, high: np.ndarray) -> list[dict]:
    """Spans that cover low to high (an end), merged where they meet."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return [{"start": a, "end": b} for a, b in zip(low[new].tolist(), high[np.append(new[1:], len(low)) - 1].tolist(), strict=True)]


@releasing
def _merge(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            repeated, removable = [], []
            offsets, flat = batch.column("found").offsets.to_numpy(), batch.column("found").values
            low, high, later = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "later"))
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                x, y, z = low[a:b], high[a:b] + least, later[a:b]
                repeated.append(union(x, y))
                removable.append(union(x[z], y[z]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(repeated, kind), pa.array(removable, kind)], ["id", "th", "repeated", "removable"])

    return run


def _sum(spans: str):
    return F.aggregate(spans, F.lit(0), lambda a, x: a + x["end"] - x["start"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that shares a passage of 50 words or more."""
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.size("repeated").alias("n_spans"), _sum("repeated").alias("repeated_words"), _sum("removable").alias("removable_words"), "repeated", "removable")


def without(text: str | None, spans: list[dict]) -> str:
    """The text without spans of words, from each span's first word up to the next word after it."""
    raw = (text or "").encode()
    start, _ = word_spans(np.frombuffer(raw, np.uint8))
    start, at, parts = [*start.tolist(), len(raw)], 0, []
    for s in spans:
        parts.append(raw[at : start[s["start"]]])
        at = start[s["end"]]
    return b"".join([*parts, raw[at:]]).decode()


@released
def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "_text"):
        spans = batch.column("_spans")
        texts = batch.column("_text")
        cut = [without(texts[i].as_py(), spans[i].as_py()) if spans[i].is_valid else None for i in range(batch.num_rows)]
        done = pa.compute.if_else(spans.is_valid(), pa.array(cut, pa.string()), texts)
        yield pa.RecordBatch.from_arrays([batch.column("row"), spans.is_valid(), done], ["row", "cut", "_text"])


def remove_repeats(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """docs with each repeated passage cut from the texts, but for its first occurrence; n_chars follows the text.

    A document of which no word is left goes; all others stay, and a text without such a passage stays as it is. Other columns
    may have any names.
    """
    cut = repeats(docs, least=least).where(F.size("removable") > 0).select("key", "th", F.col("removable").alias("_spans"))
    own_id, own_text = _key("doc_id", "text")
    rest = packed(docs, own_id.alias("key"), own_text.alias("th"), F.col("text").alias("_text"), leave="text")
    met = rest.join(cut, ["key", "th"], "left").select("row", "_text", "_spans")
    done = met.mapInArrow(_cut, StructType([met.schema["row"], StructField("cut", BooleanType()), StructField("_text", StringType())]))
    left = done.where(~F.col("cut") | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*unpacked(docs, {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}))
