"""SimHash near-duplicates: tiled exact comparison of fingerprints; in the pipeline, of the candidates' shingles too."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm._components import components, forest
from grove.llm._shared import fresh, partitions, releasing, spread, stored, table

SEED = 42
#: Fingerprints of a block; two blocks meet in one task. A tile is a part of one, compared in one numpy operation.
BLOCK, TILE = 32_768, 512
#: Blocks that a small table is cut to, of this size at least, so that all cores are busy; tasks that pairs of blocks are dealt to at most.
LEAST_BLOCKS, LEAST_BLOCK, MOST_TASKS = 16, 1024, 20_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each `size`-word shingle of the text in lower case (A-Z alone), repeats included; fewer words: of all of them."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-size])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """`words` 64-bit words: a bit is 1 if it is set in over half the hashes. Words past the first take remixed hashes."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        h = hashes
        if k:
            h = (h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


@releasing
def _fingerprints(size: int, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), size), words) for t in batch.column("_text")]
            keys = [c for c in batch.schema.names if c != "_text"]
            texts = pa.array(["".join(f"{x:016x}" for x in f.tolist()) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), texts], [*keys, "fingerprint"])

    return run


def tile_links(x: np.ndarray, y: np.ndarray, radius: int, same: bool, marks: tuple[np.ndarray, np.ndarray] | None = None, gap: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (i in x, j in y) of fingerprints (n x words, sorted by _order) at radius or fewer differing bits; tiles compared.

    The bits that differ are at least as many as the 16-bit parts' population counts differ in sum: tiles
    whose ranges of counts are further apart than the radius are skipped, as are those whose marks (n x marks of each side)
    are further apart than the gap. No tile returns more links than its fingerprints: it returns a forest of the same components.
    """
    cut = lambda p: (np.minimum.reduceat(p, range(0, len(p), TILE)), np.maximum.reduceat(p, range(0, len(p), TILE)))
    sides = [(cut(parts(x)), cut(parts(y)), radius)] + ([(cut(marks[0]), cut(marks[1]), gap)] if marks is not None else [])
    left, right, done = [], [], 0
    for i in range(-(-len(x) // TILE)):
        near = np.ones(-(-len(y) // TILE), bool)
        for (lx, hx), (ly, hy), most in sides:
            near &= np.maximum(0, np.maximum(ly - hx[i], lx[i] - hy)).sum(axis=1) <= most
        tx = x[i * TILE : (i + 1) * TILE]
        for j in np.flatnonzero(near).tolist():
            if same and j < i:
                continue
            ty = y[j * TILE : (j + 1) * TILE]
            bits = np.bitwise_count(tx[:, None, 0] ^ ty[None, :, 0])
            for k in range(1, x.shape[1]):
                bits = bits + np.bitwise_count(tx[:, None, k] ^ ty[None, :, k])
            done += 1
            a, b = np.nonzero(bits <= radius)
            if same and i == j:
                a, b = a[a < b], b[a < b]
            if len(a) > len(tx) + len(ty):
                own = same and i == j
                a, b = forest(a, b if own else b + len(tx), len(tx) + (0 if own else len(ty)))
                if not own:  # nodes of both tiles: a link within a tile goes by its place in x and y below
                    a, b = _sided(a, b, len(tx))
            left.append(a + i * TILE)
            right.append(b + j * TILE)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), done


def _sided(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest's edges as links between the sides 0..n-1 and n..: each root is of the first side, as it has the smaller
    places; a node of the first side goes by any node of the second in its component."""
    second = a >= n
    via = dict(zip(b[second].tolist(), a[second].tolist(), strict=True))
    return np.where(second, b, a), np.where(second, a, [via[r] for r in b.tolist()]) - n


def parts(x: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit parts of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(x).view("<u2")).reshape(len(x), -1).astype(np.int16)


def _order(x: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Places in order of a single mark or, with more or none, of population counts."""
    keys = parts(x) if marks is None or marks.shape[1] != 1 else marks
    return np.lexsort(keys.T[::-1]) if len(x) else np.zeros(0, np.int64)


def _numbers(texts: pa.Array) -> np.ndarray:
    raw = bytes.fromhex("".join(texts.to_pylist()))
    return np.frombuffer(raw, ">u8").astype("<u8").reshape(len(texts), -1)


def _compare(radius: int, gap: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        names, block = rows.column("node").combine_chunks(), rows.column("block").to_numpy()
        both = _numbers(rows.column("fingerprint").combine_chunks())
        marks = rows.column("marks").combine_chunks().flatten().to_numpy().reshape(len(both), -1).astype(np.int64)
        at = [np.flatnonzero(block == b) for b in ([i] if i == j else [i, j])]
        at = [p[_order(both[p], marks[p])] for p in at]
        if any(len(p) == 0 for p in at):
            a = b = np.zeros(0, np.int64)
        else:
            a, b, _ = tile_links(both[at[0]], both[at[-1]], radius, i == j, (marks[at[0]], marks[at[-1]]), gap)
            a, b = forest(at[0][a], at[-1][b], len(both)) if len(a) else (a, b)
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b))})

    return run


#: A block's bin: its classes' ranges of marks, how many blocks it has and which is the first.
Bin = tuple[list[int], list[int], int, int]


def bins(classes: list[tuple[tuple[int, ...], int, list[int], list[int]]], size: int) -> tuple[list[Bin], dict[tuple[int, ...], int]]:
    """Bins of classes (class, rows, least marks, most marks) in their order, and each class's bin: a bin has `size` rows in one block or, for a
    class of more, as many blocks as it takes."""
    out: list[list] = []
    where: dict[tuple[int, ...], int] = {}
    filled = size
    for name, n, low, high in sorted(classes):
        if filled + n > size:
            out.append([list(low), list(high), -(-n // size)])
            filled = 0
        else:
            out[-1][0], out[-1][1] = list(map(min, out[-1][0], low)), list(map(max, out[-1][1], high))
        filled += n
        where[name] = len(out) - 1
    first = [0, *accumulate(b[2] for b in out)]
    return [(low, high, many, at) for (low, high, many), at in zip(out, first, strict=False)], where


def met_bins(found: list[Bin], gap: int) -> np.ndarray:
    """Which bins' marks come within the gap, summed over marks."""
    low, high = (np.array([b[i] for b in found], np.int64).reshape(len(found), -1) for i in (0, 1))
    apart = np.zeros((len(found), len(found)), np.int64)
    for k in range(low.shape[1]):
        apart += np.maximum(0, np.maximum(low[None, :, k] - high[:, None, k], low[:, None, k] - high[None, :, k]))
    return apart <= gap


def links(nodes: DataFrame, radius: int, gap: int, step: int = 1) -> DataFrame:
    """(a, b): links between nodes (node string, fingerprint string of hex digits, marks array<int>), a forest of each pair of blocks.

    Nodes whose marks differ by more than the gap, summed over marks, are known not to link. Blocks are of nodes with
    near marks (classes of `step`; a class that is over a block is dealt by hash), and only pairs of blocks whose ranges come
    within the gap are made: the others are dropped before the shuffle. Marks must have few classes (1000 or so), which the driver counts.
    Each pair of blocks is one group, of two blocks at most in expectation. All their pairs are compared but for skipped tiles.
    """
    spark = nodes.sparkSession
    kind = F.transform("marks", lambda m: F.floor(m / step).cast("int")).alias("class")
    one = nodes.select(F.size("marks")).first()
    marks = range(one[0] if one else 0)
    ends = [f(F.col("marks")[k]).alias(f"{n}{k}") for n, f in (("low", F.min), ("high", F.max)) for k in marks]
    counted = nodes.groupBy(kind).agg(F.count("*").alias("n"), *ends).collect()
    total = sum(r.n for r in counted)
    found, where = bins([(tuple(r["class"]), r.n, [r[f"low{k}"] for k in marks], [r[f"high{k}"] for k in marks]) for r in counted], min(BLOCK, max(LEAST_BLOCK, -(-total // LEAST_BLOCKS))))
    if not found:
        return spark.createDataFrame([], "a string, b string")
    met, pairs, ranges = met_bins(found, gap), 0, []
    for i, (_, _, many, _) in enumerate(found):
        spans: list[list[int]] = []
        for j in np.flatnonzero(met[i]).tolist():
            at, n = found[j][3], found[j][2]
            pairs += many * n
            if spans and spans[-1][1] == at - 1:
                spans[-1][1] = at + n - 1
            else:
                spans.append([at, at + n - 1])
        ranges.append(spans)
    rows = [(list(c), found[b][3], found[b][2], ranges[b]) for c, b in where.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "class array<int>, first int, many int, spans array<array<int>>"))
    own = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("many"))).cast("int").alias("block")
    others = F.explode(F.flatten(F.transform("spans", lambda s: F.sequence(s[0], s[1])))).alias("other")
    dealt = nodes.select("node", "fingerprint", "marks", kind).join(plan, "class").select("node", "fingerprint", "marks", own, others)
    both = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "fingerprint", "marks", "block")
    tasks = min(max(pairs, partitions(nodes)), MOST_TASKS)
    return both.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(_compare(radius, gap), "a string, b string")


def _ones(bits: int) -> Column:
    """Marks of a fingerprint: the population counts of its halves, which bound the bits that differ from below."""
    digits = bits // 8
    words = lambda at: [F.bit_count(F.conv(F.substr("fingerprint", F.lit(x + 1), F.lit(8)), 16, 10).cast("long")) for x in range(at, at + digits, 8)]
    return F.array(*(sum(words(at)[1:], words(at)[0]).cast("int") for at in (0, digits))).alias("marks")


def near_duplicates(docs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 2) -> DataFrame:
    """(keys, fingerprint, component_id), one row per row of docs; the first key is the id, a long.

    Fingerprints link at `radius` or fewer differing bits of `bits` (a multiple of 64). component_id is the smallest id
    reachable over links, itself included. Null and empty texts have fingerprint 0 and link like any other;
    null ids are passed over by the minimum and get their component's id, null if it has no other. Rows that
    repeat are rows of one component. Other columns of docs are not read; keys must not be named as a result column.
    """
    rows = docs.select(*keys, F.col(text_col).alias("_text"))
    types = dict(rows.dtypes)
    made = rows.mapInArrow(_fingerprints(shingle, bits // 64), ", ".join([*(f"`{k}` {types[k]}" for k in keys), "fingerprint string"]))
    made = stored(made, "fingerprints")
    distinct = stored(made.groupBy("fingerprint").agg(F.min(keys[0]).alias("least")), "distinct")
    linked = components(links(distinct.select(F.col("fingerprint").alias("node"), "fingerprint", _ones(bits)), radius, radius)).withColumnRenamed("node", "fingerprint")
    root = F.coalesce("component", "fingerprint")
    named = distinct.join(linked, "fingerprint", "left").select("fingerprint", "least", root.alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(least, "root").select("fingerprint", "component_id"), "classes")
    return made.join(classes, "fingerprint").select(*keys, "fingerprint", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The pipeline's stage: 192 bits of distinct 5-word shingles. At a similarity of 0.8 the angle of the shingle vectors is
#: acos(2 * 0.8 / 1.8), so 29.1 bits differ in the mean, with a deviation of 5.0; unrelated texts differ by 96 with a deviation of
#: 6.9. The radius, 3.8 deviations over the first and 6.9 under the second, finds candidates: the shingles decide.
STAGE = {"shingle": 5, "bits": 192, "radius": 48}
#: Least similarity of near-duplicates, as a fraction: shingles of both texts over shingles of either.
LEAST_ALIKE = (4, 5)
#: A mark of a set is the logarithm of its size, in steps of 1 / SCALE: sets alike by LEAST_ALIKE differ by GAP at most.
SCALE, GAP, CLASS = 1000, 225, 25
#: Candidates of a block, and shingles of a block in expectation: two blocks' sets meet in one task.
MEMBERS, SHINGLES = 1024, 4_000_000


@releasing
def _shingle_sets(size: int, words: int = 0):
    """Replaces the text by its set of shingles' digest, size and a fingerprint of `words` words or, with none, by the set itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), size)) for t in batch.column("_text")]
            keys = [c for c in batch.schema.names if c != "_text"]
            if words:
                texts = pa.array(["".join(f"{x:016x}" for x in fingerprint(f, words).tolist()) for f in found], pa.string())
                made = {"fingerprint": texts, "digest": pa.array([xxhash.xxh3_128_hexdigest(f.tobytes()) for f in found], pa.string()), "size": pa.array([len(f) for f in found], pa.int64())}
            else:
                made = {"shingles": pa.array([f.tobytes() for f in found], pa.binary())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *made.values()], [*keys, *made])

    return run


def exact_links(prints: np.ndarray, sets: list[np.ndarray], radius: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of shingles alike by LEAST_ALIKE at least, whose fingerprints are within the radius: a forest of their components.

    Similarity is counted, in whole numbers. Pairs that links found before already join are passed over, as are those of one label
    (whole numbers below the number of sets). With side (bool) only pairs of which one is on the side are looked at.
    """
    n, sizes, (top, bottom) = len(sets), np.array([len(s) for s in sets], np.int64), LEAST_ALIKE
    kinds, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    held = np.split(flat, np.cumsum(sizes)[:-1])
    mark, left, right = np.zeros(len(kinds), bool), [], []
    root = np.arange(n) if label is None else label.copy()
    for x in range(n - 1):
        rest = slice(x + 1, n)
        near = root[rest] != root[x]
        if side is not None and not side[x]:
            near &= side[rest]
        if not near.any():
            continue
        near &= bottom * np.minimum(sizes[rest], sizes[x]) >= top * np.maximum(sizes[rest], sizes[x])
        near &= np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=1, dtype=np.int64) <= radius
        at = np.flatnonzero(near) + x + 1
        if not len(at):
            continue
        mark[held[x]] = True
        for y in at.tolist():
            if root[y] == root[x]:
                continue
            both = int(np.count_nonzero(mark[held[y]]))
            if bottom * both >= top * int(sizes[x] + sizes[y] - both):
                root[root == root[y]] = root[x]
                left.append(x)
                right.append(y)
        mark[held[x]] = False
    return np.array(left, np.int64), np.array(right, np.int64)


def _sets(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return _numbers(rows.column("fingerprint").combine_chunks()), [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")]


LINKED = "a string, b string, g string, head boolean"


def _within(radius: int):
    """Links within a group, and (head) one member of its largest part."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        digests = rows.column("digest").combine_chunks()
        a, b = exact_links(*_sets(rows), radius)
        label = np.arange(rows.num_rows)
        node, root = forest(a, b, rows.num_rows)
        label[node] = root
        head = int(np.bincount(label).argmax())
        a, b = np.append(a, head), np.append(b, head)
        n = len(a)
        return pa.table({"a": digests.take(pa.array(a)), "b": digests.take(pa.array(b)), "g": pa.array([key[0].as_py()] * n, pa.string()), "head": pa.array([False] * (n - 1) + [True])})

    return run


def _across(radius: int):
    """Links between the members of a group that aren't in the largest part (side) and any of another part."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        digests, part = rows.column("digest").combine_chunks(), rows.column("part").combine_chunks()
        label = pa.compute.index_in(part, pa.compute.unique(part)).to_numpy().astype(np.int64)
        a, b = exact_links(*_sets(rows), radius, label, rows.column("side").to_numpy(zero_copy_only=False))
        return pa.table({"a": digests.take(pa.array(a)), "b": digests.take(pa.array(b))})

    return run


def verified(members: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between members (digest, fingerprint, shingles, g, blocks, block), whose components are those of all pairs of
    a group that are alike by LEAST_ALIKE. A group has `blocks` blocks; blocks of 1: groups may share a g.

    Members of a block are compared with each other; then one of the largest part of each block, with each other. Most
    of a group is one part by now. Each member outside its largest part is then held against all members of other parts.
    """
    one = stored(members.groupBy("g", "block").applyInArrow(_within(radius), LINKED), "links")
    large = members.where("blocks > 1")
    heads = one.where("head").select(F.col("a").alias("digest")).join(large, "digest")
    if heads.isEmpty():
        return one.select("a", "b")
    chunk = F.pmod(F.xxhash64("digest"), F.ceil(F.col("blocks") / MEMBERS)).cast("int")
    two = heads.withColumn("block", chunk).groupBy("g", "block").applyInArrow(_within(radius), LINKED)
    some = stored(one.select("a", "b").unionByName(two.select("a", "b")), "links")
    parts_ = components(some).select(F.col("node").alias("digest"), F.col("component").alias("part"))
    known = large.select("digest", "g", "blocks", "block").join(parts_, "digest", "left").withColumn("part", F.coalesce("part", "digest"))
    known = stored(known, "parts")
    sizes = known.groupBy("g", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("g").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all")).select("g", F.col("most.part").alias("most"), F.ceil((F.col("all") - F.col("most.n")) / MEMBERS).cast("int").alias("few")).where("few > 0")
    open_ = spread(known, most, "g", F.col("digest")).withColumn("side", F.col("part") != F.col("most"))
    own = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("few")).cast("int")
    meets = open_.select("digest", "part", "g", F.lit(False).alias("side"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), F.col("block").alias("j"))
    asks = open_.where("side").select("digest", "part", "g", "side", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cells = meets.unionByName(asks).join(large.select("digest", "fingerprint", "shingles"), "digest")
    three = cells.groupBy("g", "i", "j").applyInArrow(_across(radius), "a string, b string")
    return some.unionByName(three)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest id (null ids last), then by a digest of id and text.

    A group is a component of links between documents whose sets of shingles are alike by LEAST_ALIKE at least. Fingerprints
    only find candidates: the members of each of their components are held against each other by their shingles, in blocks of
    bounded size. Texts without words are one group. Of rows equal in id and text one stays. Other columns may have any names.
    """
    size, words, radius = STAGE["shingle"], STAGE["bits"] // 64, STAGE["radius"]
    key = F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), F.coalesce("text", F.lit(""))))
    rows = docs.select(F.col("doc_id").alias("i"), key.alias("k"), F.col("text").alias("_text"))
    made = rows.mapInArrow(_shingle_sets(size, words), f"i {dict(rows.dtypes)['i']}, k string, fingerprint string, digest string, size long")
    first = F.min(F.struct(F.col("i").isNull().alias("n"), F.col("i"), F.col("k"))).alias("first")
    nodes = stored(made.groupBy("digest").agg(F.min("fingerprint").alias("fingerprint"), F.min("size").alias("size"), first), "shingle-sets")
    mark = F.when(F.col("size") > 0, F.floor(F.log("size") * SCALE)).otherwise(-2 * GAP).cast("int")
    near = components(links(nodes.select(F.col("digest").alias("node"), "fingerprint", F.array(mark).alias("marks")), radius, GAP, CLASS))
    rooted = stored(nodes.join(near.withColumnRenamed("node", "digest"), "digest").select("digest", "fingerprint", "size", F.col("component").alias("root"), F.col("first.k").alias("k")), "candidates")
    groups = rooted.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("words")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("words") / SHINGLES, F.lit(1))).cast("int")
    groups = groups.withColumn("blocks", blocks)
    small = groups.agg(F.sum(F.when(F.col("blocks") == 1, F.greatest(F.col("n") / MEMBERS, F.col("words") / SHINGLES)))).first()[0] or 0
    shared = max(LEAST_BLOCKS, 2 * math.ceil(small))
    g = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(shared)).cast("string")).otherwise(F.col("root"))
    members = spread(rooted, groups.select("root", "blocks"), "root", F.col("digest")).select("k", "digest", "fingerprint", g.alias("g"), "blocks", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"))
    texts = rows.select("k", "_text").dropDuplicates(["k"]).join(members, "k").drop("k")
    sets = stored(texts.mapInArrow(_shingle_sets(size), "digest string, fingerprint string, g string, blocks int, block int, shingles binary"), "sets")
    linked = components(verified(sets, radius)).withColumnRenamed("node", "digest")
    named = nodes.join(linked, "digest", "left").groupBy(F.coalesce("component", "digest").alias("g"))
    (own,) = fresh(docs, "k")
    least = named.agg(F.min("first").alias("s")).select(F.col("s.k").alias(own))
    return docs.withColumn(own, key).dropDuplicates([own]).join(least, own, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
