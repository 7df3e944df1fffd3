"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions alone.

A source's documents are cut to blocks of bounded size by a digest. Each pass over a source draws its blocks; the last pass, which
takes only a part of the source's words, is shared among its blocks too. The tree splits the exact numbers of draws, all sources
together, among the output shards: at each node they are halved without replacement. A shard's quota of a source then is that
many places of the source's permuted draws, so that shards draw disjoint blocks. What a shard takes of a last pass is its own blocks'
share of it, block after block in their permuted order: the tree thus decides which documents are taken, and where they go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.llm._shared import WORD, packed, spread, stored, table, unpacked

#: Weights of the sources in order of their names, repeating, and the share of all words that the mix takes.
WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2
#: Documents of a source's average block, and blocks of a source at least; output shards at least, a power of two, and rows of a shard
#: at most, on the average.
BLOCK_ROWS, LEAST_BLOCKS, SHARDS, SHARD_ROWS = 256, 64, 16, 32_768
#: Ranges that a source's permuted draws are ranked in; blocks whose draws are sent to all tasks (50 MB or so), more are joined.
LOTS, MOST_SENT = 256, 200_000
SEED = "mix-1"
#: Deviations of the hypergeometric distribution that are looked at: what is beyond has a probability below 1e-30.
DEVIATIONS = 12


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(12)), 16, 10).cast("double") / float(16**12)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): shares by weight of SHARE of all sizes, none over
    MOST_TIMES its source's size; what is over is shared again by weight among the others until none is.

    That ends where one level times the weight, or else the cap, is each target. With sources in order of cap / weight the
    level is the first at which a source stays under its cap when all before it are at theirs.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = F.col("source_size") * MOST_TIMES
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(everything) - before) / rest
    leveled = rows.withColumn("level", level).withColumn("under", F.col("level") * F.col("weight") < F.col("cap"))
    first = F.min(F.when(F.col("under"), F.struct("ratio", F.col("source").isNull(), F.col("source"), "level"))).over(everything)["level"]
    target = F.least(F.coalesce(first * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `good` things among `total` are drawn in `drawn` draws without replacement, by inversion of u.

    Probabilities are summed relative to that of the least number looked at, which is DEVIATIONS under the mean or the
    least possible.
    """
    n, k, d = (c.cast("double") for c in (total, good, drawn))
    low, high = F.greatest(F.lit(0.0), d - (n - k)), F.least(d, k)
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    spread = F.when(n > 1, F.sqrt(d * (k / n) * ((n - k) / n) * ((n - d) / (n - 1)))).otherwise(0.0) * DEVIATIONS + DEVIATIONS
    a = F.greatest(low, F.floor(mean - spread).cast("double")).cast("long")
    b = F.least(high, F.ceil(mean + spread).cast("double")).cast("long")
    steps = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def after(p: Column, x: Column) -> Column:
        return p * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    def add(s: Column, x: Column) -> Column:
        p = after(s["p"], x)
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"))

    one = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
    aim = u * F.aggregate(steps, one, add)["sum"]

    def seek(s: Column, x: Column) -> Column:
        p = after(s["p"], x)
        passed = s["sum"] > s["aim"]
        return F.struct(p.alias("p"), F.when(passed, s["sum"]).otherwise(s["sum"] + p).alias("sum"), F.when(passed, s["at"]).otherwise(x + 1).alias("at"), s["aim"].alias("aim"))

    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), a.alias("at"), aim.alias("aim"))
    return F.aggregate(steps, start, seek)["at"]


def split(counts: Column, drawn: Column, salt: Column) -> Column:
    """A draw of `drawn` things from classes of these counts (array<long>), as counts: source by source, given those before."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def step(s: Column, c: Column) -> Column:
        got = hypergeometric(s["total"], c, s["drawn"], uniform(SEED, salt, F.size(s["out"])))
        return F.struct((s["total"] - c).alias("total"), (s["drawn"] - got).alias("drawn"), F.concat(s["out"], F.array(got)).alias("out"))

    start = F.struct(total.alias("total"), drawn.cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(counts, start, step)["out"]


def shards_for(rows: int) -> int:
    """The least power of two of shards, SHARDS at least, that have SHARD_ROWS rows at most on the average."""
    n = SHARDS
    while n * SHARD_ROWS < rows:
        n *= 2
    return n


def quotas(draws: DataFrame, shards: int) -> DataFrame:
    """(source_key, first, last, shard): places of each source's permuted draws that go to each shard, from (source_key, draws).

    The tree halves the shards; at each node the draws, all sources together, are halved without replacement, so that
    shards hold as many draws within one and a source's part of each is what a draw by lot would give. A node has a number for each
    source; nodes are written to the shared folder every few levels.
    """
    entries = F.array_sort(F.collect_list(F.struct("source_key", "draws")))
    node = draws.agg(entries.alias("e")).select(F.lit(1).cast("long").alias("node"), F.col("e.source_key").alias("keys"), F.col("e.draws").alias("counts"))
    for level in range(shards.bit_length() - 1):
        half = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        left = node.withColumn("left", split(F.col("counts"), F.floor((half + 1) / 2), F.col("node")))
        right = F.zip_with("counts", "left", lambda x, y: x - y)
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))
        node = left.select("keys", F.explode(sides).alias("s")).select("keys", F.col("s.node").alias("node"), F.col("s.counts").alias("counts"))
        if level % 4 == 3 and level < shards.bit_length() - 2:
            node = stored(node, "nodes")
    leaf = node.select((F.col("node") - shards).alias("shard"), F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("shard", F.col("x.keys").alias("source_key"), F.col("x.counts").alias("n"))
    last = F.sum("n").over(Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return leaf.select("source_key", "shard", (last - F.col("n")).alias("first"), last.alias("last")).where("last > first")


def ranked(units: DataFrame) -> DataFrame:
    """units (source_key, lot, ...) with rank: places from 0 in order of lot, a digest, within each source.

    Ranges of lots are ranked on their own, and begin where the counts of those before end: no task has all of a source.
    """
    ranged = units.withColumn("part", F.conv(F.substr("lot", F.lit(1), F.lit(4)), 16, 10).cast("int") % LOTS)
    sizes = ranged.groupBy("source_key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = sizes.select("source_key", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("source_key", "part").orderBy("lot", "block", "pass")) - 1
    return ranged.withColumn("own", own).join(starts, ["source_key", "part"]).withColumn("rank", (F.col("before") + F.col("own")).cast("long")).drop("before", "own", "part")


def _placed(ident: str, source_col: str, text_col: str) -> tuple[Column, Column]:
    """(source_key, digest): what places a document. The digest is of id, source and text."""
    source = F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n"))
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(ident).cast("string"), F.lit("")), source, F.xxhash64(text_col).cast("string")))
    return source.alias("source_key"), digest.alias("digest")


def _sized(docs: DataFrame, ident: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """(more, source, source_key, size, digest)."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*more, F.col(source_col).alias("source"), size.alias("size"), *_placed(ident, source_col, text_col))


def _blocks(sized: DataFrame, sums: DataFrame) -> DataFrame:
    """sized with each document's block of its source: a range of digests."""
    place = F.conv(F.substr("digest", F.lit(1), F.lit(8)), 16, 10).cast("long")
    met = spread(sized, sums.select("source_key", "blocks"), "source_key", F.col("digest"))
    return met.withColumn("block", F.shiftright(place * F.col("blocks"), 32)).drop("blocks")


def plan(sized: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(sums, drawn, shards): each source's (source_key, blocks, ...), and each block's draws, (source_key, block, source_size, target, at) with at an
    array of (pass, shard, cut, words): cut null takes all of the block's documents, else those of smaller digests, and `words` of each with this one.
    """
    per_source = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.count("*") / BLOCK_ROWS)).cast("long")
    sums = stored(sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"), F.count("*").alias("docs"), per_source.alias("blocks")), "sources")
    aims = stored(targets(sums.select("source", "source_size")).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"), "source_size", "target"), "targets")
    blocks = stored(_blocks(sized, sums).groupBy("source_key", "block").agg(F.sum("size").alias("words")), "blocks")
    quota = F.floor(F.col("target") + 0.5)
    full = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    aims = aims.withColumn("full", full).withColumn("rest", quota - F.col("full") * F.col("source_size"))
    known = spread(blocks, aims, "source_key", F.col("block"))
    passes = F.when(F.col("words") > 0, F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(0)
    lot = F.md5(F.concat_ws("|", F.lit(SEED), "source_key", F.col("block").cast("string"), F.col("pass").cast("string")))
    units = known.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    units = stored(ranked(units.withColumn("lot", lot)), "units")
    draws = stored(units.groupBy("source_key").agg(F.count("*").alias("draws")), "draws")
    if shards is None:
        shards = shards_for(round(SHARE * (sums.agg(F.sum("docs")).first()[0] or 0)))
    dealt = quotas(draws, shards)
    slices = dealt.select("source_key", "shard", F.explode(F.sequence("first", F.col("last") - 1)).alias("rank"))
    placed = stored(units.join(slices, ["source_key", "rank"]), "placed")
    # The last pass: a shard's part of the words is that of its blocks, and goes to them in order of rank.
    partial = placed.where(F.col("pass") > F.col("full"))
    parts = partial.groupBy("source_key", "shard").agg(F.sum("words").alias("own"), F.first("rest").alias("rest"), F.first("source_size").alias("source_size"))
    up_to = F.sum("own").over(Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda x: F.floor(F.col("rest") * (x / F.col("source_size")))
    parts = parts.withColumn("up_to", up_to).select("source_key", "shard", (share(F.col("up_to")) - share(F.col("up_to") - F.col("own"))).alias("part"))
    before = F.sum("words").over(Window.partitionBy("source_key", "shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    own = partial.withColumn("before", before).join(parts, ["source_key", "shard"])
    own = own.withColumn("take", F.least(F.greatest(F.col("part") - F.col("before"), F.lit(0)), F.col("words"))).where("take > 0")
    own = stored(own.select("source_key", "block", "pass", "shard", "words", "take"), "last-passes")
    # Where a block is cut, one a shard and source at most: at the digest up to which its words are taken.
    cuts = own.where("take < words").select("source_key", "block", "take")
    alike = _blocks(sized, sums).join(cuts, ["source_key", "block"]).groupBy("source_key", "block", "take", "digest").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    so_far = F.sum("size").over(Window.partitionBy("source_key", "block").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    left = F.col("take") - so_far
    cut = alike.withColumn("left", left).where("left >= 0 and left < size").select("source_key", "block", F.col("digest").alias("cut"), F.floor(F.col("left") / F.col("n")).alias("least"))
    entry = lambda cut, words: F.struct("pass", "shard", cut.alias("cut"), words.alias("words")).alias("x")
    last = own.join(cut, ["source_key", "block"], "left").select("source_key", "block", entry(F.col("cut"), F.col("least")))
    whole = placed.where(F.col("pass") <= F.col("full")).select("source_key", "block", entry(F.lit(None).cast("string"), F.lit(None).cast("long")))
    at = whole.unionByName(last).groupBy("source_key", "block").agg(F.array_sort(F.collect_list("x")).alias("at"))
    return sums, stored(known.select("source_key", "block", "source_size", "target").join(at, ["source_key", "block"], "left"), "drawn"), shards


def _draws(placed: DataFrame, sums: DataFrame, drawn: DataFrame, words: Column) -> DataFrame:
    """placed (source_key, digest, ...) with source_size, target and draws; words: of a document that is taken whole."""
    rows = _blocks(placed, sums)
    met = rows.join(F.broadcast(drawn) if drawn.count() <= MOST_SENT else drawn, ["source_key", "block"])
    taken = lambda x: F.when(x["cut"].isNull() | (F.col("digest") < x["cut"]), words).when(F.col("digest") == x["cut"], x["words"]).otherwise(0)
    slot = lambda x: F.md5(F.concat_ws("|", F.lit(SEED), F.col("digest"), x["shard"].cast("string"), x["pass"].cast("string")))
    none = F.array().cast("array<struct<pass: bigint, shard: bigint, cut: string, words: bigint>>")
    draws = F.transform(F.coalesce("at", none), lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), slot(x).alias("slot"), taken(x).alias("words")))
    return met.withColumn("draws", F.filter(draws, lambda x: x["words"] > 0))


def _checked(shards: int | None) -> None:
    if shards is not None and (shards < 1 or shards & (shards - 1)):
        raise ValueError("shards must be a power of two")


def mix(docs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), source_col: str = "source", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(keys, size, source_size, target, draws), one row per row of docs; the first key is the id.

    size is the text's number of words (null: 0). draws is an array of (pass, shard, slot, words): a pass takes all
    words of a document or, in the last block that a shard takes of a last pass, the first so many. slot orders a shard's draws by lot.
    shards: a power of two (None: by the number of draws). Reruns agree, whatever the order of rows.

    Null sources are one source, the last. Rows alike in id, source and text take alike (the fewer words, where they can't). Sources
    without words have target 0. An empty table gives an empty one. Other columns are not read.
    """
    _checked(shards)
    # Texts are read once: what follows goes by stored sizes.
    sized = stored(_sized(docs, keys[0], source_col, text_col, F.struct(*keys).alias("row")), "sizes")
    sums, drawn, _ = plan(sized, shards)
    return _draws(sized, sums, drawn, F.col("size")).select("row.*", "size", "source_size", "target", "draws")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken is over all draws; shards has the words that each shard takes of the document."""
    out = mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    shards = F.transform("draws", lambda x: F.struct(x["shard"].alias("shard"), x["words"].alias("words")))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def mixed(docs: DataFrame, *, shards: int | None = None) -> DataFrame:
    """docs as the mix takes them: a row per draw, whose text is the whole or, where a shard's part of its source ends, the words drawn.

    Documents that aren't drawn go, and those drawn twice come twice; all columns stay, n_chars follows the text. A shard's rows
    lie in one partition, shuffled by lot. Texts are read twice: for the sizes, and to be dealt to their shards,
    so that no row needs to be found again; rows that share id and text are as any others. Other columns may have any names.
    """
    _checked(shards)
    sums, drawn, shards = plan(stored(_sized(docs, "doc_id", "source", "text"), "sizes"), shards)
    rows = packed(docs, F.col("text"), *_placed("doc_id", "source", "text"), leave="text").where(F.col("text").rlike(WORD))
    all_ = F.lit(2**62)
    out = _draws(rows, sums, drawn, all_).select("row", "text", F.explode("draws").alias("draw"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") < all_, cut).otherwise(F.col("text"))
    out = out.select("row", text.alias("text"), "draw").repartitionById(shards, F.col("draw.shard").cast("int")).sortWithinPartitions("draw.shard", "draw.slot")
    return out.select(*unpacked(docs, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))
