"""op3: targets against the loop, the tree's draws, takes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grove.llm import mixing
from grove.llm.mixing import hypergeometric, mix, mixed, quotas, targets


def loop(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 10, 50, 1000, 20000]) for i in range(12)} | {None: 77, "é": 5}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in targets(frame).collect()}
    want = loop(sizes)
    assert found.keys() == want.keys()
    assert all(abs(found[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_hypergeometric(spark):
    us = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for total, good, drawn in [(50, 20, 25), (10, 0, 5), (10, 10, 5), (7, 3, 7), (7, 3, 0), (1, 1, 1), (0, 0, 0), (5000, 1200, 2500)]:
        got = np.array([r.x for r in us.select(hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), F.col("u")).alias("x")).collect()])
        mean = drawn * good / total if total else 0
        var = drawn * good / total * (total - good) / total * (total - drawn) / (total - 1) if total > 1 else 0
        assert got.min() >= max(0, drawn - total + good) and got.max() <= min(drawn, good)
        assert abs(got.mean() - mean) < 0.02 * (1 + mean) and abs(got.var() - var) < 0.05 * (1 + var)


def test_tree_deals_all_draws_evenly(spark):
    draws = {"a": 1000, "b": 100, "c": 7, "d": 0}
    rows = quotas(spark.createDataFrame(list(draws.items()), "source_key string, draws long"), 8).collect()
    shards = Counter()
    for s, n in draws.items():
        own = sorted((r.first, r.last, r.shard) for r in rows if r.source_key == s)
        assert [x for a, b, _ in own for x in range(a, b)] == list(range(n))
        shards += Counter({k: b - a for a, b, k in own})
    assert max(shards.values()) - min(shards.values()) <= 3 and len(shards) == 8
    assert abs(sum(r.last - r.first for r in rows if r.source_key == "a" and r.shard < 4) - 500) < 60


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / float(16**12)


def draw(total, good, drawn, u):
    """A hypergeometric number by inversion, one value after the other."""
    low, high = max(0, drawn - (total - good)), min(drawn, good)
    mean = drawn * good / total if total else 0.0
    spread = math.sqrt(drawn * (good / total) * ((total - good) / total) * ((total - drawn) / (total - 1))) * 12 if total > 1 else 0.0
    a, b = int(max(low, math.floor(mean - (spread + 12)))), int(min(high, math.ceil(mean + spread + 12)))
    weights, p = [1.0], 1.0
    for x in range(a, b):
        p = p * (good - x) * (drawn - x) / ((x + 1) * (total - good - drawn + x + 1))
        weights.append(p)
    aim, seen = u * sum(weights), 0.0
    for i, w in enumerate(weights):
        seen += w
        if not seen <= aim or i == len(weights) - 1:
            return a + i if seen > aim or i == len(weights) - 1 else a
    return a


def tree(counts, shards):
    """Draws of each source at each shard."""
    level = {1: counts}
    while len(level) < shards:
        below = {}
        for node, c in level.items():
            rest, want, left = sum(c.values()), (sum(c.values()) + 1) // 2, {}
            for i, s in enumerate(sorted(c)):
                left[s] = draw(rest, c[s], want, uniform("mix-1", node, i))
                rest, want = rest - c[s], want - left[s]
            below[2 * node], below[2 * node + 1] = left, {s: c[s] - left[s] for s in c}
        level = below
    return [level[shards + i] for i in range(shards)]


def brute(rows, block_rows, least, shards):
    """{(id, source, text): sorted takes} of all rows, a row at a time; rows are (id, text, source)."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    signed = lambda t: 42 if t is None else int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    size, docs = Counter(), Counter()
    for _, t, s in rows:
        size[s] += words(t)
        docs[s] += 1
    target, blocks = loop(dict(size)), {}
    key = {s: "n" if s is None else f"s{s}" for s in size}
    for i, t, s in rows:
        digest = hashlib.md5("|".join(["mix-1", "" if i is None else str(i), key[s], str(signed(t))]).encode()).hexdigest()
        many = max(least, -(-docs[s] // block_rows))
        blocks.setdefault((key[s], int(digest[:8], 16) * many >> 32), []).append((digest, words(t), (i, s, t)))
    goal = {key[s]: (math.floor(target[s] + 0.5), size[s]) for s in size}
    units = {}
    for (k, b), held in blocks.items():
        quota, whole = goal[k]
        if sum(n for _, n, _ in held):
            for p in range(1, quota // whole + (quota % whole > 0) + 1):
                units.setdefault(k, []).append((hashlib.md5(f"mix-1|{k}|{b}|{p}".encode()).hexdigest(), b, p))
    dealt, at, out = tree({k: len(u) for k, u in units.items()}, shards), Counter(), {}
    for k, u in units.items():
        u.sort(key=lambda x: (int(x[0][:4], 16) % mixing.LOTS, x))
        (quota, whole), upto = goal[k], 0
        full, rest = divmod(quota, whole)
        for c in dealt:
            mine = u[at[k] : at[k] + c[k]]
            at[k] += c[k]
            own = sum(sum(n for _, n, _ in blocks[k, b]) for _, b, p in mine if p > full)
            left = math.floor(rest * ((upto + own) / whole)) - math.floor(rest * (upto / whole))
            upto += own
            for _, b, p in mine:
                for _, n, row in sorted(blocks[k, b], key=lambda x: x[:2]):
                    take = n if p <= full else min(n, left)
                    left -= take if p > full else 0
                    if take:
                        out.setdefault(row, []).append(take)
    return {row: sorted(x) for row, x in out.items()}


def many_rows():
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(150)]
    return rows + [(150, None, "b"), (151, "", "empty"), (152, "big " * 4000, "d"), (None, "a b", "b"), (None, "a b c", "b"), (7, "one id and text", "a"), (7, "one id and text", "b")]


def test_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 3)
    rows = many_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    found = mix(docs, keys=("doc_id", "source", "text")).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.source, r.text): sorted(d.words for d in r.draws) for r in found if r.draws} == brute(rows, 5, 3, 16)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken = loop(dict(size)), Counter()
    for r in found:
        assert (r.size, r.source_size) == (len((r.text or "").split()), size[r.source]) and abs(r.target - target[r.source]) < 1e-6
        got = sum(d.words for d in r.draws)
        assert got <= 2 * r.size and len({d["pass"] for d in r.draws}) == len(r.draws)
        taken[r.source] += got
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size)
    partial = sum(1 for r in found for d in r.draws if d.words < r.size)
    assert partial <= 16 * len(size)
    assert len({d.shard for r in found for d in r.draws}) == 16
    text = mixed(docs)
    assert text.columns == docs.columns
    assert sum(len(r.text.split()) for r in text.collect()) == sum(taken.values())
    assert mix(docs.limit(0)).collect() == [] and mixed(docs.limit(0)).collect() == []


def test_the_order_of_rows_says_nothing(spark):
    rows = [(i % 50, "same text " * 50, ("a", "b")[i % 2], 5) for i in range(40)] + [(None, "same text " * 50, "b", 5)] * 5
    schema = "doc_id long, text string, source string, n_chars long"
    one, two = (sorted(((r.doc_id, r.source, r.text) for r in mixed(spark.createDataFrame(x, schema)).collect()), key=str) for x in (rows, rows[::-1]))
    assert one == two
    words = Counter()
    for _, s, t in one:
        words[s] += len(t.split())
    target = loop({"a": 2000, "b": 2500})
    assert all(0 <= target[s] - words[s] < 50 for s in target)  # copies take alike


def test_more_blocks_than_are_sent(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    sent = sorted(map(str, mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SENT", 0)
    assert sorted(map(str, mix(docs).collect())) == sent


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    takes = lambda: {r.doc_id: sum(d.words for d in r.draws) for r in mix(docs).collect()}
    by_tree = takes()
    monkeypatch.setattr(mixing, "quotas", lambda draws, shards: draws.select("source_key", F.lit(0).cast("long").alias("first"), F.col("draws").alias("last"), F.lit(0).cast("long").alias("shard")))
    assert takes() != by_tree


def test_shards_lie_together_in_order_of_lots(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 7), "abc"[i % 3], "x", "y") for i in range(600)], "doc_id long, text string, source string, row string, draw string")
    out = mixed(docs)
    assert {(r.row, r.draw) for r in out.collect()} == {("x", "y")}
    where = {r.doc_id: (r.p, r.n) for r in out.select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n")).collect()}
    ids = [i for i, _ in sorted(where.items(), key=lambda x: x[1])]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.6 * len(ids)
    shard = {r.doc_id: r.draws[-1].shard for r in mix(docs).collect() if len(r.draws) == 1}
    parts = {}
    for i, s in shard.items():
        parts.setdefault(s, set()).add(where[i][0])
    assert all(len(p) == 1 for p in parts.values())


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
