"""op10 against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grove.llm import _components, simhash
from grove.llm._components import components
from grove.llm.simhash import fingerprint, keep_one, near_duplicates, shingle_hashes, tile_links


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB é\n\x85\xa0É"), st.text()))
def test_fingerprint(text):
    assert int(fingerprint(shingle_hashes(text, 3))[0]) == brute_print(text)


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def clouds(rng, n, radius):
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            out.append(base)
            for _ in range(rng.randint(0, radius)):
                base ^= 1 << rng.randrange(64)
    return out[:n]


def test_tiles_lose_no_link_and_are_skipped(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(2)
    prints = sorted(set(clouds(rng, 900, 3)))
    x = np.array(prints, np.uint64).reshape(-1, 1)
    x = x[simhash._order(x)]
    a, b, done = tile_links(x, x, 2, True)
    n = len(x)
    assert done < (n // 16 + 1) * (n // 16 + 2) // 2
    node, label = simhash.forest(a, b, n)
    found = np.arange(n)
    found[node] = label
    want = brute_components([int(v) for v in x[:, 0]], 2)
    assert len({*zip(found.tolist(), want)}) == len(set(found.tolist())) == len(set(want))
    half = n // 2
    a, b, _ = tile_links(x[:half], x[half:], 2, False)
    c, d, _ = tile_links(x[:half], x[:half], 2, True)
    e, f, _ = tile_links(x[half:], x[half:], 2, True)
    node, label = simhash.forest(np.concatenate([a, c, e + half]), np.concatenate([b + half, d, f + half]), n)
    found = np.arange(n)
    found[node] = label
    assert len({*zip(found.tolist(), want)}) == len(set(found.tolist())) == len(set(want))


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(_components, "FEW", few)
    edges = [("a", "b"), ("c", "b"), ("d", "e"), ("e", "d"), ("z", "y"), ("y", "x"), ("x", "w"), ("w", "v"), ("q", "q"), *((f"h{i}", "h") for i in range(50))]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a string, b string")).collect()))
    want = {**dict.fromkeys("abc", "a"), **dict.fromkeys("de", "d"), **dict.fromkeys("vwxyz", "v"), "q": "q", "h": "h", **{f"h{i}": "h" for i in range(50)}}
    assert found == want
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_pairs_of_blocks_are_dropped_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 20)
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = random.Random(9)
    prints = sorted(set(clouds(rng, 1200, 3)))
    counts = [(bin(p >> 32).count("1"), bin(p & 0xFFFFFFFF).count("1")) for p in prints]
    classes = {c: counts.count(c) for c in set(counts)}
    found, where = simhash.bins([(c, n, list(c), list(c)) for c, n in classes.items()], 20)
    met = simhash.met_bins(found, 2)
    many = np.array([b[2] for b in found])
    assert (many @ met @ many) < 0.5 * many.sum() ** 2  # most pairs of blocks aren't made
    for a, b in itertools.combinations(classes, 2):  # and none that is needed is dropped
        assert met[where[a], where[b]] or sum(abs(x - y) for x, y in zip(a, b)) > 2
    nodes = spark.createDataFrame([(f"{p:016x}",) for p in prints], "fingerprint string").select(F.col("fingerprint").alias("node"), "fingerprint", simhash._ones(64))
    assert {(r.fingerprint, tuple(r.marks)) for r in nodes.collect()} == {(f"{p:016x}", c) for p, c in zip(prints, counts)}
    got = {r.node: r.component for r in components(simhash.links(nodes, 2, 2)).collect()}
    want = brute_components(prints, 2)
    assert [got.get(f"{p:016x}", f"{p:016x}") for p in prints] == [f"{prints[i]:016x}" for i in want]


def test_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(900, None, 1), (901, "", 1), (902, " \n", 1), (None, "A b C", 1), (903, "a b c", 1), (903, "a b c", 1), (904, "one", 1), (None, "alone in this", 1)], "doc_id long, text string, fingerprint int")
    both = docs.select("doc_id", "text").unionByName(more.drop("fingerprint"))
    rows = both.collect()
    prints = [brute_print(r.text) for r in rows]
    root = brute_components(prints, 2)
    least = {}
    for r, c in zip(rows, root):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, root)), key=str)
    assert sorted(map(tuple, near_duplicates(both).collect()), key=str) == want
    assert near_duplicates(docs.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    near = [*base[:100], "changed", *base[101:]]
    other = [rng.choice(words) for _ in range(300)]
    docs = spark.createDataFrame([(5, " ".join(base), "a"), (3, " ".join(near), "b"), (9, " ".join(base), "c"), (1, " ".join(other), "d"), (1, " ".join(other), "d"), (None, " ".join(base), "e")], "doc_id long, text string, fingerprint string")
    assert sorted(r.fingerprint for r in keep_one(docs).collect()) == ["b", "d"]
    assert keep_one(docs).columns == docs.columns
    assert keep_one(docs.limit(0)).collect() == []


def brute_sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_only_texts_alike_at_four_fifths_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 16, raising=False)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(8 if family else 60):  # shares of shingles in common from 0.5 to 1, on both sides of 0.8
            new = list(base)
            at = rng.randrange(0, 100)
            for k in range(at, at + rng.choice([0, 1, 5, 12, 16, 18, 25, 45])):
                new[k] = rng.choice(words)
            texts.append(" ".join(new))
            base = new if rng.random() < 0.5 else base
    line = "one line that is said again and again "
    texts += [line * 300 + " ".join(words[:40]), line * 300 + " ".join(words[50:90])]  # the line outweighs the rest: fingerprints of repeats are equal
    texts += ["", " \n"]
    sets = [brute_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted({find(i) for i in range(len(texts))})
    assert 20 < len(want) < len(texts) - 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == want


def test_exact_links_at_the_bound():
    whole = np.arange(9, dtype=np.uint64)
    sets = [whole, whole[:8], np.append(whole[:8], np.uint64(99)), whole[:7], np.zeros(0, np.uint64)]
    same = np.zeros((5, 3), np.uint64)
    link = lambda *at, **more: list(zip(*(x.tolist() for x in simhash.exact_links(same[: len(at)], [sets[i] for i in at], 48, **more)), strict=True))
    assert link(0, 2) == [(0, 1)]  # 8 of 10
    assert link(0, 3) == [] and link(0, 4) == []  # 7 of 9
    assert link(0, 1, 3) == [(0, 1), (1, 2)]
    assert link(0, 1, 3, side=np.array([False, False, True])) == [(1, 2)]  # pairs with one on the side
    assert link(0, 1, 3, label=np.array([0, 0, 1])) == [(1, 2)] and link(0, 1, 3, label=np.array([0, 0, 0])) == []
    far = np.array([[0, 0, 0], [2**49 - 1, 0, 0]], np.uint64)
    assert simhash.exact_links(far, [whole, whole], 48)[0].tolist() == []
