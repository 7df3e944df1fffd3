"""op1 against brute force."""

import math
import random

import numpy as np

from grove.llm import topk_search
from grove.llm.topk_search import merge, products, top_k


def brute(rows, asked, k, scale=256):
    fit = lambda r: r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    q = lambda v: [math.floor(scale * x) for x in v]
    out = []
    for a in filter(fit, asked):
        hits = sorted((-sum(x * y for x, y in zip(q(a[1]), q(b[1]))), b[0]) for b in filter(fit, rows) if b[0] != a[0] and len(a[1]) == len(b[1]))
        out += [(a[0], i + 1, v, -s) for i, (s, v) in enumerate(hits[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 40)
    monkeypatch.setattr(topk_search, "BLOCK", 7)
    monkeypatch.setattr(topk_search, "FAN", 3)
    rng = random.Random(1)
    rows = [(i, [float(rng.choice([-0.5, 0.25, 0.1, 1e-3])) for _ in range(3)]) for i in range(400)]  # many ties
    rows += [(400, None), (401, [1.0, None, 2.0]), (402, [float("nan"), 1.0, 1.0]), (403, [float("inf"), 1.0, 1.0]), (404, [1.0]), (406, []), (None, [1.0, 1.0, 1.0]), (405, [1.0]), (7, rows[7][1]), (8, rows[9][1])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    f32 = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    asked = [r for r in f32 if r[0] is not None and r[0] % 20 == 0]
    found = sorted(map(tuple, top_k(docs, docs.where("vec_id % 20 = 0")).collect()))
    assert found == brute(f32, asked, 5)


def test_fewer_candidates_than_k_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    found = sorted(map(tuple, top_k(docs, docs.where("vec_id = 0")).collect()))
    assert found == [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512)]
    assert top_k(docs.limit(0), docs).collect() == []
    assert top_k(docs, docs.limit(0)).collect() == []


def test_queries_that_share_an_id_have_a_list_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, top_k(docs, docs.where("vec_id = 1").union(docs.where("vec_id = 1")), 2).collect()))
    assert found == brute(rows, [r for r in rows if r[0] == 1], 2)


def test_copies_and_long_vectors(spark):
    rows = [(5, [0.5] * 2000)] * 30 + [(6, [0.5] * 2000), (20, [1.0] * 2000)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(docs, docs.where("vec_id = 20")).collect())) == brute(rows, [rows[-1]], 5)


def test_large_numbers_stay_whole():
    q, rows = np.array([[2**40 + 1, 3]]), np.array([[2**20 + 1, 5], [7, -1]])
    assert products(q, rows).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, (2**40 + 1) * 7 - 3]]


def test_merge_breaks_ties_by_id():
    ids, scores = merge(np.arange(100)[::-1].copy(), np.zeros(100, np.int64), 5)
    assert ids.tolist() == [0, 1, 2, 3, 4]
