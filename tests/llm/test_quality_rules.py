"""op6: counts against brute force, EM against planted accuracies, verdicts against labels."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from grove.llm.quality_rules import counts, fit, keep, posterior, quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n#"), st.text(alphabet="é| \t\n\r\x0b\x85\xa0x$")))
def test_counts(text):
    assert counts(text)[:5] == brute(text)


def test_em_finds_accuracies():
    rng = random.Random(5)
    true_good, true_bad = [0.97, 0.9, 0.99, 0.95], [0.9, 0.6, 0.4, 0.8]
    rows = []
    for _ in range(40000):
        y = rng.random() < 0.8
        rows.append((y, "".join("-" if rng.random() < 0.2 else ("g" if (rng.random() < g) == y or (not y and rng.random() >= b) else "b") if y else ("b" if rng.random() < b else "g") for g, b in zip(true_good, true_bad))))
    names = sorted({p for _, p in rows})
    n = [sum(1 for _, p in rows if p == x) for x in names]
    share, good, bad = fit(names, n)
    assert abs(share - 0.8) < 0.03
    assert np.abs(good - [0.97, 0.9, 0.99, 0.95]).max() < 0.03
    assert np.abs(bad - true_bad).max() < 0.05
    p = dict(zip(names, posterior(np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in x] for x in names], float), share, good, bad)))
    assert np.mean([(p[x] >= 0.5) == y for y, x in rows]) > 0.9


def test_no_votes():
    share, good, bad = fit([], [])
    assert 0 < share < 1 and len(good) == len(bad) == 9


def test_odd_rows(spark):
    text = "Words that come once make sentences, as these lines do. " + " ".join(f"w{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, text, "a"), (1, None, "b"), (None, text, "c"), (2, "", "d"), (3, "x " * 500, "e"), (1, text, "f")], "doc_id long, text string, votes string")
    found = quality(docs.drop("votes"))
    assert found.count() == 6
    assert sorted((r.n_words, r.base_failed, r.kept) for r in found.collect()) == [(0, True, False), (0, True, False), (70, False, True), (70, False, True), (70, False, True), (500, True, False)]
    assert sorted(r.votes for r in keep(docs).collect()) == ["a", "c", "f"]
    assert keep(docs).columns == docs.columns
    assert keep(docs.limit(0)).collect() == []


def test_columns_may_have_any_names(spark):
    text = " ".join(f"Word{i} says{i} some{i} thing{i}." for i in range(30))
    names = ["_key", "_hash", "_id", "_text", "row", "votes", "n_words", "kept", "quality"]
    docs = spark.createDataFrame([(1, text, *names), (1, "short", *names), (None, text, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = keep(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, text, *names), (None, text, *names)], key=str)


def slow_em(patterns, weights):
    """The same estimates, a document and a rule at a time."""
    docs = [p for p, n in zip(patterns, weights) for _ in range(n)]
    k = len(patterns[0])
    good, bad, share = [0.999] * k, [0.25] * k, 0.9
    for _ in range(200):
        p = []
        for d in docs:
            yes, no = share, 1 - share
            for i, c in enumerate(d):
                if c == "g":
                    yes, no = yes * good[i], no * (1 - bad[i])
                elif c == "b":
                    yes, no = yes * (1 - good[i]), no * bad[i]
            p.append(yes / (yes + no))
        good, old = [(sum(x for x, d in zip(p, docs) if d[i] == "g") + 9.99) / (sum(x for x, d in zip(p, docs) if d[i] != "-") + 10) for i in range(k)], good
        bad = [(sum(1 - x for x, d in zip(p, docs) if d[i] == "b") + 2.5) / (sum(1 - x for x, d in zip(p, docs) if d[i] != "-") + 10) for i in range(k)]
        share = (sum(p) + 90) / (len(docs) + 100)
        if max(abs(a - b) for a, b in zip(good, old)) < 1e-12:
            break
    return share, good, bad


def test_verdicts_against_a_slow_fit(spark):
    rows = quality(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    able = [r.votes for r in rows if not r.base_failed]
    names = sorted(set(able))
    share, good, bad = slow_em(names, [able.count(n) for n in names])
    for r in rows:
        yes, no = share, 1 - share
        for i, c in enumerate(r.votes):
            yes, no = (yes * good[i], no * (1 - bad[i])) if c == "g" else (yes * (1 - good[i]), no * bad[i]) if c == "b" else (yes, no)
        assert abs(r.quality - yes / (yes + no)) < 1e-4
        assert r.kept == (not r.base_failed and yes / (yes + no) >= 0.5)


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").select("kept", "label").collect()
    good, bad = [r.kept for r in rows if r.label == 1], [r.kept for r in rows if r.label == 0]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.3
