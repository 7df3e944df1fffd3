"""op2 against brute force: stretches of words that occur twice."""

import random
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from grove.llm import suffix_dedup
from grove.llm.suffix_dedup import CONTENTS, agreement, reached, remove_repeats, repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least):
    seen = {}
    for d, text in sorted(docs.items()):
        w = WORDS.findall(text or "")
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((d, i))
    repeated, later = {}, {}
    for places in seen.values():
        if len(places) > 1:
            for n, (d, i) in enumerate(places):
                repeated.setdefault(d, set()).update(range(i, i + least))
                if n:
                    later.setdefault(d, set()).update(range(i, i + least))
    return repeated, later


def covered(spans):
    out = [i for s in spans for i in range(s.start, s.end)]
    assert len(out) == len(set(out))
    return set(out)


def check(spark, docs, least, k):
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs.items()], "doc_id long, text string, anchor int")
    found = repeats(frame, least=least, k=k).collect()
    repeated, later = brute(docs, least)
    assert {r.id: covered(r.repeated) for r in found} == repeated
    assert {r.id: covered(r.removable) for r in found if r.removable} == later


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_small_alphabets(spark, data):
    texts = data.draw(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "cé"]), max_size=60).map(" ".join)), min_size=1, max_size=8))
    check(spark, dict(enumerate(texts)), 8, 3)


def test_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 60, 120, 300)]
    docs = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += words(rng.randint(0, 80))
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            parts += p if rng.random() < 0.5 else p[a:b]
        docs[i] = rng.choice([" ", "\n", " \t\r\n "]).join(parts)
    docs |= {60: docs[3], 61: docs[3], 62: " ".join(["the"] * 400), 63: " ".join(["on", "off"] * 90), 64: "", 65: None, 66: " ".join(words(20000))}
    check(spark, docs, 50, 10)


def test_removal(spark):
    rng = random.Random(6)
    words = lambda n: [f"{rng.random()}" for _ in range(n)]
    p, a, b, c = words(70), words(60), words(90), words(55)
    rows = [(2, "\n".join(a + p), "x", 1), (1, " ".join(p + b), "y", 1), (3, " ".join(c), "z", 1), (4, " " + " ".join(c) + "\n", "gone", 1), (None, " ".join(p), "first", 1), (5, None, "null", 1), (6, "", "empty", 1), (3, " ".join(c), "twin", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, later string, n_chars long")
    left = {r.later: r for r in remove_repeats(docs).collect()}
    assert set(left) == {"x", "y", "z", "first", "null", "empty", "twin"}
    assert left["x"].text.split() == a
    assert left["y"].text == " ".join(b)
    assert left["z"].text == left["twin"].text == " ".join(c)
    assert left["first"].text == " ".join(p) and left["null"].text is None
    assert left["y"].n_chars == len(left["y"].text)
    assert remove_repeats(docs).columns == docs.columns
    assert remove_repeats(docs.limit(0)).collect() == []


def test_null_ids_tell_texts_apart(spark):
    """Texts without id, of which many once shared a key."""
    rng = random.Random(11)
    p = [f"p{i}" for i in range(60)]
    rows = [(None, " ".join([f"{rng.random()}" for _ in range(20)] + p + [f"{i}"]), i) for i in range(36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = repeats(docs).collect()
    assert len(found) == 36 == len({(r.key, r.th) for r in found}) and {r.id for r in found} == {None}
    left = {r.n: r.text.split() for r in remove_repeats(docs).collect()}
    want = {n: t.split() for _, t, n in rows}
    whole = [n for n in want if left[n] == want[n]]
    assert len(whole) == 1 and all(left[n] == want[n][:20] + want[n][80:] for n in want if n not in whole)


def test_columns_may_have_any_names(spark):
    names = ["_text", "_spans", "key", "th", "row", "cut", "id", "_i"]
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, *names), (2, f"x {text} y", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, text, *names), (2, "x y", *names)]


def test_agreement():
    w = lambda *x: np.array(x, ">u8").tobytes()
    rows = [w(1, 2, 3), w(1, 2), w(1, 2, 4), w(), w(9), w(9)]
    assert agreement(np.array([1, 1, 1, 1, 1, 2]), rows).tolist() == [2, 2, 0, 0, -1]
    assert agreement(np.array([1]), [w(1)]).tolist() == [] and agreement(np.array([3, 3]), [w(), w()]).tolist() == [0]


def test_neighbours_are_compared_over_the_borders_of_partitions(spark):
    """Each row's longest agreement with any other of its anchor, however the sorted rows are cut to partitions and batches."""
    rng = random.Random(12)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, 0, 0, 1, np.array([rng.randrange(3) for _ in range(rng.randint(0, 8))], ">u8").tobytes(), b"") for i in range(400)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    words = {r[1]: np.frombuffer(r[5], ">u8").tolist() for r in rows}
    want = {r[1]: max((common(words[r[1]], words[q[1]]) for q in rows if q[0] == r[0] and q[1] != r[1]), default=-1) for r in rows}
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for parts, batch in ((1, 7), (60, 10000), (300, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = reached(spark.createDataFrame(rows, CONTENTS), "to_right", "right").collect()
            assert {r.id: r.right for r in found} == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_only_stretches_within_both_agreements_are_looked_at(spark):
    """Lines that share an anchor and little else give none."""
    rng = random.Random(13)
    line = [f"l{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join([f"{rng.random()}" for _ in range(60)] + line + [f"{rng.random()}" for _ in range(60)])) for i in range(40)], "doc_id long, text string")
    seen = []
    kept = suffix_dedup._stretches

    def count(least, k):
        inner = kept(least, k)

        def run(batches):
            for b in inner(batches):
                raise AssertionError("a stretch")
            yield from ()

        seen.append(1)
        return run

    suffix_dedup._stretches = count
    try:
        assert repeats(docs).collect() == [] and seen
    finally:
        suffix_dedup._stretches = kept
