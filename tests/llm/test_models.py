"""op5 and op8: held-out quality, spans, odd rows."""

import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import xxhash

from grove.llm import language_id, toxicity
from grove.llm.language_id import UNKNOWN, Classifier, dictionaries, identify
from grove.llm.toxicity import Model, fit, learn, sentences

SF = "/root/testdata/sf0.01"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language_of_held_out_documents(spark):
    found = {r.doc_id: r for r in language_id.query(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(found) == len(docs)
    held = [d for d in docs if crc(d["doc_id"], 5) == 0]
    assert {d["doc_id"] for d in held} == {i for i, r in found.items() if r.held_out}
    assert np.mean([found[d["doc_id"]].lang_pred == d["lang"] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (None, "the and of to", "a"), (4, "the and of to " * 5000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    content = {"en": b"the and of to in the of and to be", "xx": b"lorem ipsum dolor sit amet"}
    found = {r.doc_id: (r.lang_pred, r.rejected) for r in identify(docs, content).collect()}
    assert found[1] == found[2] == found[3] == (UNKNOWN, True)
    assert found[None] == found[4] == ("en", False)
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {UNKNOWN}
    assert identify(docs.limit(0), content).collect() == []
    assert Classifier({"en": content["en"], "zz": content["en"]}).predict("the and of")[2] == 0.0  # no margin: rejected
    train = spark.createDataFrame([("t one", "en"), (None, "en"), ("  ", "en"), ("u", None), ("t one", "en")], "text string, lang string")
    assert dictionaries(train) == {"en": b"t one "}


def test_many_languages(spark, monkeypatch):
    """Stray codes take no part beyond the bound; those with the most rows are learned."""
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    rows = [(f"{w} {i}", lang) for lang, w, n in (("aa", "ja", 5), ("bb", "ne", 4), ("cc", "si", 3), ("dd", "no", 2), ("ee", "da", 3)) for i in range(n)]
    assert list(dictionaries(spark.createDataFrame(rows, "text string, lang string"))) == ["aa", "bb", "cc"]
    assert dictionaries(spark.createDataFrame([], "text string, lang string")) == {}


def test_language_against_plain_compression(spark):
    """Each document's language from sizes compressed one by one, the dictionaries too."""
    import zstandard as z

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    train = [d for d in docs if crc(d["doc_id"], 5) and d["lang"] is not None and (d["text"] or "").strip(" ")]
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    content = {}
    for lang in sorted({d["lang"] for d in train}, key=lambda x: (-sum(d["lang"] == x for d in train), x)):
        texts = sorted({d["text"] for d in train if d["lang"] == lang}, key=signed)[:128]
        cut = [t[max(0, int((len(t) - 512) / 2) - 1) :][:512] if len(t) > 512 else t[:512] for t in texts]
        content[lang] = b"".join((re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " ").encode() for t in cut)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert dictionaries(frame.where(language_id.crc_mod("doc_id", 5) != 0)) == content
    found = {r.doc_id: r for r in language_id.query(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        raw = (re.sub(r"[\W\d_]+", " ", (d["text"] or "").lower()).strip() + " ").encode()
        sizes = []
        for lang in content:
            book = z.ZstdCompressionDict(content[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=7)
            sizes.append(sum(len(z.ZstdCompressor(level=7, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False).compress(bytes(range(64)) * 2 + raw[i : i + 4096])) for i in range(0, len(raw), 4096)))
        want = list(content)[sizes.index(min(sizes))] if any(map(str.isalpha, d["text"] or "")) else UNKNOWN
        assert found[d["doc_id"]].lang_pred == want
        assert found[d["doc_id"]].held_out == (crc(d["doc_id"], 5) == 0)


def test_folds_of_null_ids(spark):
    one = spark.createDataFrame([(None,)], "doc_id long").select((language_id.crc_mod("doc_id", 5) == 0).alias("a"), (language_id.crc_mod("doc_id", 4) == 2).alias("b")).first()
    assert (one.a, one.b) == (False, False)


def test_toxicity_of_held_out_documents(spark):
    found = {r.doc_id: r for r in toxicity.query(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    held = [i for i in labels if crc(i, 4) == 2]
    assert all(found[i].held_out for i in held) and sum(r.held_out for r in found.values()) >= len(held)
    hit = sum(found[i].predicted == 1 and labels[i] == 1 for i in held)
    precision = hit / max(1, sum(found[i].predicted for i in held))
    recall = hit / sum(labels[i] for i in held)
    pos = [found[i].score for i in held if labels[i] == 1]
    neg = [found[i].score for i in held if labels[i] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    print("toxic", precision, recall, auc)
    assert precision > 0.9 and recall > 0.7 and auc > 0.85


def test_sentences_are_located():
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(f"the {i} of day. " + ("you idiot there. " if bad else "you dear there! ") + "and so on\nto be")
        labels.append(int(bad))
    model = fit(texts, labels, [1.0] * 400)
    score, found = model.score(texts[0])
    assert score > 0.9
    assert [texts[0][a:b] for a, b, p in found if p >= 0.3] == [" you idiot there"]
    assert model.score(texts[1])[0] < 0.1
    assert sentences("...") == sentences(None) == [(0, 0)]


def test_gradient():
    """One step of the fit goes down the slope of the weighed noisy-or loss, as differences give it; many steps lower it."""
    texts = ["bad x. fine y", "fine x", "bad y", "fine y. fine x. z", "z"] * 6
    labels = [1, 0, 1, 0, 0] * 6
    weights = [1.0, 2.0, 1.0, 1.0, 3.0] * 6

    def loss(model):
        p = np.array([min(max(model.score(t)[0], 1e-12), 1 - 1e-12) for t in texts])
        y, w = np.array(labels), np.array(weights) / sum(weights)
        return -(w * np.where(y == 1, np.log(p), np.log(1 - p))).sum()

    start = Model({}, -6.0)
    base, step = loss(start), 1e-5
    slope = {w: (loss(Model({w: step}, -6.0)) - base) / step for w in ("bad", "fine", "x", "y", "z")}
    first = fit(texts, labels, weights, rounds=1, l1=0.0)
    for w, s in slope.items():
        assert np.sign(first.weights[w]) == -np.sign(s), w
    far = fit(texts, labels, weights, l1=0.0)
    assert loss(far) < 0.05 < loss(first) < base
    assert far.weights["bad"] > 1 > far.weights["fine"]


def test_ids_that_repeat_are_one_in_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    taken = []
    was = toxicity.fit
    toxicity.fit = lambda texts, labels, weights: taken.append((len(texts), labels)) or Model({}, 0.0)
    try:
        learn(docs, labels)
    finally:
        toxicity.fit = was
    assert taken == [(2, [1, 0])]


def test_noisy_or():
    model = Model({"x": 2.0, "y": -1.0}, -1.0)
    p = lambda z: 1 / (1 + np.exp(-z))
    score, _ = model.score("x a. Y b! c\nx y x")
    assert abs(score - (1 - (1 - p(1.0)) * (1 - p(-2.0)) * (1 - p(-1.0)) * (1 - p(0.0)))) < 1e-12
    assert abs(model.score("")[0] - p(-1.0)) < 1e-12
    assert model.score("İ. x")[1][0][:2] == (2, 4)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x", 1), (2, "x y", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = learn(docs, labels)
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, model).collect()} == {round(1 / 3, 6)}
    assert toxicity.toxicity(docs.limit(0), model).collect() == []
