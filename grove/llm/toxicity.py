"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is (noisy-or)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm._shared import crc_mod, releasing, table

#: The bounded sample that weights are learned from: labelled documents of each class, of so many characters at most.
SAMPLE_OF_CLASS, SAMPLE_CHARS = 3000, 20_000
#: Words with a weight: in so many sampled documents at least, the most frequent so many.
LEAST_DOCS, VOCABULARY = 5, 50_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans between full stops, exclamation and question marks and line ends that hold a word; one empty span if there is none."""
    return [m.span() for m in SENTENCE.finditer(text or "") if WORD.search(text, *m.span())] or [(0, 0)]


def bag(text: str | None, span: tuple[int, int]) -> list[str]:
    """Distinct words of a sentence in lower case, in order."""
    return list(dict.fromkeys(WORD.findall((text or "")[span[0] : span[1]].lower())))


class Model:
    """A weight for each word, and a bias: the logit of a sentence is the bias plus its distinct words' weights."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and (start, end, probability) of each sentence that holds a weighted word."""
        spans = sentences(text)
        rest, found = len(spans), []
        low = text.lower() if text else ""
        if len(low) != len(text or ""):  # a character that grows in lower case moves the spans
            low = None
        for a, b in spans:
            words = set(WORD.findall(low[a:b])) if low is not None else set(bag(text, (a, b)))
            hits = self.weights.keys() & words
            if hits:
                rest -= 1
                z = self.bias + sum(self.weights[w] for w in sorted(hits))
                found.append((a, b, float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))))
        none = rest * np.log1p(np.exp(self.bias))
        clean = -none + sum(np.log1p(-min(p, 1 - 1e-15)) for _, _, p in found)
        return float(-np.expm1(clean)), found


def fit(texts: list[str | None], labels: list[int], weights: list[float], *, rounds: int = 250, l1: float = 1e-5, rate: float = 0.15) -> Model:
    """Weights and bias that minimise the noisy-or log loss: proximal Adam over all sampled documents at once."""
    seen = Counter(w for t in texts for w in {w for s in sentences(t) for w in bag(t, s)})
    words = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= LEAST_DOCS]
    place = {w: i for i, w in enumerate(words)}
    rows, doc_of = [], []
    for n, t in enumerate(texts):
        for s in sentences(t):
            rows.append([place[w] for w in bag(t, s) if w in place])
            doc_of.append(n)
    doc_of = np.array(doc_of, np.int64)
    sentence_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([i for r in rows for i in r], np.int64)
    y, share = np.array(labels), np.array(weights) / np.sum(weights)
    w, bias = np.zeros(len(words)), -6.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence_of, w[at], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc_of, -np.log1p(np.exp(np.clip(z, -30, 30))), len(texts)))
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * share
        g = pull[doc_of] * p
        grad = np.append(np.bincount(at, g[sentence_of], len(words)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        scale = rate / (np.sqrt(v[:-1] / (1 - 0.99**step)) + 1e-6)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * scale)
    return Model({x: float(w[i]) for x, i in place.items() if w[i]}, float(bias))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample of labelled documents, weighted to the classes' true shares.

    The sample is of ids with the smallest hashes, SAMPLE_OF_CLASS of each class at most; documents over SAMPLE_CHARS are
    passed over. Null labels and ids are. An id labelled twice counts as toxic if either label says so, and of an id's texts
    the one with the smallest hash is taken. With one class alone or none, the model is its (smoothed) share.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_OF_CLASS) for y in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))
    given = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    # One text of each id, however often it repeats: no more rows than are chosen reach the driver.
    rows = given.join(chosen, "i").groupBy("i", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.col("t"))).alias("s")).select("i", "y", "s.t").collect()
    rows.sort(key=lambda r: (r.i, r.t, r.y))
    count = Counter(r.y for r in rows)
    if len(count) < 2:
        share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
        return Model({}, float(np.log(share / (1 - share))))
    return fit([r.t for r in rows], [r.y for r in rows], [total[r.y] / count[r.y] for r in rows])


@releasing
def _score(model: Model, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column("_text")]
            keys = [c for c in batch.schema.names if c != "_text"]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in f[1] if p >= least] for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array([f[0] for f in found], pa.float64()), pa.array(spans, pa.list_(span))], [*keys, "score", "sentences"])

    return run


def toxicity(docs: DataFrame, model: Model, *, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(keys, score, sentences, predicted), one row per row of docs, over whole texts.

    score is the noisy-or of all sentences' probabilities; sentences lists (start, end, score) in characters of those at or over
    the threshold; predicted is 1 where the score is. A null or empty text is one sentence without words. Null and repeated keys
    stay, and must not be named as a result column; other columns are not read. The model, of VOCABULARY weights at most, goes to each task.
    """
    rows = docs.select(*keys, F.col(text_col).alias("_text"))
    types = dict(rows.dtypes)
    out = rows.mapInArrow(_score(model, threshold), ", ".join([*(f"`{k}` {types[k]}" for k in keys), "score double", "sentences array<struct<start: int, end: int, score: double>>"]))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of documents whose crc32(id) mod 4 is not 2. sentences: where the offending ones are."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(crc_mod("doc_id", 4) != 2))
    return toxicity(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "sentences")
