"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from grove.llm._shared import packed, releasing, stored, table, text_batches, unpacked

#: Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
TERMINALS = (".", "!", "?", "…", ":", ";", '"', "”", "»", "。", "！", "？")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_lower", "n_marks", "n_runs")
RUN = re.compile(r"[#*$%&|<>]{2,}")

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, its first place included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    seen: set = set()
    again = {w for w in windows if w in seen or seen.add(w)}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text (null: as empty)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(x.rstrip(SPACES).endswith(TERMINALS) for x in lines),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, LOWER)),
        text.count("!") + text.count("|"),
        len(RUN.findall(text)) if symbols > 1 else 0,
    )


@releasing
def _count(keep: bool):
    """Adds COUNTS of _text, in its place or (keep) beside it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "_text"):
            rows = np.array([counts(t.as_py()) for t in batch.column("_text")], np.int64).reshape(-1, len(COUNTS))
            names = [c for c in batch.schema.names if keep or c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], [*names, *COUNTS])

    return run


def _voted(rows: DataFrame, min_words: int, max_repeat: int, keep: bool = False) -> DataFrame:
    """rows (with _text or, without keep, lacking it) with COUNTS, base_failed and votes."""
    kept = StructType([f for f in rows.schema.fields if keep or f.name != "_text"] + [StructField(c, LongType()) for c in COUNTS])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return rows.mapInArrow(_count(keep), kept).select("*", failed.alias("base_failed"), F.concat(*rules().values()).alias("votes"))


def _vote(known: Column, good: Column, bad: Column) -> Column:
    return F.when(~known, "-").when(bad, "b").when(good, "g").otherwise("-")


def rules() -> dict[str, Column]:
    """Each rule's vote from the counts: g(ood), b(ad) or - (abstains)."""
    n, some = F.col("n_words"), F.col("n_words") > 0
    share = lambda x, of: F.col(x) / F.greatest(F.col(of), F.lit(1))
    letters = F.col("n_upper") + F.col("n_lower")
    upper = F.col("n_upper") / F.greatest(letters, F.lit(1))
    mean = share("word_chars", "n_words")
    return {
        "length": _vote(F.lit(True), n >= 100, n < 20),
        "word_length": _vote(some, mean.between(3, 10), (mean < 2) | (mean > 15)),
        "symbols": _vote(some, share("n_symbols", "n_words") <= 0.02, share("n_symbols", "n_words") > 0.1),
        "symbol_runs": _vote(some, share("n_runs", "n_words") <= 0.005, share("n_runs", "n_words") > 0.05),
        "lines_again": _vote(F.col("n_lines") >= 2, share("n_dup_lines", "n_lines") <= 0.2, share("n_dup_lines", "n_lines") > 0.5),
        "words_again": _vote(n >= 3, share("n_repeat_words", "n_words") <= 0.15, share("n_repeat_words", "n_words") > 0.3),
        "capitals": _vote(letters >= 10, upper <= 0.15, upper > 0.3),
        "marks": _vote(some, share("n_marks", "n_words") <= 0.05, share("n_marks", "n_words") > 0.2),
        "sentence_ends": _vote(F.col("n_lines") > 0, share("n_ended", "n_lines") >= 0.5, share("n_ended", "n_lines") < 0.05),
    }


#: How many rules() there are.
RULES = 9
#: Each vote as a number.
VOTES = {"g": 1, "b": -1, "-": 0}


def numbers(patterns: list[str]) -> np.ndarray:
    return np.array([[VOTES[c] for c in p] for p in patterns], float).reshape(len(patterns), len(patterns[0]) if patterns else RULES)


def fit(patterns: list[str], weights: list[int], *, rounds: int = 200, prior: float = 0.9) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over counted vote patterns: (share of good documents, P(g | good, votes) and P(b | bad, votes) by rule).

    The start takes rules to be wrong about one good document in a thousand and to see a quarter of the bad ones; pseudo-counts
    of that start keep each accuracy off 0 and 1, and its side of good and bad.
    """
    votes, w = numbers(patterns), np.array(weights, float)
    k = votes.shape[1]
    good, bad, share = np.full(k, 0.999), np.full(k, 0.25), prior
    for _ in range(rounds if len(patterns) else 0):
        p = posterior(votes, share, good, bad)
        a, b = w * p, w * (1 - p)
        new_good = ((votes == 1).T @ a + 9.99) / ((votes != 0).T @ a + 10)
        new_bad = ((votes == -1).T @ b + 2.5) / ((votes != 0).T @ b + 10)
        new_share = (a.sum() + 90) / (w.sum() + 100)
        moved = max(np.abs(new_good - good).max(), np.abs(new_bad - bad).max(), abs(new_share - share))
        good, bad, share = new_good, new_bad, new_share
        if moved < 1e-9:
            break
    return share, good, bad


def posterior(votes: np.ndarray, share: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """P(good | votes); abstentions say nothing."""
    odds = np.log(share / (1 - share)) + (votes == 1) @ np.log(good / (1 - bad)) + (votes == -1) @ np.log((1 - good) / bad)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _scores(voted: DataFrame) -> DataFrame:
    """(votes, quality): the posterior of each pattern of votes that occurs, 3^9 at most, by EM over those of rows that pass the base."""
    found = voted.groupBy("votes").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n")).collect()
    patterns = sorted((r.votes, r.n) for r in found)
    names = [p for p, _ in patterns]
    share, good, bad = fit(names, [n for _, n in patterns])
    values = posterior(numbers(names), share, good, bad)
    return voted.sparkSession.createDataFrame(list(zip(names, values.tolist(), strict=True)), "votes string, quality double")


def _judged(voted: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return voted.join(F.broadcast(scores), "votes").withColumn("kept", kept)


def quality(docs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """(keys, COUNTS, base_failed, votes, quality, kept), one row per row of docs.

    base_failed: under min_words words, or over max_repeat % of words in repeated 3-word windows. quality is the
    posterior probability of a good document given all votes; kept: not base_failed and quality >= threshold.
    Accuracies are estimated from the votes of all documents that pass the base. Only counts by vote pattern
    (3^9 at most) reach the driver, and as many rows are broadcast. Null texts count as empty, and fail; null
    and repeated keys stay as they are; an empty table gives an empty one. Columns of docs but the keys and the
    text are not read; the keys must not be named as a result column.
    """
    rows = docs.select(*keys, F.col(text_col).alias("_text"))
    voted = stored(_voted(rows, min_words, max_repeat), "votes")
    return _judged(voted, _scores(voted), threshold).select(*keys, *COUNTS, "base_failed", "votes", "quality", "kept")


def keep(docs: DataFrame, *, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The rows of docs that quality() keeps, as they are: repeated rows and null ids too, and whatever the other columns are called.

    Texts are counted twice, once for the rules' accuracies and once for the verdicts, so that no row needs to be found again.
    """
    scores = _scores(_voted(docs.select(F.col("text").alias("_text")), min_words, max_repeat))
    voted = _voted(packed(docs, F.col("text").alias("_text"), leave="text"), min_words, max_repeat, keep=True)
    return _judged(voted, scores, threshold).where("kept").select(*unpacked(docs, {"text": F.col("_text")}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")
