"""Language by compression: the dictionary of its language makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.llm._shared import crc_mod, releasing, table

#: The bounded sample that dictionaries are made of: texts of each language, and characters of each, from its middle.
SAMPLE_TEXTS, SAMPLE_CHARS = 128, 512
#: Languages that are learned at most, those with the most rows: what the driver gathers and each task is sent is bounded by this and the sample.
MOST_LANGUAGES, SALTS = 1000, 32
#: Texts are compressed in stretches of so many bytes, as in longer ones the text itself takes the dictionary's place.
STRETCH = 4096
#: The level that all texts are compressed at.
LEVEL = 7
#: Goes before each stretch: bytes that no dictionary holds, without which a short stretch is stored as it is, whatever the dictionary.
PAD = bytes(range(64)) * 2
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, without digits and signs."""
    return f"{NO_LETTERS.sub(' ', text.lower()).strip()} ".encode()


def dictionaries(train: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> dict[str, bytes]:
    """Raw content for each language: excerpts of SAMPLE_TEXTS distinct texts, those with the smallest hashes of the text.

    Languages are in order of their rows, the most first, then of code points; of more than MOST_LANGUAGES the first are learned. Rows
    without language or text teach nothing.
    """
    rows = train.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    learned = [r.l for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES).collect()]
    if not learned:
        return {}
    names = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in learned], "l string"))
    least = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= SAMPLE_TEXTS).drop("r")
    # The smallest of a language are among the smallest of its parts, each of which is one task's.
    hashes = rows.join(names, "l", "left_semi").select("l", "h").distinct().withColumn("part", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    chosen = least(least(hashes, "l", "part").drop("part"), "l").limit(MOST_LANGUAGES * SAMPLE_TEXTS)
    start = F.greatest(F.lit(1), ((F.length("t") - SAMPLE_CHARS) / 2).cast("int"))
    parts = rows.join(F.broadcast(chosen), ["l", "h"]).select("l", "h", F.substr("t", start, F.lit(SAMPLE_CHARS)).alias("t")).groupBy("l", "h").agg(F.min("t").alias("t"))
    out: dict[str, list] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.l, r.h)):
        out.setdefault(r.l, []).append(r.t)
    return {lang: b"".join(map(letters, out[lang])) for lang in learned if lang in out}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard as z

        self.languages, self.packers = list(content), []
        for lang in self.languages:
            d = z.ZstdCompressionDict(content[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> np.ndarray:
        """Bytes of the whole text under each language's dictionary."""
        total = np.zeros(len(self.languages), np.int64)
        for i in range(0, len(raw), STRETCH):
            part = PAD + raw[i : i + STRETCH]
            total += [len(c.compress(part)) for c in self.packers]
        return total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): margin is how much larger the second smallest is, as a share of the smallest."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(letters(text))
        best, low = int(sizes.argmin()), float(sizes.min())
        likely = np.exp2(-(sizes - low) / (1 + 0.02 * low))
        others = np.delete(sizes, best)
        margin = float(others.min() - low) / low if len(others) else 1.0
        return self.languages[best], float(1 / likely.sum()), margin


@releasing
def _predict(content: dict[str, bytes], least_margin: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(content)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("_text")]
            keys = [c for c in batch.schema.names if c != "_text"]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[0] == UNKNOWN or f[2] < least_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *columns], [*keys, "lang_pred", "score", "margin", "rejected"])

    return run


def identify(docs: DataFrame, content: dict[str, bytes], *, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", least_margin: float = 0.01) -> DataFrame:
    """(keys, lang_pred, score, margin, rejected), one row per row of docs.

    lang_pred is the language whose dictionary makes the whole text smallest, ties to the language with most rows; `und`, score 0
    and rejected, for texts that are null, empty or without a letter, and where no language is learned. rejected: the margin to
    the second smallest is under least_margin of the smallest. score is 1 over the sum of 2^-(excess bytes / (1 + 2 % of the
    smallest)), so 1 for a clear case and near 1 / languages for none. Null and repeated keys stay; they must not be named as a result column; other columns are not read.
    """
    rows = docs.select(*keys, F.col(text_col).alias("_text"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(_predict(content, least_margin), ", ".join([*(f"`{k}` {types[k]}" for k in keys), "lang_pred string", "score double", "margin double", "rejected boolean"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(id) mod 5 is not 0; the contract has a language for narrow margins too, so rejected is a column."""
    docs = table(spark, sf_dir, "documents")
    content = dictionaries(docs.where(crc_mod("doc_id", 5) != 0))
    out = identify(docs, content)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
