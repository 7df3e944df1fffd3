"""op4 and op9 against the library itself."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from tokenizers import Tokenizer

from grove.llm._tokenizer import Encoder
from grove.llm.token_counts import token_counts
from grove.llm.token_files import read_tokens, token_index, write_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)
OURS = Encoder(WORDS)
ODD = ["", None, " \t\n", "Don't STOP'S 'll", "café Café ́x", "a<|endoftext|>b <|startoftext|>", "x y z\x1cq\x85", "ΣΟΣ İ ﬁ ªµ 12345 ١٢", "!!!'s???", "\U0001f600‍❤️", "\x00\x01 \x7f", "ÀÉÎÕÜß ÷×", "long" * 3000, "_a_b_ --- ...x"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_odd_texts_encode_as_the_library_does():
    assert [np.frombuffer(x, "<u4").tolist() for x in OURS.encode(ODD)] == [ids(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé'É .,!<|>endoftxs\n\t ́12_-"), st.characters(codec="utf-8"))))
def test_any_text_encodes_as_the_library_does(text):
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == ids(text)


def rows(spark, texts, **more):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_counts(spark, tmp_path):
    docs = rows(spark, [*ODD, *ODD, "same"]).unionByName(rows(spark, ["same"]))
    found = sorted(map(tuple, token_counts(docs, WORDS, f"file://{tmp_path}/c", limit=5).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 5) for r in docs.collect()), key=str)
    assert found == want
    cached = spark.read.parquet(f"{tmp_path}/c")
    assert cached.count() == len({t or "" for t in [*ODD, "same"]})
    again = token_counts(docs, WORDS, f"file://{tmp_path}/c", limit=5)
    assert sorted(map(tuple, again.collect()), key=str) == want
    assert spark.read.parquet(f"{tmp_path}/c").count() == cached.count()  # nothing is encoded twice
    assert token_counts(docs.limit(0), WORDS, f"file://{tmp_path}/d").collect() == []


def test_counts_of_a_piece_model(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = rows(spark, ["Hello there", "", None, "a  b\n"])
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, path, f"file://{tmp_path}/c").collect()}
    assert found == {r.doc_id: len(library.encode(r.text or "")) for r in docs.collect()}


@pytest.mark.parametrize("end", [2, None])
def test_files(spark, tmp_path, end):
    docs = rows(spark, ODD).unionByName(spark.createDataFrame([(None, "no id", ""), (3, "again", "")], "doc_id long, text string, n_tokens string"))
    write_tokens(docs, WORDS, f"{tmp_path}/t", end_id=end, files=3)
    want, at = [], 0
    place = lambda t: int.from_bytes(xxhash.xxh64_digest((t or "").encode(), 42), "big", signed=True)
    for r in sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, place(r.text))):
        got = ids(r.text) + ([end] if end is not None else [])
        want.append((r.doc_id, at, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
        at += len(got)
    assert sorted(map(tuple, token_index(spark, f"{tmp_path}/t").collect()), key=lambda r: (r[1], r[2], str(r[0]))) == sorted(want, key=lambda r: (r[1], r[2], str(r[0])))
    one = read_tokens(spark, f"{tmp_path}/t").where("doc_id = 4").collect()
    assert [r.ids for r in one] == [ids(ODD[4]) + ([end] if end is not None else [])]


def test_no_documents(spark, tmp_path):
    write_tokens(rows(spark, ["x"]).limit(0), WORDS, f"{tmp_path}/t")
    assert token_index(spark, f"{tmp_path}/t").collect() == []


def test_long_texts(spark, tmp_path):
    """Texts of megabytes, with and without spaces: counted and written whole."""
    texts = ["word " * 300_000, "x" * 200_000, "né " * 50_000]
    docs = rows(spark, texts)
    want = [len(ids(t)) for t in texts]
    assert [r.n_tokens for r in token_counts(docs, WORDS, f"file://{tmp_path}/c").orderBy("doc_id").collect()] == want
    write_tokens(docs, WORDS, f"{tmp_path}/t")
    found = token_index(spark, f"{tmp_path}/t").orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens) for r in found] == [(0, want[0] + 1), (want[0] + 1, want[1] + 1), (want[0] + want[1] + 2, want[2] + 1)]


def test_copies_are_encoded_once(spark, tmp_path):
    """Rows that repeat both id and text, and null ids: one miss for each distinct text."""
    docs = spark.createDataFrame([(None, "again")] * 40 + [(1, "again")] * 40 + [(1, "other")], "doc_id long, text string")
    found = token_counts(docs, WORDS, f"file://{tmp_path}/c")
    assert found.count() == 81 and spark.read.parquet(f"{tmp_path}/c").count() == 2
    more = docs.unionByName(spark.createDataFrame([(2, "new one")] * 3, "doc_id long, text string"))
    assert token_counts(more, WORDS, f"file://{tmp_path}/c").count() == 84 and spark.read.parquet(f"{tmp_path}/c").count() == 3


def test_stripes_and_row_groups(spark, tmp_path):
    """Files have several stripes, each readable alone, with Bloom filters; a filter on ids reads few rows."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(3 * i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(6000)], "doc_id long, text string")
    write_tokens(docs, WORDS, f"{tmp_path}/t", files=2, stride=1000, stripe=64 << 10)
    names = sorted(glob.glob(f"{tmp_path}/t/*.orc"))
    assert len(names) == 2
    whole = []
    for name in names:
        f = orc.ORCFile(name)
        assert f.nstripes > 1
        parts = [f.read_stripe(i).column("doc_id").to_pylist() for i in range(f.nstripes)]
        assert [x for p in parts for x in p] == f.read().column("doc_id").to_pylist()
        whole += [x for p in parts for x in p]
    assert whole == [3 * i for i in range(6000)]

    def scanned(condition):
        read = read_tokens(spark, f"{tmp_path}/t").where(condition).select("doc_id", "n_tokens")
        n = len(read.collect())
        nodes = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(read._jdf.queryExecution().executedPlan().collectLeaves())
        return n, sum(x.metrics().apply("numOutputRows").value() for x in nodes)

    assert scanned("doc_id >= 0")[1] == 6000
    found, seen = scanned("doc_id = 7500")
    assert found == 1 and seen <= 1000  # one row group
    found, seen = scanned("doc_id = 7501")
    assert found == 0 and seen <= 1000  # within the range of ids: a Bloom filter may rule it out
