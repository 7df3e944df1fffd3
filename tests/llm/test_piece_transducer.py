"""op7 against the library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from grove.llm.piece_transducer import BARRED, UNKNOWN_COST, Normaliser, Transducer, decode, encode, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = Transducer(PATH)
ODD = ["", None, " ", "   ", "a  b\n c ", "\n\n\t x", "      six spaces   and three", "<s>x</s><unk><0x41>", "\U0001f600‍ é ́", "ー日本語テキスト 中文", "x" * 700, " " * 40 + "b", "▁a▁ ▁", "\x00\x01", "1234567 88.5%", "ÀÉÎ ß ñandú"]


def ids(text):
    return np.frombuffer(OURS.encode(text), "<u4").tolist()


def test_odd_texts():
    for t in ODD:
        assert ids(t) == LIBRARY.encode(t or ""), t


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdetinos   ATé\n.,1▁"), st.characters(codec="utf-8"))))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode(text)
    assert OURS.decode(ids(text)) == LIBRARY.decode(LIBRARY.encode(text))
    if "▁" not in text:
        assert OURS.decode(ids(text)) == text


def test_documents():
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[:300]:
        assert ids(t) == LIBRARY.encode(t)
        assert OURS.decode(ids(t)) == t


def test_without_remembered_paths(monkeypatch):
    monkeypatch.setattr("grove.llm.piece_transducer.REMEMBERED", 300)
    small = Transducer(PATH)
    text = "The quick brown fox, the lazy dog. " * 3
    assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY.encode(text)


def test_bytes_are_arcs_of_the_graph():
    """Characters that are no piece, within words and alone: one path through pieces and bytes, without a barred pair."""
    for text in (" ab\U00012000cd", " \x00\x01", " the\U00012345re \U00012000", " \U00012000"):
        cost, ids = OURS.shortest(text)
        assert UNKNOWN_COST < cost < BARRED
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text[1:])
        again = b"".join(OURS.raw[i] for i in np.frombuffer(ids, "<u4"))
        assert again.decode() == text
    assert "a" in OURS.pieces.alone and len(OURS.pieces.bytes_of("\U00012000")) == 4


def test_costs_are_relaxed():
    """The path found costs least of all paths that there are, listed one by one."""

    def paths(text, at=0, before=-1):
        if at == len(text):
            yield 0, []
        for piece, end in ((OURS.vocabulary[text[at:e]], e) for e in range(at + 1, len(text) + 1) if text[at:e] in OURS.vocabulary):
            step = 1 + (BARRED if before >= 0 and not OURS.can_follow(before, piece) else 0)
            for cost, rest in paths(text, end, piece):
                yield cost + step, [piece, *rest]

    for word in (" there", " stretch", "xylophone", "aaaaaaa", " 12  34", "----"):
        listed = sorted(paths(word))
        cost, ids = OURS.shortest(word)
        assert (cost, np.frombuffer(ids, "<u4").tolist()) == listed[0]
        assert len(listed) > 1 and listed[0][0] < BARRED <= listed[1][0]  # one path alone has no barred pair


def test_a_barred_pair_is_dear_but_passable(monkeypatch):
    small = Transducer(PATH)
    monkeypatch.setattr(small, "can_follow", lambda before, piece: False)
    text = " there"
    assert small.shortest(text)[0] < BARRED  # one piece has no pair
    text = " therexyz"
    assert small.shortest(text) == (BARRED, b"")
    cost, ids = small.shortest(text, 1 << 62)
    assert b"".join(small.raw[i] for i in np.frombuffer(ids, "<u4")).decode() == text and BARRED < cost


def test_normaliser():
    n = Normaliser("_", {"a": "bb", "c": ""})
    assert n.compose("xac") == "_xbb" and n.compose("") == ""


def test_long_unbroken_texts_are_not_remembered():
    small = Transducer(PATH)
    text = "x1y" * 3000
    assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY.encode(text)
    assert all(len(p) <= 64 for p in small.paths)


def test_frames(spark):
    docs = spark.createDataFrame([*((i, t, 7) for i, t in enumerate(ODD)), (None, "no id", 7), (3, "   ", 7)], "doc_id long, text string, ids int")
    coded = encode(docs, PATH)
    found = {(r.doc_id, tuple(r.ids)) for r in coded.collect()}
    assert found == {(r.doc_id, tuple(LIBRARY.encode(r.text or ""))) for r in docs.collect()}
    back = {(r.doc_id, r.text) for r in decode(coded, PATH).collect()}
    assert back == {(r.doc_id, LIBRARY.decode(LIBRARY.encode(r.text or ""))) for r in docs.collect()}
    rows = round_trip(docs, PATH).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.doc_id == 4:
            assert (r.ids_crc32, r.restored) == (zlib.crc32(np.array(LIBRARY.encode(ODD[4]), "<u4").tobytes()), True)
    assert round_trip(docs.limit(0), PATH).collect() == []
