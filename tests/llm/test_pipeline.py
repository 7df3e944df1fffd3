"""The pipeline: each stage on its own input."""

import re

import corpus_pipeline
import public_tokenizers
import sentencepiece

from grove.llm.quality_rules import quality
from grove.llm.suffix_dedup import repeats

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == columns
        made.append((docs, out))
        docs = out
    before, after = made[0]
    kept = {r.doc_id for r in quality(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = made[1]
    texts = {r.doc_id: r.text for r in before.collect()}
    stay = {r.doc_id: r.text for r in after.collect()}
    assert stay.items() <= texts.items() and len(set(stay.values())) == len(stay)
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())]}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts, key=lambda i: len(shingles[i]))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 4 * len(shingles[b]) > 5 * len(shingles[a]):
                break
            if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(stay) == {i for i in texts if root[i] == i}  # recall and precision are 1
    assert 0.6 * len(texts) < len(stay) < len(texts)
    before, after = made[2]
    assert not [r for r in repeats(after).collect() if r.removable and sum(s.end - s.start for s in r.removable) > 200]
    cut = {r.id: r.removable for r in repeats(before).where("size(removable) > 0").collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == texts[r.doc_id] for r in after.collect() if r.doc_id not in cut)
    assert set(texts) - {r.doc_id for r in after.collect()} <= set(cut)
    before, after = made[3]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r.text) for r in before.collect())
    assert abs(sum(words(r.text) for r in after.collect()) - 1.5 * total) < 40
    before, after = made[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(library.encode(r.text) for r in before.collect()) == sorted(r.ids for r in after.collect())
    assert all(r.restored for r in after.collect())


def test_odd_rows_and_no_rows(spark):
    text = " ".join(f"Word{i} and more of it." for i in range(40))
    extra = ["size", "draws", "fingerprint", "component_id", "ids", "votes", "quality", "block", "rank", "id", "th", "at", "shard", "_key", "_hash", "_id", "_text", "_spans", "row", "key", "k", "_k", "draw", "digest", "source_key", "_counts"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    more = ("x",) * len(extra)
    rows = [(1, text, "en", "a", 5, *more), (1, text, "en", "a", 5, *more), (None, text + " tail", None, None, None, *((None,) * len(extra))), (2, None, None, None, None, *more), (3, "", "en", "b", 0, *more), (4, "long " * 30000 + text, "en", "a", 1, *more), (5, text.replace("Word3 ", "x "), "en", "b", 1, *more)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            found = out.collect()
            assert docs.take(1) or not found
            if i < 4:
                assert out.columns == docs.columns
                assert {r.size for r in found} <= {"x", None}
            else:
                assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "restored"] and all(r.restored for r in found)
