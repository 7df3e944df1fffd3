"""The queries opN_<name> over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from grove.llm import language_id, mixing, piece_transducer, quality_rules, simhash, suffix_dedup, token_counts, token_files, topk_search, toxicity

QUERIES = {
    "op1_topk_search": topk_search.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_mix_sources": mixing.query,
    "op4_token_orc": token_files.query,
    "op5_toxicity": toxicity.query,
    "op6_quality_rules": quality_rules.query,
    "op7_sentencepiece": piece_transducer.query,
    "op8_language_id": language_id.query,
    "op9_token_counts": token_counts.query,
    "op10_simhash": simhash.query,
}
ORACLES = {
    "op1_topk_search": topk_search.SQL,
}
