"""Queries of the training-data operators, by their registered names, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from docsift.llm import bpe, fingerprint, language_model, minhash, mixing, pii, quality, substrings, token_files, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_bpe_encode": bpe.query,
    "op2_mix_sources": mixing.query,
    "op3_toxicity": toxicity.query,
    "op4_minhash_dedup": minhash.query,
    "op5_token_files": token_files.query,
    "op6_quality_rules": quality.query,
    "op7_fingerprint": fingerprint.query,
    "op8_pii": pii.query,
    "op10_lm_score": language_model.query,
    "op9_substring_dedup": substrings.query,
}

SQL = {
    "op2_mix_sources": mixing.SQL,
}
