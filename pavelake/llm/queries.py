"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, fingerprint, html, mixing, near_dedup, pii, prefix_trie, quality, substring_dedup, token_files, toxicity
from .common import ship_package

_OPERATORS = [
    (substring_dedup.op1_substring_dedup, substring_dedup.OP1_SQL),
    (quality.op2_quality, None),
    (html.op3_html_text, None),
    (fingerprint.op4_lz_fingerprints, None),
    (toxicity.op5_toxicity, None),
    (bpe.op6_bpe, None),
    (exact_dedup.op7_exact_dedup, exact_dedup.OP7_SQL),
    (mixing.op8_mix_sources, mixing.OP8_SQL),
    (near_dedup.op9_near_dedup, near_dedup.OP9_SQL),
    (pii.op10_pii_surrogates, None),
    (prefix_trie.op11_prefix_trie, prefix_trie.OP11_SQL),
    (divergence.op12_source_divergence, divergence.OP12_SQL),
    (token_files.op13_token_files, None),
]


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {q.__name__: _shipped(q) for q, _ in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {q.__name__: sql for q, sql in _OPERATORS if sql}
