"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exact_search, filter_audit, html_text, jaccard_join, line_dedup, mixing, quality, repetition, sharding, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": jaccard_join.op1_ngram_jaccard,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality": quality.op4_quality,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_topk": exact_search.op7_exact_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_sharding": sharding.op10_sharding,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_repetition_rules": repetition.op12_repetition_rules,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": jaccard_join.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op7_exact_topk": exact_search.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_repetition_rules": repetition.SQL,
}
