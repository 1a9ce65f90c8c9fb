"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from importlib import import_module

#: Name of each query, and the module below this package that has query() and, where SQL can express it, ORACLE.
OPERATORS = {
    "op1_chat_format": "chat_format",
    "op2_quality_rules": "quality_rules",
    "op3_url_filter": "url_filter",
    "op4_sum_of_squares_packing": "packing",
    "op5_pu_quality": "pu_quality",
    "op6_line_dedup": "line_dedup",
    "op7_license_scan": "license_scan",
    "op8_bpe_roundtrip": "bytebpe",
    "op9_ngram_jaccard_join": "ngram_join",
    "op10_topk_search": "topk_search",
    "op11_elkan_codes": "vector_codes",
    "op12_token_counts": "token_counts",
    "op13_centroid_clusters": "centroids",
}


def queries() -> dict:
    return {name: import_module(f"polyspec.llm.{module}").query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"polyspec.llm.{module}"), "ORACLE", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
