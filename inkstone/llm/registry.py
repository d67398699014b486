"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from inkstone.llm import bpe, byte_dedup, class_lm, html_extract, mixing, order_minhash, quality_classifier, quality_rules, sentence_dedup, transport_stream

MODULES = (bpe, quality_rules, html_extract, sentence_dedup, transport_stream, mixing, class_lm, quality_classifier, order_minhash, byte_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
