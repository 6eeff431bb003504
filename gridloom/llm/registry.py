"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embeddings, jaccard, mixing, quality, quality_rules, secrets, sql, substrings, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality": quality.op2_quality,
    "op3_bpe": bpe.op3_bpe,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_chat_format": chat.op8_chat_format,
    "op9_secrets": secrets.op9_secrets,
    "op10_suffix_dedup": substrings.op10_suffix_dedup,
}
SQL: dict[str, str] = {"op1_url_filter": url_filter.ORACLE} | sql.SQL
