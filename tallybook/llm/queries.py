"""Registered queries of the subpackage and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import (
    alignment,
    chat,
    decontamination,
    exact_dedup,
    jaccard_join,
    language_id,
    lexical_search,
    nearest,
    quality,
    sentencepiece_bpe,
    simple8b,
    suffix_dedup,
    token_counts,
)
from tallybook.llm.common import limited, table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(limited(spark), sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simple8b": _docs(simple8b.op1_simple8b),
    "op2_token_counts": _docs(token_counts.op2_token_counts),
    "op3_sentencepiece": _docs(sentencepiece_bpe.op3_sentencepiece),
    "op4_language_id": _docs(language_id.op4_language_id),
    "op5_chat_format": lambda spark, sf_dir: chat.op5_chat_format(spark, table(limited(spark), sf_dir, "conversations")),
    "op6_exact_dedup": _docs(exact_dedup.op6_exact_dedup),
    "op7_quality": lambda spark, sf_dir: quality.op7_quality(
        table(limited(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    ),
    "op8_decontamination": lambda spark, sf_dir: decontamination.op8_decontamination(
        table(limited(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ),
    "op9_jaccard_join": _docs(jaccard_join.op9_jaccard_join),
    "op10_suffix_dedup": _docs(suffix_dedup.op10_suffix_dedup),
    "op11_lexical_search": lambda spark, sf_dir: lexical_search.op11_lexical_search(
        table(limited(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ),
    "op12_nearest": lambda spark, sf_dir: nearest.op12_nearest(table(limited(spark), sf_dir, "embeddings")),
    "op13_alignment": _docs(alignment.op13_alignment),
}

SQL: dict[str, str] = {
    "op5_chat_format": chat.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_decontamination": decontamination.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op11_lexical_search": lexical_search.SQL,
}
