"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Stages are written as Parquet and read again in between, so a lost executor repeats
part of one stage only.

Defined cases are those of the operators: empty tables stay empty, null and empty texts are kept or
dropped by the same rules as others (equal ones are copies of each other), extra columns are passed
on untouched up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.common import table
from tallybook.llm.decontamination import decontaminate
from tallybook.llm.exact_dedup import drop_copies
from tallybook.llm.jaccard_join import keep_one
from tallybook.llm.quality import keep_good
from tallybook.llm.sentencepiece_bpe import op3_sentencepiece
from tallybook.session import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays, of the smallest id; null is larger than any other."""
    return keep_one(docs, repeats=False)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as digests."""
    return op3_sentencepiece(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", tokens),
]

# A trained classifier and token ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
