"""Exact length histogram of encoded documents and what its suffix sums answer.

One pass counts the tokens of every whole text; rows are aggregated by (source, length) before any
shuffle, so what moves is the histogram, not the documents. Running sums over a histogram give for
every context limit the documents and tokens within it, those beyond it, and the total after
truncation; between two lengths these change linearly, so `truncated_totals` is exact at any limit.

Defined cases: a null text is empty and has no tokens; null is a source of its own; repeated rows
count each; an empty table has an empty histogram; a text of any length is counted whole; other
columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.chunks import byte_bpe_ids
from tallybook.llm.common import limited, slices
from tallybook.session import store


def lengths(docs: DataFrame, tokenizer_path: str, group_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, n_tokens) per document."""
    limited(docs.sparkSession)
    rows = docs.select(F.col(group_col).cast("string").alias("source"), F.coalesce(text_col, F.lit("")).alias("text"))

    def count(batches):
        for batch, texts in slices(batches):
            sizes = [len(ids) for ids in byte_bpe_ids(tokenizer_path, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["source", "n_tokens"])

    return rows.mapInArrow(count, "source string, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """(scope, source, n_tokens, documents): scope 'source' for each source, 'all' for the whole table."""
    by_source = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("documents"))
    scoped = F.explode(
        F.array(
            F.struct(F.lit("source").alias("scope"), F.col("source").alias("source")),
            F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("source")),
        )
    )
    return (
        by_source.select("n_tokens", "documents", scoped.alias("s"))
        .groupBy("s.scope", "s.source", "n_tokens")
        .agg(F.sum("documents").alias("documents"))
    )


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Every length as a context limit, with sums over shorter-or-equal and longer documents."""
    upward = Window.partitionBy("scope", "source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("scope", "source").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("documents") * F.col("n_tokens")
    zero = F.lit(0).cast("long")
    return hist.select(
        "scope", "source", F.col("n_tokens").alias("context_limit"), "documents",
        F.sum("documents").over(upward).alias("documents_within"),
        F.coalesce(F.sum("documents").over(downward), zero).alias("documents_beyond"),
        F.sum(tokens).over(upward).alias("tokens_within"),
        F.coalesce(F.sum(tokens).over(downward), zero).alias("tokens_beyond"),
    ).withColumn("truncated_tokens", F.col("tokens_within") + F.col("documents_beyond") * F.col("context_limit"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(scope, source, context_limit, tokens, truncated_tokens) for any limits, from the histogram alone."""
    n, limit = F.col("n_tokens"), F.col("context_limit")
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    return (
        hist.select("*", asked)
        .groupBy("scope", "source", "context_limit")
        .agg(
            F.sum(F.col("documents") * n).alias("tokens"),
            F.sum(F.col("documents") * F.least(n, limit)).alias("truncated_tokens"),
        )
    )


def _parts(share: Fraction) -> list[Column]:
    kind = "decimal(18,0)"
    return [F.lit(share.numerator).cast(kind).alias("part"), F.lit(share.denominator).cast(kind).alias("whole")]


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(scope, source, share, n_tokens): the smallest length that at least that share of documents has at most.

    A share is taken as the decimal it is written as (0.07 as 7 of 100), so that counts are compared exactly.
    """
    total = F.col("documents_within") + F.col("documents_beyond")
    exact = [Fraction(str(float(x))) for x in shares]
    written = [F.struct(F.lit(float(x)).alias("share"), *_parts(e)) for x, e in zip(shares, exact)]
    asked = F.explode(F.array(*written)).alias("asked")
    return (
        sums.select("*", asked)
        .where(F.col("documents_within").cast("decimal(20,0)") * F.col("asked.whole") >= F.col("asked.part") * total.cast("decimal(20,0)"))
        .select("scope", "source", "context_limit", "asked.share")
        .groupBy("scope", "source", "share")
        .agg(F.min("context_limit").alias("n_tokens"))
    )


LIMITS = [512, 1024, 2048, 4096, 8192, 32768, 131072]
SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def op2_token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """All answers in one table, told apart by `measure`.

    'length': every length that occurs as a context limit, with its suffix sums; 'truncated': totals
    for the usual limits; 'quantile': lengths (in context_limit) for the usual shares.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    hist = store(histogram(lengths(docs, tokenizer_path)), "histogram")
    sums = suffix_sums(hist)
    parts = [
        sums.withColumn("measure", F.lit("length")),
        truncated_totals(hist, LIMITS).withColumnRenamed("tokens", "tokens_within").withColumn("measure", F.lit("truncated")),
        quantiles(sums, SHARES).withColumnRenamed("n_tokens", "context_limit").withColumn("measure", F.lit("quantile")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
