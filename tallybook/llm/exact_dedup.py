"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id
stays. A Misra-Gries summary of every partition, merged on the way, names at most `counters`
digests that could make up more than 1/(counters+1) of all rows. Exact counts verify them; the
winners are broadcast (never more than `counters` rows), and their rows leave on the map side. All
other digests take an ordinary shuffle, where none has more than that share of the rows.

Defined cases: a null text is empty, so empty and null texts are one group; a null id is smaller
than any other; of repeated rows (same id, same text) exactly one can stay; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import id_filter, limited, passing, texts_of
from tallybook.session import store

COUNTERS = 1024


def _trim(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Merge rule of the summary: subtract the next largest count, keep what stays positive."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def heavy_candidates(df: DataFrame, column: str, counters: int = COUNTERS) -> list[bytes]:
    """At most `counters` values; every value of more than rows/(counters+1) rows is among them."""

    def summary(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for found in pc.value_counts(batch.column(0)).to_pylist():
                counts[found["values"]] = counts.get(found["values"], 0) + found["counts"]
            counts = _trim(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item", "low"]
        )

    limited(df.sparkSession)
    parts = df.select(column).mapInArrow(summary, "item binary, low long")
    merged = (
        parts.groupBy("item").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "item").limit(counters + 1).collect()
    )
    return list(_trim({bytes(r["item"]): r["low"] for r in merged}, counters))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of the normalised text."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return texts_of(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2(lower.cast("binary"), 256)).alias("digest")
    )


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept), one row per document."""
    spark = docs.sparkSession
    rows = store(digests(docs, id_col, text_col), "digests")
    candidates = heavy_candidates(rows, "digest", counters)
    named = F.broadcast(spark.createDataFrame([(bytearray(c),) for c in candidates], "digest binary"))
    measures = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    share = rows.count() // (counters + 1)
    winners = rows.join(named, "digest").groupBy("digest").agg(*measures).where(F.col("group_size") > share).collect()
    winners = F.broadcast(
        spark.createDataFrame([tuple(r) for r in winners], "digest binary, keep_id long, group_size long")
    )

    def settle(members: DataFrame) -> DataFrame:
        """One row per copy again; the first copy of the largest id stays."""
        return members.select(
            "doc_id", "digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
        ).select(
            "doc_id", "digest", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        )

    hot = rows.join(winners, "digest")
    top = hot.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    top = top.groupBy("doc_id", "digest", "keep_id", "group_size").agg(F.count("*").cast("int").alias("copies"))
    hot = hot.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        "doc_id", "digest", "keep_id", "group_size", F.lit(False).alias("kept")
    )

    dealt = rows.join(winners.select("digest"), "digest", "left_anti").repartition("digest")
    members = dealt.groupBy("digest", "doc_id").agg(F.count("*").cast("int").alias("copies"))
    groups = members.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    rest = settle(members.join(groups, "digest"))
    return hot.unionByName(settle(top)).unionByName(rest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns. Rows are told apart by id and text.

    Only rows with the id of a row that goes (and few others) are joined and compared; all others
    stay where they are read.
    """
    limited(docs.sparkSession)
    groups = store(copy_groups(docs, id_col, text_col, counters), "copy_groups")
    bitmap = id_filter(groups.where(~F.col("kept")), "doc_id")
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    doubtful = passing(docs, bitmap, id_col).withColumn("__digest", F.unhex(F.sha2(lower.cast("binary"), 256)))
    kept = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__kept"))
    match = doubtful[id_col].cast("long").eqNullSafe(kept["__id"]) & (doubtful["__digest"] == kept["__kept"])
    # Repeated rows share id and text; one of them stays.
    stay = doubtful.join(kept, match, "left_semi").dropDuplicates([id_col, "__digest"]).drop("__digest")
    return passing(docs, bitmap, id_col, among=False).unionByName(stay)


def op6_exact_dedup(docs: DataFrame) -> DataFrame:
    return copy_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""
