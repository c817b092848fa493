"""Benchmark decontamination: size-partitioned MinHash containment search.

A document contains a test item when at least `threshold` of the item's distinct five-word shingles
occur in it, wherever and however long the document is; an item of fewer than five words, when its
words occur in a row. Items are partitioned by the size of their shingle set (powers of two). Within a
partition every item is sketched by its k smallest shingles, k being what the partition's largest size
q needs: q - ceil(threshold * q) + 1. At least one of so many shingles must occur in any document that
contains the item, so the search over sketches misses nothing, and k stays a fraction of the item
however long the document. Shingles are ordered by hash, those that many items share after all others
(by powers of two of their number), so a question's set phrase makes no document a candidate.

Documents are probed whole, one pass, no shuffle: their shingle hashes are looked up in two bitmaps
of fixed size (sketch hashes; all item shingles). A document with a sketch hit leaves its shingles
that are in the second bitmap, as text. Equi-joins find the candidates, pairs of a document and an
item with a sketch shingle in common, and then count what candidates alone share. Bitmaps never lose a
hit, and what they let through in vain fails the join.

Defined cases: null or word-less items and documents contain nothing; items of fewer than `shortest`
words are found in documents of just these words only (a filter of documents would otherwise drop
all that hold a common word; `decontaminate` sets it to five, `leaks` to one); rows
that share a document id (null too) are one document, rows that share an item id one item, which
holds the shingles of all of them; empty tables give no pairs; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import FILTER_BITS, limited, slices, texts_of, without
from tallybook.llm.shingles import WORDS, run_hashes, run_texts, shingle_hashes, shingle_texts
from tallybook.session import store

THRESHOLD = 0.75


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, shingle, hash, n_shingles, n_words, sketched): distinct shingles of each item, marked where in its sketch.

    n_words is the number of words of a shingle: below five for the one of a shorter item.
    """

    def cut(batches):
        for batch, texts in slices(batches):
            raw = [t.encode() for t in texts]
            hashes, stops = shingle_hashes(raw)
            shingles = [shingle_texts(t) for t in raw]
            counts = np.diff(stops, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(raw)), counts))),
                    pa.array([s for found in shingles for s in found], pa.binary()),
                    pa.array(hashes.view(np.int64)),
                ],
                ["item_id", "shingle", "hash"],
            )

    rows = texts_of(items, "item_id").select(F.col("doc_id").alias("item_id"), "text")
    shingles = rows.mapInArrow(cut, "item_id long, shingle binary, hash long").dropDuplicates(["item_id", "shingle"])
    shingles = store(shingles, "item_shingle_texts")
    sharing = shingles.groupBy("shingle").agg(F.floor(F.log2(F.count("*"))).alias("sharing"))
    by_item = Window.partitionBy("item_id")
    sized = shingles.join(sharing, "shingle").withColumn("n_shingles", F.count("*").over(by_item))
    # Partition p holds the sizes above 2^(p-1) up to 2^p; its largest size sets the sketch width.
    largest = F.pow(F.lit(2.0), F.ceil(F.log2("n_shingles")))
    width = largest - F.ceil(largest * threshold) + 1
    rank = F.row_number().over(by_item.orderBy("sharing", "hash", "shingle"))
    n_words = F.size(F.split(F.col("shingle").cast("string"), " "))
    return sized.select(
        "item_id", "shingle", "hash", "n_shingles", n_words.alias("n_words"), (rank <= width).alias("sketched")
    )


def _bitmap(rows: DataFrame) -> np.ndarray:
    """Bits of the hashes' low part; at most FILTER_BITS / 32768 rows of bitmap reach the driver."""
    slot = rows.select((F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("slot"))  # counted from 1
    parts = (
        slot.groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in parts:
        begin = (part["bucket"] - 1) * 4096
        bits[begin : begin + 4096] = np.frombuffer(part["bits"], np.uint8)
    return bits


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def _probed(docs: DataFrame, known: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, shingle): of documents with a sketch hit, the shingles that may be of an item."""
    spark = limited(docs.sparkSession)
    sketch = spark.sparkContext.broadcast(_bitmap(known.where("sketched")))
    whole = spark.sparkContext.broadcast(_bitmap(known))
    short = known.where(F.col("n_words").between(shortest, WORDS - 1)).select("n_words").distinct()
    sizes = sorted(row["n_words"] for row in short.collect())  # four numbers at most

    def probe(batches):
        for batch, texts in slices(batches):
            raw = [t.encode() for t in texts]
            cuts = [(*shingle_hashes(raw), shingle_texts)]
            cuts += [(*run_hashes(raw, n), lambda t, n=n: run_texts(t, n)) for n in sizes]
            hits = [np.searchsorted(stops, np.flatnonzero(_has(sketch.value, hashes)), "right") for hashes, stops, _ in cuts]
            rows, found = [], []
            for t in np.unique(np.concatenate(hits)).tolist():
                own = {}
                for hashes, stops, spelled in cuts:
                    places = np.flatnonzero(_has(whole.value, hashes[stops[t - 1] if t else 0 : stops[t]]))
                    if len(places):
                        shingles = spelled(raw[t])
                        own.update(dict.fromkeys(shingles[i] for i in places.tolist()))
                rows += [t] * len(own)
                found += own
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(found, pa.binary())], ["doc_id", "shingle"]
                )

    return docs.mapInArrow(probe, "doc_id long, shingle binary")


def _candidates(probed: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, item_id) with a sketch shingle in common."""
    sketches = known.where("sketched").select("shingle", "item_id")
    return probed.join(sketches, "shingle").select("doc_id", "item_id").distinct()


def leaks(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", shortest: int = 1
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) for each document that contains an item."""
    known = store(item_shingles(items, threshold), "item_shingles")
    probed = store(_probed(texts_of(docs, id_col, text_col), known, shortest), "probed")
    pair, item = _candidates(probed, known).alias("pair"), known.alias("item")
    asked = pair.join(item, F.col("pair.item_id").eqNullSafe(F.col("item.item_id"))).select(
        "pair.doc_id", "pair.item_id", "item.shingle", "item.n_shingles"
    ).alias("asked")
    held = probed.alias("held")
    same = F.col("asked.doc_id").eqNullSafe(F.col("held.doc_id")) & (F.col("asked.shingle") == F.col("held.shingle"))
    return (
        asked.join(held, same, "left_semi")
        .groupBy("doc_id", "item_id", "n_shingles")
        .agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles"))
        .select("doc_id", "item_id", "n_shared", "n_shingles")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", shortest: int = WORDS
) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    found = store(leaks(docs, items, threshold, id_col, text_col, shortest).select("doc_id").distinct(), "leaks")
    return without(docs, found, id_col)


def op8_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = leaks(docs, items)
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


SQL = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
short AS (SELECT DISTINCT len(w) AS n FROM words WHERE kind = 1 AND len(w) BETWEEN 1 AND 4),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words WHERE len(w) > 0
  UNION
  SELECT kind, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' ')))
  FROM words JOIN short ON kind = 0 AND len(w) >= n),
sizes AS (SELECT id, count(*) AS n_shingles FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n_shingles, round(count(*) / n_shingles, 6) AS containment
FROM shingles d JOIN shingles i ON d.kind = 0 AND i.kind = 1 AND d.s = i.s JOIN sizes z ON z.id IS NOT DISTINCT FROM i.id
GROUP BY d.id, i.id, n_shingles HAVING count(*) >= 0.75 * n_shingles
"""
