"""What the operators share: reading tables, batch limits, the training split, fixed-size id filters."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of text that one step inside a task holds at a time, besides a single longer text.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limited(spark: SparkSession) -> SparkSession:
    """Bound the bytes, not only the rows, that travel to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * 1024 * 1024))
    return spark


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, a null text as the empty one; other columns cannot clash later."""
    limited(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def fold(id_col: str = "doc_id") -> Column:
    """Remainder that splits rows into training (1..4) and held out (0); a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def release() -> None:
    """Workers live on between tasks: what Arrow and malloc keep for reuse goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library: it has no such call
        pass


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of (doc_id, text, ...) cut so that a slice holds about SLICE_CHARS characters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_CHARS, "right")))
            part = batch.slice(begin, end - begin)
            yield part, column.slice(begin, end - begin).to_pylist()
            begin = end
    release()


# An IdFilter has this many bits: 2 MB on every executor, whatever the number of ids.
FILTER_BITS = 1 << 24


def _slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column.cast("long")), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str):
    """Broadcast bitmap of fixed size over the ids; `passing` is true for each of them and few others.

    Built by Spark's bitmap aggregates: at most FILTER_BITS / 32768 rows reach the driver.
    """
    spark = ids.sparkSession
    slots = ids.select((_slot(F.col(column)) + 1).alias("slot"))  # Spark counts positions from 1
    words = (
        slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )
    found = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in words:
        begin = (row["bucket"] - 1) * 4096
        found[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(found)


def passing(docs: DataFrame, bitmap, column: str = "doc_id", among: bool = True) -> DataFrame:
    """Rows whose id may be in the filter (no id of it is lost), or with among=False the others."""

    def keep(batches):
        bits = bitmap.value
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool) == among)).select(batch.schema.names[:-1])

    return docs.withColumn("__slot", _slot(F.col(column))).mapInArrow(keep, docs.schema)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is not in the one column of `gone` (null is an id).

    Only rows that the filter lets through meet `gone` in a join; all others stay where they are.
    """
    gone = gone.toDF("__gone")
    bitmap = id_filter(gone, "__gone")
    doubtful = passing(docs, bitmap, id_col)
    doubtful = doubtful.join(gone, doubtful[id_col].cast("long").eqNullSafe(gone["__gone"]), "left_anti")
    return passing(docs, bitmap, id_col, among=False).unionByName(doubtful)
