"""Pages of a large ordered result, found by position.

A result is put in order once: ranges of the order, each sorted and in a folder of its own, every row
with its place in it. A page adds up the counts of the ranges before it, one number a range, and reads
only the ranges it lies in. No call sorts the result again or numbers its rows in one task.

The order must end in a column that tells rows apart, so that equal leading values, of a third of all
rows say, are spread over ranges too. Rows equal in the whole order keep whatever place they got.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tallybook.session import freed_shuffles, shared_dir

RANGE, PLACE, POSITION = "order_range", "order_place", "position"


@dataclass(frozen=True)
class Ordered:
    """Rows in order with their range and place, and the position of each range's first row, the total last."""

    rows: DataFrame
    starts: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.starts[-1]


def put_in_order(rows: DataFrame, order: Sequence[Column], ranges: int | None = None, path: str | None = None) -> Ordered:
    """Write rows range by range; `ranges` is how many there shall be (default: the shuffle's partitions)."""
    spark = rows.sparkSession
    taken = {RANGE, PLACE, POSITION} & set(rows.columns)
    if taken:
        raise ValueError(f"columns reserved for the order: {sorted(taken)}")
    path = path or f"{shared_dir(spark)}/tables/ordered_{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    # The range leads the sort, so writing by range needs no sort of its own.
    placed = dealt.withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, *order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    with freed_shuffles(spark):
        placed.withColumn(PLACE, within).write.partitionBy(RANGE).option("compression", "zstd").parquet(path)
    return open_ordered(rows, path)


def open_ordered(rows: DataFrame, path: str) -> Ordered:
    """What `put_in_order` wrote to a path; `rows` gives the columns. Ranges are counted from the files' footers."""
    schema = StructType([*rows.schema.fields])
    schema = schema.add(PLACE, LongType()).add(RANGE, IntegerType())
    stored = rows.sparkSession.read.schema(schema).parquet(path)
    counts = dict(stored.groupBy(RANGE).count().collect())
    sizes = [counts.get(r, 0) for r in range(max(counts, default=-1) + 1)]
    return Ordered(stored, tuple(accumulate(sizes, initial=0)))


def page(ordered: Ordered, offset: int, limit: int) -> DataFrame:
    """Rows at positions offset, offset + 1, ... (from 0), in order, with their position; past the end there are none."""
    if offset < 0 or limit < 1:
        raise ValueError("a page begins at 0 or later and holds a row at least")
    starts, end = ordered.starts, offset + limit
    met = [r for r in range(len(starts) - 1) if starts[r] < end and offset < starts[r + 1]]
    rows = ordered.rows.where(F.col(RANGE).between(met[0], met[-1]) if met else F.lit(False))
    if len(met) == 1:  # places inside the range reach the scan as well
        first = starts[met[0]]
        rows = rows.where(F.col(PLACE).between(max(0, offset - first), end - first - 1))
    base = F.array(*[F.lit(starts[r]).cast("long") for r in met]) if met else F.array(F.lit(0).cast("long"))
    begin = F.get(base, F.col(RANGE) - F.lit(met[0] if met else 0))
    placed = rows.withColumn(POSITION, begin + F.col(PLACE)).where(F.col(POSITION).between(offset, end - 1))
    return placed.drop(RANGE, PLACE).orderBy(POSITION)
