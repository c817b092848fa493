"""Pages by position: the same rows as one global sort, read from the ranges they lie in."""

import pytest
from pyspark.sql import functions as F

from tallybook.sources import paging

ROWS = 5_000


def _rows(spark):
    """A third of the rows share one date, some have none, labels are null or empty."""
    n = F.col("id")
    day = F.when(n % 3 == 0, F.lit("2026-01-05")).when(n % 7 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("2026-02-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))
    )
    label = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit("")).otherwise((n % 11).cast("string"))
    return spark.range(ROWS).select(day.cast("date").alias("day"), label.alias("label"), F.sha1(n.cast("string")).alias("id"))


def _order():
    return F.asc_nulls_last("day"), F.coalesce("label", F.lit("")), F.col("id")


def _sorted(rows):
    return sorted(rows, key=lambda r: (r["day"] is None, str(r["day"]), r["label"] or "", r["id"]))


def test_pages_are_slices_of_the_sorted_rows(spark):
    rows = _rows(spark)
    expected = [r["id"] for r in _sorted(rows.collect())]
    ordered = paging.put_in_order(rows, _order(), 16)
    assert ordered.total == ROWS and len(ordered.starts) > 8
    edge = ordered.starts[3]
    for offset, limit in ((0, 1), (0, 200), (edge - 1, 2), (edge, 7), (edge - 50, 1_000), (ROWS - 3, 200), (0, 2 * ROWS)):
        found = paging.page(ordered, offset, limit).collect()
        assert [r["id"] for r in found] == expected[offset : offset + limit]
        assert [r["position"] for r in found] == list(range(offset, min(offset + limit, ROWS)))
    assert paging.page(ordered, ROWS, 10).collect() == []


def test_a_hot_date_lies_in_many_ranges(spark):
    ordered = paging.put_in_order(_rows(spark), _order(), 16)
    held = ordered.rows.where("day = date'2026-01-05'").select(paging.RANGE).distinct().count()
    assert held >= 4
    sizes = [b - a for a, b in zip(ordered.starts, ordered.starts[1:])]
    assert max(sizes) < 3 * ROWS / 16


def test_a_page_reads_its_range_alone(spark):
    ordered = paging.put_in_order(_rows(spark), _order(), 16)
    first = ordered.starts[5]
    found = paging.page(ordered, first + 2, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"{paging.RANGE}" in plan and "PartitionFilters" in plan
    assert "PushedFilters: [IsNotNull(order_place), GreaterThanOrEqual(order_place,2), LessThanOrEqual(order_place,6)]" in plan
    files = {r["f"] for r in ordered.rows.where(F.col(paging.RANGE) == 5).select(F.input_file_name().alias("f")).collect()}
    read = spark.read.parquet(*[f.rsplit("/", 1)[0] for f in files]).count()
    assert read == ordered.starts[6] - first


def test_empty_reserved_and_reopened(spark, tmp_path):
    empty = paging.put_in_order(_rows(spark).where("false"), _order())
    assert empty.total == 0 and paging.page(empty, 0, 10).collect() == []
    with pytest.raises(ValueError, match="reserved"):
        paging.put_in_order(spark.range(3).withColumn("position", F.lit(1)), [F.col("id")])
    with pytest.raises(ValueError, match="page"):
        paging.page(empty, -1, 10)
    path = str(tmp_path / "kept")
    rows = _rows(spark)
    written = paging.put_in_order(rows, _order(), 4, path)
    again = paging.open_ordered(rows, path)
    assert again.starts == written.starts
    assert paging.page(again, 777, 9).collect() == paging.page(written, 777, 9).collect()
