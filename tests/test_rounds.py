"""Resolution reads the keys once and goes on with later rows of shared keys only."""

import pytest
from pyspark.sql import functions as F

from tallybook.operators import duplicates

from test_duplicates import scan, table


@pytest.mark.parametrize("rows", [
    # All rows share a content; then chains over several rounds; then an owner of a source key found after the content's.
    [(f"r{i:03d}", "u", i, f"s{i % 7}", 1) for i in range(60)],
    [r for k in range(5) for r in ((f"a{k}", "u", 2 * k, f"s{k}", k), (f"b{k}", "u", 2 * k + 1, f"s{k + 1}", k))],
    [("a", "u", 1, "s1", 1), ("b", "u", 2, "s2", 1), ("c", "v", 3, "s2", 2), ("d", "v", 4, "s2", 1), ("e", "v", 5, None, 2), ("f", "w", 6, "s9", 3)],
    [(f"n{i}", "u", i, None, i % 4) for i in range(12)],
])
def test_parts_and_whole_equal_a_scan(spark, rows):
    placed = table(spark, rows).withColumns({"place": F.col("seq").cast("long") * 10, "part": F.col("seq") % 8}).localCheckpoint()
    expected = {i: target for i, (_, target) in scan(rows).items() if target}
    for links in (duplicates.resolve_in_parts(placed, "place", "part"), [duplicates.resolve(placed, ["seq"])]):
        found = [r for part in links for r in part.collect()]
        linked = {r["id"]: r["canonical_id"] for r in found if r["match_kind"] != duplicates.CONFLICT}
        assert linked == expected and len(found) == len({r["id"] for r in found})
        states = {i: state for i, (state, _) in scan(rows).items()}
        assert {r["id"] for r in found} == {i for i, state in states.items() if state != "valid"}


def test_keys_are_computed_once(spark, monkeypatch):
    """The resolution of stored rows computes fingerprint and source key in one pass; later steps read numbers."""
    calls = spark.sparkContext.accumulator(0)

    def counted(value):
        calls.add(1)
        return value

    rows = [(f"r{i:03d}", "u", i, f"s{i % 17}" if i % 4 else None, i % 23) for i in range(101)]
    placed = table(spark, rows).withColumns({"place": F.col("seq").cast("long"), "part": F.col("seq") % 8}).localCheckpoint()
    given = placed.withColumn("fingerprint", F.udf(counted, "string")("fingerprint"))
    for part in duplicates.resolve_in_parts(given, "place", "part"):
        part.collect()
    assert 101 <= calls.value <= 3 * 101
