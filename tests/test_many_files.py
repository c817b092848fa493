"""Scans of many small files: work is dealt out, small sheets are parsed once, files share arrays."""

import io
import zipfile

import pyarrow as pa

from tallybook.plans import fixtures
from tallybook.sources import scan, xlsx

SF_DIR = "/root/testdata/sf0.001"


def test_files_of_orders_are_dealt_out(spark):
    """One small table of orders is one task of a scan; its files are many."""
    tasks = spark.sparkContext.defaultParallelism
    for build in (fixtures.order_exports, fixtures.order_workbooks):
        made = build(spark, SF_DIR)
        assert made.rdd.getNumPartitions() >= tasks > 1
        assert made.select("file_name").distinct().count() == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()


def test_small_sheets_are_parsed_once(monkeypatch):
    """A sheet of one chunk is kept; one of more chunks is read again, with the same rows."""
    parsed = []
    rows = xlsx.Workbook.rows
    monkeypatch.setattr(xlsx.Workbook, "rows", lambda self, sheet: parsed.append(sheet) or rows(self, sheet))
    book = fixtures.workbook({"A": [["x", 1]], "Empty": [], "B": [["h"], *[[i] for i in range(50)]]})
    whole = list(scan._file_parts(book, "xlsx", 1))
    assert parsed == ["A", "Empty", "B"]
    monkeypatch.setattr(scan, "CHUNK_CELLS", 10)
    parsed.clear()
    again = list(scan._file_parts(book, "xlsx", 1))
    assert parsed.count("A") == 1 and parsed.count("B") > 1
    one, other = scan._batch(whole, 1).to_pylist(), scan._batch(again, 1).to_pylist()
    assert one == other and len(one) == 3 + 1 + 51


def test_files_share_a_batch(spark):
    """Facts, refusals and records of many files come in one batch of rows, each with its own names."""
    found = []
    for digest, content, kind in (("a", b"x,y\r\n1,2\r\n\r\n3", "csv"), ("b", b"", "csv"), ("c", b"no workbook", "xlsx"), ("d", "h\ncafé".encode("latin-1"), "csv")):
        found += [({"file_sha256": digest} | facts, chunk, number) for facts, chunk, number in scan._file_parts(content, kind, 1)]
    batch = scan._batch(found, 1)
    assert isinstance(batch, pa.RecordBatch)
    got = [(r["file_sha256"], r["row_no"], r["code"], r["headers"], r["cells"] and [c["value"] for c in r["cells"]]) for r in batch.to_pylist()]
    assert got == [
        ("a", 0, None, ["x", "y"], None), ("a", 1, None, None, ["x", "y"]), ("a", 2, None, ["x", "y"], ["1", "2"]),
        ("a", 3, None, ["x", "y"], []), ("a", 4, None, ["x", "y"], ["3"]), ("b", 0, "invalid_csv", None, None),
        ("c", 0, "invalid_xlsx", None, None), ("d", 0, None, ["h"], None), ("d", 1, None, None, ["h"]), ("d", 2, None, ["h"], ["café"]),
    ]


def test_damage_behind_the_first_chunk_refuses_the_book(monkeypatch):
    """A sheet that breaks after a full chunk is refused, as one that breaks at once."""
    monkeypatch.setattr(scan, "CHUNK_ROWS", 3)
    book = fixtures.workbook({"A": [[i] for i in range(9)]})
    buffer = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(buffer, "w") as new:
        for name in old.namelist():
            part = old.read(name)
            new.writestr(name, part[:-30] if name.endswith("sheet1.xml") else part)
    [(facts, chunk, _)] = scan._file_parts(buffer.getvalue(), "xlsx", 1)
    assert facts == {"code": "invalid_xlsx"} and chunk is None
