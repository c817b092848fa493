"""Files built by Spark from the given tables, one per order, as inputs of the file scans."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.config.settings import ColumnMapping, IngestionConfig
from tallybook.plans import views
from tallybook.session import dealt

# One CSV per order: three delimiters, quotes, a blank record, a short and a long record.
# Some files repeat a header, miss a column or end after the header; some are not UTF-8.
_D = "CASE o_orderkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '|' END"
_HEAD = "CASE WHEN o_orderkey % 11 = 0 THEN 'date' ELSE 'Transaction ID' END"
_ACCOUNT = "CASE WHEN o_orderkey % 13 = 0 THEN 'Bank' ELSE 'Account' END"

EXPORT_CONFIG = IngestionConfig(
    ColumnMapping(
        transaction_date="Date", description="Description", amount="Amount", currency="Currency",
        bank_account="Account",
    ),
)


def order_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dealt(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"))
    d = F.expr(_D)
    key = F.col("o_orderkey").cast("string")
    day = F.col("o_orderdate").cast("date").cast("string")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    about = F.concat(F.lit('"Caf\u00e9'), d, F.lit(' ""best""\n  order '), key, F.lit('"'))
    end = F.lit("\r\n")
    head = F.concat(
        F.expr(_HEAD), d, F.lit("Date"), d, F.lit("Description"), d, F.lit("Amount"), d, F.lit("Currency"), d,
        F.expr(_ACCOUNT),
    )
    bank = F.lit('"Operating  Checking"')
    first = F.concat(F.lit('"ORD-'), key, F.lit('"'), d, F.lit('"'), day, F.lit('"'), d, about, d, F.lit('"'), price,
                     F.lit('"'), d, F.lit('"usd"'), d, bank)
    short = F.concat(F.lit('"S-'), key, F.lit('"'), d, F.lit('"'), day, F.lit('"'), d, F.lit('"Fee"'))
    long = F.concat(F.lit('"L-'), key, F.lit('"'), d, F.lit('"bad"'), d, F.lit('"Fee"'), d, F.lit('"(1.50)"'), d,
                    F.lit('"usd"'), d, bank, d, F.lit('"more"'))
    body = F.concat(end, first, end, end, short, end, long, end)
    text = F.concat(head, F.when(F.col("o_orderkey") % 17 == 0, F.lit("")).otherwise(body))
    latin = F.col("o_orderkey") % 5 == 0
    content = F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return orders.select(F.concat(F.lit("order-"), key, F.lit(".csv")).alias("file_name"), content.alias("content"))


_BASE = f"""e AS (SELECT concat('order-', o_orderkey, '.csv') AS file_name, o_orderkey AS k, {_D} AS d,
    {_HEAD} AS h1, {_ACCOUNT} AS h6, cast(cast(o_orderdate AS date) AS varchar) AS day,
    cast(cast(o_totalprice AS decimal(18,2)) AS varchar) AS price FROM orders)"""

EXPORT_RECORDS_SQL = f"""WITH {_BASE}
SELECT file_name, 1 AS row_no, 6 AS n_cells, concat_ws('~', h1, 'Date', 'Description', 'Amount', 'Currency', h6) AS cells FROM e
UNION ALL SELECT file_name, 2, 6, concat_ws('~', concat('ORD-', k), day, concat('Café', d, ' "best"', chr(10), '  order ', k), price, 'usd', 'Operating  Checking') FROM e WHERE k % 17 <> 0
UNION ALL SELECT file_name, 3, 0, '' FROM e WHERE k % 17 <> 0
UNION ALL SELECT file_name, 4, 3, concat_ws('~', concat('S-', k), day, 'Fee') FROM e WHERE k % 17 <> 0
UNION ALL SELECT file_name, 5, 7, concat_ws('~', concat('L-', k), 'bad', 'Fee', '(1.50)', 'usd', 'Operating  Checking', 'more') FROM e WHERE k % 17 <> 0"""

EXPORT_PROFILE_SQL = f"""WITH {_BASE}
SELECT file_name, cast(CASE WHEN k % 17 = 0 THEN 1 ELSE 5 END AS bigint) AS rows,
    cast(CASE WHEN k % 17 = 0 THEN 6 ELSE 7 END AS bigint) AS columns,
    CASE WHEN k % 5 = 0 AND k % 17 <> 0 THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding, d AS delimiter,
    cast(CASE WHEN k % 17 = 0 THEN 1 ELSE 2 END AS bigint) AS previewed FROM e"""

EXPORT_PROBLEMS_SQL = f"""WITH {_BASE}
SELECT file_name, CASE WHEN k % 11 = 0 THEN 'duplicate_header' WHEN k % 13 = 0 THEN 'missing_mapped_column'
    ELSE 'no_data_rows' END AS code FROM e WHERE k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0"""

EXPORT_TRANSACTIONS_SQL = f"""WITH {_BASE}, ok AS (SELECT * FROM e WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0)
SELECT file_name AS source_file_name, cast(2 AS bigint) AS row_no, NULL::varchar AS source_transaction_id, day AS transaction_date,
    lower(concat('café', d, ' "best" order ', k)) AS description_normalized, price AS amount, 'USD' AS currency,
    'Operating Checking' AS bank_account, 'valid' AS status, '' AS codes FROM ok
UNION ALL SELECT file_name, 3, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid',
    'missing_date,missing_description,missing_amount,missing_currency,missing_bank_account' FROM ok
UNION ALL SELECT file_name, 4, NULL, day, 'fee', NULL, NULL, NULL, 'invalid', 'missing_amount,missing_currency,missing_bank_account' FROM ok
UNION ALL SELECT file_name, 5, NULL, NULL, 'fee', '-1.50', 'USD', 'Operating Checking', 'invalid', 'extra_columns,invalid_date' FROM ok"""


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """Minimal XLSX: text inline, numbers as they are, (n, 'date') as a dated number, '=' a formula."""

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, tuple):
            return f'<c s="1"><v>{value[0]}</v></c>'
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        if value.startswith("="):
            return f"<c><f>{escape(value[1:])}</f><v>0</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        names = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)
        )
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>{names}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
        )
        archive.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        archive.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(cell(v) for v in row)}</row>" for row in rows)
            archive.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()


def order_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workbook per order: a title row, typed cells, a formula."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            books = [
                workbook({
                    "Setup": [["Company"], [o["customer"]]],
                    "Transactions": [
                        ["Date", "Description", "Amount", None, "Paid"],
                        [(o["serial"], "date"), f"Order <{o['o_orderkey']}>", float(o["price"]), o["o_custkey"], True],
                        ["=C2*2"],
                    ],
                })
                for o in batch.to_dict("records")
            ]
            yield pd.DataFrame({"file_name": "book-" + batch["o_orderkey"].astype(str) + ".xlsx", "content": books})

    orders = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.concat(F.lit("C-"), F.col("o_custkey")).alias("customer"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30")).alias("serial"),
        (F.floor(F.col("o_totalprice")) + F.lit(0.5)).alias("price"),
    )
    return dealt(orders).mapInPandas(build, "file_name string, content binary")


WORKBOOK_RECORDS_SQL = """WITH b AS (SELECT concat('book-', o_orderkey, '.xlsx') AS file_name, o_orderkey AS k, o_custkey AS c,
    strftime(cast(o_orderdate AS date), '%Y-%m-%dT00:00:00') AS day, concat(cast(floor(o_totalprice) AS bigint), '.5') AS price FROM orders)
SELECT file_name, 'Setup' AS sheet, 1 AS row_no, 'str:Company' AS cells FROM b
UNION ALL SELECT file_name, 'Setup', 2, concat('str:C-', c) FROM b
UNION ALL SELECT file_name, 'Transactions', 1, 'str:Date~str:Description~str:Amount~~str:Paid' FROM b
UNION ALL SELECT file_name, 'Transactions', 2, concat('datetime:', day, '~str:Order <', k, '>~float:', price, '~int:', c, '~bool:true') FROM b
UNION ALL SELECT file_name, 'Transactions', 3, 'formula:=C2*2' FROM b"""


def faulty(content: bytes, kind: int) -> bytes:
    """A workbook broken in one part, or with an outside link (0); kinds above 7 stay as they are."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = {name: archive.read(name) for name in archive.namelist()}
    sheet = "xl/worksheets/sheet2.xml"
    if kind == 0:
        parts["xl/externalLinks/externalLink1.xml"] = b"<externalLink/>"
    elif kind == 1:
        parts["xl/vbaProject.bin"] = b"macro"
    elif kind == 2:
        del parts["xl/workbook.xml"]
    elif kind == 3:
        parts[sheet] = parts[sheet].replace(b"<row>", b'<row r="2000000">', 1)
    elif kind == 4:
        parts[sheet] = parts[sheet].replace(b"<sheetData>", b'<dimension ref="A1:ZZ9"/><sheetData>')
    elif kind == 5:
        parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace(b"Target", b"Goal")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in parts.items():
            archive.writestr(name, part)
    made = bytearray(buffer.getvalue())
    if kind == 6:  # every member marked as encrypted
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            place = made.find(mark)
            while place >= 0:
                made[place + at] |= 1
                place = made.find(mark, place + 4)
    return bytes(made[:100] if kind == 7 else made)


def faulty_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbooks of all orders; the last digit of the order's key decides what is wrong with one."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = batch["file_name"].str.extract(r"(\d)\.xlsx$")[0].astype(int)
            yield batch.assign(content=[faulty(bytes(c), k) for c, k in zip(batch["content"], kinds)])

    return order_workbooks(spark, sf_dir).mapInPandas(build, "file_name string, content binary")


WORKBOOK_FACTS_SQL = """WITH b AS (SELECT concat('book-', o_orderkey, '.xlsx') AS file_name, o_orderkey % 10 AS k FROM orders)
SELECT file_name, NULL::varchar AS sheet, CASE k WHEN 1 THEN 'unsafe_archive' WHEN 4 THEN 'too_many_columns' ELSE 'invalid_xlsx' END AS code, NULL::int AS formulas,
  NULL::varchar AS warnings FROM b WHERE k BETWEEN 1 AND 7
UNION ALL SELECT file_name, 'Setup', NULL, 0, CASE k WHEN 0 THEN 'external_links' ELSE '' END FROM b WHERE k NOT BETWEEN 1 AND 7
UNION ALL SELECT file_name, 'Transactions', NULL, 1, CASE k WHEN 0 THEN 'external_links' ELSE '' END FROM b WHERE k NOT BETWEEN 1 AND 7"""
