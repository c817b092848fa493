"""Scalar expressions against small Python models, with literal and generated inputs."""

import hashlib
import json
import re
import unicodedata
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.functions import dates, hashing, money, text
from tallybook.functions.cells import Cell, row_cells

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def run(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", build(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "given_text, amount",
    [
        ("$1,250.00", "1250.00"), ("($5)", "-5.00"), ("$-5", "-5.00"), ("-$5", None), (".5", "0.50"),
        ("5.", None), ("1,23", None), ("1,234.5", "1234.50"), ("USD 12", "12.00"), ("usd $ 7.1", "7.10"),
        (" ( 5.25 ) ", "-5.25"), ("(-5)", "-5.00"), ("1.005", None), ("n/a", None), ("(", None), ("()", None),
        ("+3.1", "3.10"), ("12345678901234567.00", None), ("(usd 4)", "-4.00"), ("\u00a09.99\u2003", "9.99"),
    ],
)
def test_money_text(spark, given_text, amount):
    [found] = run(spark, [given_text], money.parse_money_text)
    assert found == (None if amount is None else Decimal(amount))


def _model_money(value):
    t = value.strip()
    wrapped = t.startswith("(") and t.endswith(")")
    t = t[1:-1].strip() if wrapped else t
    t = t[4:].strip() if t.upper().startswith("USD ") else t
    t = t[1:].strip() if t.startswith("$") else t
    if not re.fullmatch(r"[+-]?(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{1,2})?|[0-9]*\.[0-9]{1,2})", t):
        return None
    amount = Decimal(t.replace(",", "")).quantize(Decimal("0.01"))
    return -abs(amount) if wrapped else amount


@SLOW
@given(st.lists(st.text(alphabet="0123456789.,$()+- USDusd\t", max_size=9), min_size=80, max_size=120))
def test_money_model(spark, values):
    assert run(spark, values, money.parse_money_text) == [_model_money(v) for v in values]


@pytest.mark.parametrize("kind, value, amount", [
    ("float", "1250.25", "1250.25"), ("float", "0.30000000000000004", None), ("int", "12", "12.00"),
    ("bool", "true", None), ("float", "1e-05", None), ("float", "2.500", "2.50"), ("datetime", "2026-01-01T00:00:00", None),
])
def test_money_typed(spark, kind, value, amount):
    cell = Cell(F.lit(kind), F.lit(value))
    found = spark.range(1).select(money.parse_money(cell).alias("a")).first()["a"]
    assert found == (None if amount is None else Decimal(amount))


@pytest.mark.parametrize("fmt", list(dates.DATE_FORMATS))
def test_dates(spark, fmt):
    shown = [date(1999, 12, 31), date(2024, 2, 29), date(1970, 1, 5), date(2068, 7, 4), date(1969, 3, 9)]
    values = [d.strftime(fmt) for d in shown] + ["", "x", "2024-02-30", "13/13/2024", "1/2/3", "0000-01-01", "2024-1-2", "4/1/2026", " 4/1/26"]

    def model(v):
        try:
            return datetime.strptime(v.strip(), fmt).date()
        except ValueError:
            return None

    assert run(spark, values, lambda c: dates.parse_date_text(c, fmt)) == [model(v) for v in values]


TEXTS = ["  ACME   CUSTOMER  ", "Stra\u00dfe\u00a0 X", "caf\u00e9", "\ufb01ne \u2460", "\x1ctab\tend\x1f", "", "   ", "\u3000A\u2003b", "\u0130x", "plain"]


def test_text_functions(spark):
    assert run(spark, TEXTS, text.strip) == [t.strip() for t in TEXTS]
    assert run(spark, TEXTS, text.collapse) == [" ".join(t.split()) for t in TEXTS]
    assert run(spark, TEXTS, text.casefold) == [t.casefold() for t in TEXTS]
    assert run(spark, TEXTS, text.is_blank) == [not t.strip() for t in TEXTS]
    model = [" ".join(unicodedata.normalize("NFKC", t).split()).casefold() or None for t in TEXTS]
    assert run(spark, TEXTS, text.normalize_description) == model


@SLOW
@given(st.lists(st.text(max_size=12), min_size=60, max_size=100))
def test_text_model(spark, values):
    values = [v.encode("utf-8", "ignore").decode("utf-8") for v in values]
    assert run(spark, values, text.strip) == [v.strip() for v in values]
    assert run(spark, values, text.collapse) == [" ".join(v.split()) for v in values]
    model = [(" ".join(unicodedata.normalize("NFKC", v).split()).casefold() or None) if v.strip() else None for v in values]
    assert run(spark, values, text.normalize_description) == model


def test_fingerprint_is_hash_of_sorted_json(spark):
    rows = [("1250.00", "op \"a\" \\ b", "USD", "caf\u00e9 / x", "2026-04-01"), ("-5.00", "bank", "USD", "plain", "2026-04-02")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, t string")
    made = df.select(
        hashing.fingerprint(F.col("a").cast("decimal(18,2)"), F.col("b"), F.col("c"), F.col("d"), F.col("t").cast("date")).alias("f")
    ).collect()
    for row, found in zip(rows, made):
        body = dict(zip(("amount", "bank_account", "currency", "description", "transaction_date"), row))
        encoded = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
        assert found["f"] == hashlib.sha256(encoded).hexdigest()


def test_raw_hash_keeps_types(spark):
    cells = "array<struct<kind:string,value:string>>"
    df = spark.createDataFrame(
        [(["b", "a", "n", "d"], [("str", "x\"y"), ("int", "3"), (None, None), ("date", "2026-01-02")])],
        f"h array<string>, c {cells}",
    )
    found = df.select(hashing.raw_hash(row_cells(F.col("h"), F.col("c"))).alias("h")).first()["h"]
    body = {"b": 'x"y', "a": 3, "n": None, "d": {"type": "date", "value": "2026-01-02"}}
    encoded = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    assert found == hashlib.sha256(encoded).hexdigest()


def test_external_amount(spark):
    df = spark.createDataFrame(
        [(1, [("7", "Sales"), ("", "1,234.565")]), (2, [("", "x"), ("", " ")]), (3, [("", "2.675"), ("", "n/a")])],
        "i int, c array<struct<id:string,value:string>>",
    )
    found = {r["i"]: r["a"] for r in df.select("i", money.external_amount(F.col("c")).alias("a")).collect()}
    assert found == {1: Decimal("1234.56"), 2: Decimal("0.00"), 3: Decimal("2.68")}
