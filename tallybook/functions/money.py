"""Money parsing. Text is checked before the cast, because a cast alone would round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions import text
from tallybook.functions.cells import Cell

MONEY = "decimal(18,2)"

# Fixed value: accepted money text after signs of currency and parentheses are gone.
MONEY_PATTERN = r"^[+-]?(?:\d+(?:,\d{3})*(?:\.\d{1,2})?|\d*\.\d{1,2})$"
# A typed number whose digits beyond the cents are all zero.
_NUMBER_PATTERN = r"^-?\d+(?:\.\d{1,2}0*)?$"


def _general_amount(stripped: Column) -> Column:
    bare = F.regexp_replace(stripped, rf"(?s)^\({text.WS}*(.*?){text.WS}*\)$", "$1")
    no_code = F.regexp_replace(bare, rf"^(?i:USD ){text.WS}*", "")
    no_sign = F.regexp_replace(no_code, rf"^\${text.WS}*", "")
    digits = F.regexp_extract(no_sign, MONEY_PATTERN, 0)
    amount = F.regexp_replace(digits, ",", "").try_cast(MONEY)
    in_parentheses = stripped.startswith("(") & stripped.endswith(")")
    return F.when(in_parentheses, -F.abs(amount)).otherwise(amount).cast(MONEY)


def amount_of(stripped: Column) -> Column:
    """Exact two-decimal amount of stripped text, or null when it is not one.

    Plain `-12.34` and `(12.34)`, nearly all of a bank's rows, skip the general steps.
    """
    plain = stripped.rlike(r"^(?:\(\d+\.\d\d\)|-?\d+\.\d\d)$")
    quick = F.translate(stripped, "()", "-").try_cast(MONEY)
    return F.when(plain, quick).otherwise(_general_amount(stripped)).cast(MONEY)


def parse_money_text(value: Column) -> Column:
    return amount_of(text.strip(value))


def parse_money(cell: Cell) -> Column:
    """Amount of a staged cell, whose text is stripped already."""
    typed = F.when(cell.value.rlike(_NUMBER_PATTERN), cell.value.try_cast(MONEY))
    return (
        F.when(cell.kind == "str", amount_of(cell.value))
        .when(cell.kind.isin("int", "float", "decimal"), typed)
        .otherwise(F.lit(None))
        .cast(MONEY)
    )


def direction(amount: Column) -> Column:
    return F.when(amount > 0, F.lit("inflow")).when(amount < 0, F.lit("outflow"))


def report_amount(transaction_type: Column, amount: Column) -> Column:
    """Presentation sign: income keeps the bank's sign, costs turn positive."""
    keeps = transaction_type.isin("revenue", "refund")
    return F.when(keeps, amount).otherwise(-amount).cast(MONEY)


def external_amount(cells: Column) -> Column:
    """Last numeric cell of a report row, to the cent (half even); 0 when there is none."""
    numbers = F.filter(
        F.transform(
            cells,
            lambda c: F.regexp_replace(text.strip(c["value"]), ",", "").try_cast("decimal(38,10)"),
        ),
        lambda n: n.isNotNull(),
    )
    last = F.try_element_at(numbers, F.lit(-1))
    return F.coalesce(F.bround(last, 2).cast(MONEY), F.lit(0).cast(MONEY))
