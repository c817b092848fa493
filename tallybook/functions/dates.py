"""Date parsing for the six supported formats, and calendar-month helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions import text
from tallybook.functions.cells import Cell

_M = r"(1[0-2]|0?[1-9])"
_D = r"(3[01]|[12]\d|0?[1-9]| [1-9])"
_Y = r"((?!0000)\d{4})"

# Accepted formats, as patterns and the order of year, month and day in them.
# One- and two-digit months and days are both fine.
DATE_FORMATS = {
    "%Y-%m-%d": (rf"^{_Y}-{_M}-{_D}$", "$1-$2-$3"),
    "%m/%d/%Y": (rf"^{_M}/{_D}/{_Y}$", "$3-$1-$2"),
    "%m/%d/%y": (rf"^{_M}/{_D}/(\d\d)$", "$3-$1-$2"),
    "%d/%m/%Y": (rf"^{_D}/{_M}/{_Y}$", "$3-$2-$1"),
    "%Y/%m/%d": (rf"^{_Y}/{_M}/{_D}$", "$1-$2-$3"),
    "%m-%d-%Y": (rf"^{_M}-{_D}-{_Y}$", "$3-$1-$2"),
}


def date_of(stripped: Column, fmt: str) -> Column:
    """Date of stripped text in the given format, or null. Days must exist in the calendar."""
    pattern, parts = DATE_FORMATS[fmt]
    shaped = F.replace(F.regexp_extract(stripped, pattern, 0), F.lit(" "), F.lit(""))
    iso = shaped if fmt == "%Y-%m-%d" else F.regexp_replace(shaped, pattern, parts)
    if fmt.endswith("%y"):
        # Two-digit years from 69 on belong to the twentieth century.
        century = F.when(iso >= "69", F.lit("19")).otherwise(F.lit("20"))
        iso = F.when(iso != "", F.concat(century, iso))
    return iso.try_cast("date")


def parse_date_text(value: Column, fmt: str) -> Column:
    return date_of(text.strip(value), fmt)


def parse_date(cell: Cell, fmt: str) -> Column:
    """Date of a staged cell, whose text is stripped already."""
    typed = F.substring(cell.value, 1, 10).try_cast("date")
    return F.when(cell.kind == "str", date_of(cell.value, fmt)).when(
        cell.kind.isin("date", "datetime"), typed
    )


def is_month_start(d: Column) -> Column:
    return F.dayofmonth(d) == 1


def is_month_end(d: Column) -> Column:
    return F.last_day(d) == d


def next_month_start(d: Column) -> Column:
    return F.add_months(F.trunc(d, "MM"), 1)


def month_starts(start: Column, end: Column) -> Column:
    """Every first day of a month between two dates, as an array."""
    return F.sequence(F.trunc(start, "MM"), end, F.expr("interval 1 month"))
