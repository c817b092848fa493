"""Cells: a value as text with the kind the source gave it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions import text

CELL = "struct<kind:string,value:string>"


@dataclass(frozen=True)
class Cell:
    """Kind is one of str, int, float, decimal, bool, datetime, date, time, or null."""

    kind: Column
    value: Column

    @staticmethod
    def of_text(value: Column) -> Cell:
        return Cell(F.lit("str"), value)

    @staticmethod
    def absent() -> Cell:
        return Cell(F.lit(None).cast("string"), F.lit(None).cast("string"))

    @staticmethod
    def of_map(cells: Column, header: str) -> Cell:
        cell = F.try_element_at(cells, F.lit(header))
        return Cell(cell["kind"], cell["value"])

    def staged(self, name: str) -> tuple[dict[str, Column], Cell]:
        """Columns to add first, and the cell read from them; blank cells become null.

        Staging keeps later expressions from repeating the trim over and over.
        """
        stripped = F.when(self.kind == "str", text.strip(self.value)).otherwise(self.value)
        columns = {
            f"_{name}_kind": self.kind,
            f"_{name}_text": F.when(stripped != "", stripped),
        }
        return columns, Cell(F.col(f"_{name}_kind"), F.col(f"_{name}_text"))


def row_cells(headers: Column, values: Column) -> Column:
    """Cells by header: short rows padded with null, surplus cells under numbered names."""
    empty = F.lit(None).cast(CELL)
    missing = F.greatest(F.size(headers) - F.size(values), F.lit(0))
    surplus = F.greatest(F.size(values) - F.size(headers), F.lit(0))
    extra = F.when(
        surplus > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(surplus, F.lit(1))),
            lambda i: F.concat(F.lit("__extra_column_"), i.cast("string")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    padded = F.concat(values, F.array_repeat(empty, missing))
    return F.map_from_arrays(F.concat(headers, extra), padded)


def tagged_cells(cells: Column) -> Column:
    """Evidence form at rest: an array, so headers never become field names."""
    return F.transform(
        F.map_entries(cells),
        lambda e: F.struct(
            e["key"].alias("column"),
            e["value"]["kind"].alias("kind"),
            e["value"]["value"].alias("value"),
        ),
    )
