"""Raw record -> normalized transaction: one projection, no shuffle, no row dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.config.settings import IngestionConfig
from tallybook.constants import ERROR, INVALID, VALID, WARNING
from tallybook.functions import dates, hashing, money, text
from tallybook.functions.cells import Cell, tagged_cells
from tallybook.schemas import ISSUE, ISSUES


class Issue(NamedTuple):
    """A condition and the issue it stands for."""

    holds: Column
    entry: Column
    severity: str


def issue(
    holds: Column,
    code: str,
    field: str,
    message: str,
    raw: Column | None = None,
    severity: str = ERROR,
) -> Issue:
    value = F.lit(None).cast("string") if raw is None else raw.cast("string")
    entry = F.struct(
        F.lit(code).alias("code"),
        F.lit(field).alias("field"),
        F.lit(message).alias("message"),
        F.lit(severity).alias("severity"),
        value.alias("raw_value"),
    ).cast(ISSUE)
    return Issue(F.coalesce(holds, F.lit(False)), entry, severity)


def issue_list(issues: Sequence[Issue], *before: Column) -> Column:
    """The issues that hold, in the given order. Concatenation stays inside code generation."""
    none = F.array().cast(ISSUES)
    listed = [F.when(i.holds, F.array(i.entry)).otherwise(none) for i in issues]
    clean = ~reduce(lambda a, b: a | b, [i.holds for i in issues])
    untouched = before[0] if before else none
    return F.when(clean, untouched).otherwise(F.concat(*before, *listed))


def any_error(issues: Sequence[Issue]) -> Column:
    return reduce(lambda a, b: a | b, [i.holds for i in issues if i.severity == ERROR])


def _signed_amount(cell: Cell) -> tuple[Column, list[Issue]]:
    blank, unparsed = cell.value.isNull(), F.col("amount").isNull()
    return money.parse_money(cell), [
        issue(blank, "missing_amount", "amount", "An amount is required"),
        issue(~blank & unparsed, "invalid_amount", "amount",
              "Not an exact two-decimal amount", cell.value),
    ]


def _split_amount(debit: Cell, credit: Cell) -> tuple[Column, list[Issue]]:
    no_debit, no_credit = debit.value.isNull(), credit.value.isNull()
    amount = (
        F.when(~no_debit & no_credit, -F.abs(money.parse_money(debit)))
        .when(no_debit & ~no_credit, F.abs(money.parse_money(credit)))
        .cast(money.MONEY)
    )
    unparsed = F.col("amount").isNull()
    both = F.to_json(F.struct(debit.value.alias("debit"), credit.value.alias("credit")))
    return amount, [
        issue(~no_debit & ~no_credit, "ambiguous_split_amount", "amount",
              "Debit and credit are both given", both),
        issue(no_debit & no_credit, "missing_amount", "amount", "A debit or credit is required"),
        issue(~no_debit & no_credit & unparsed, "invalid_amount", "debit_amount",
              "Not an exact two-decimal amount", debit.value),
        issue(no_debit & ~no_credit & unparsed, "invalid_amount", "credit_amount",
              "Not an exact two-decimal amount", credit.value),
    ]


FIELDS = (
    "source_transaction_id", "transaction_date", "posted_date", "description", "amount",
    "debit_amount", "credit_amount", "currency", "bank_account",
)


def normalize_fields(
    records: DataFrame,
    fields: Mapping[str, Cell],
    config: IngestionConfig,
    extra_columns: Column | None = None,
) -> DataFrame:
    """Add the normalized columns to records, reading each field from the given cell.

    Input columns stay, so callers keep lineage. `extra_columns` holds surplus cell values.
    """
    cells: dict[str, Cell] = {}
    staged: dict[str, Column] = {}
    for name in FIELDS:
        columns, cells[name] = fields.get(name, Cell.absent()).staged(name)
        staged.update(columns)
    # The original description keeps its outer blanks; other fields need only the stripped text.
    original = fields["description"].value
    staged["description_original"] = F.when(text.strip(original) != "", original)

    day, posted = cells["transaction_date"], cells["posted_date"]
    if "amount" in fields:
        amount, amount_issues = _signed_amount(cells["amount"])
    else:
        amount, amount_issues = _split_amount(cells["debit_amount"], cells["credit_amount"])

    currency_text = F.coalesce(cells["currency"].value, F.lit(config.default_currency))
    bank_text = F.coalesce(cells["bank_account"].value, F.lit(config.default_bank_account))
    parsed = records.withColumns(staged).withColumns(
        {
            "source_transaction_id": cells["source_transaction_id"].value,
            "transaction_date": dates.parse_date(day, config.date_format),
            "posted_date": dates.parse_date(posted, config.date_format),
            "description_normalized": text.normalize_description(F.col("description_original")),
            "amount": amount,
            "currency": F.nullif(
                F.regexp_extract(F.upper(currency_text), r"^\p{L}{3}$", 0), F.lit("")
            ),
            "bank_account": text.normalized_text(bank_text),
        }
    )

    # Folded once here, so that no later join or rule has to fold again.
    parsed = parsed.withColumns(
        {
            "bank_key": text.casefold(F.col("bank_account")),
            "source_id_key": text.casefold(F.col("source_transaction_id")),
        }
    )

    on, posted_on = F.col("transaction_date"), F.col("posted_date")
    form = f"Not a date of the form {config.date_format}"
    issues = [
        issue(day.value.isNull(), "missing_date", "transaction_date",
              "A transaction date is required"),
        issue(day.value.isNotNull() & on.isNull(), "invalid_date", "transaction_date", form,
              day.value),
        issue(posted.value.isNotNull() & posted_on.isNull(), "invalid_date", "posted_date", form,
              posted.value),
        issue(F.col("description_normalized").isNull(), "missing_description", "description",
              "A description is required"),
        *amount_issues,
        issue(F.col("amount") == 0, "zero_amount", "amount", "Zero amounts need a person",
              F.col("amount")),
        issue(currency_text.isNull(), "missing_currency", "currency", "A currency is required"),
        issue(currency_text.isNotNull() & F.col("currency").isNull(), "invalid_currency",
              "currency", "A currency has three letters", currency_text),
        issue(F.col("bank_account").isNull(), "missing_bank_account", "bank_account",
              "A bank account is required"),
        issue(posted_on < on, "posted_before_transaction", "posted_date",
              "Posted before the transaction", posted.value, WARNING),
    ]
    if extra_columns is not None:
        issues.insert(0, issue(F.size(extra_columns) > 0, "extra_columns", "_record",
                               "More cells than header columns", F.to_json(extra_columns)))

    return parsed.withColumns(
        {
            "validation_issues": issue_list(issues),
            "direction": money.direction(F.col("amount")),
            "fingerprint": hashing.fingerprint(
                F.col("amount"), F.col("bank_key"), F.col("currency"),
                F.col("description_normalized"), F.col("transaction_date"),
            ),
            "status": F.when(any_error(issues), F.lit(INVALID)).otherwise(F.lit(VALID)),
            "duplicate_of": F.lit(None).cast("string"),
        }
    ).drop(*[c for c in staged if c.startswith("_")])


def normalize_records(records: DataFrame, config: IngestionConfig) -> DataFrame:
    """Normalize scanned data rows carrying `cells` (map of header to cell) and lineage.

    Needs upload_id, source_sheet, source_row_number, headers and cells.
    """
    cells = F.col("cells")
    fields = {
        name: Cell.of_map(cells, header)
        for name, header in vars(config.mapping).items()
        if header is not None
    }
    surplus = F.transform(
        F.filter(F.map_entries(cells), lambda e: ~F.array_contains(F.col("headers"), e["key"])),
        lambda e: e["value"]["value"],
    )
    raw_id = hashing.lineage_id(
        F.col("upload_id"), F.col("source_sheet"), F.col("source_row_number")
    )
    lineage = records.withColumns(
        {
            "raw_record_id": raw_id,
            "id": hashing.lineage_id(F.lit("transaction"), raw_id),
            "raw_hash": hashing.raw_hash(cells),
        }
    )
    return normalize_fields(lineage, fields, config, surplus)


def raw_evidence(records: DataFrame) -> DataFrame:
    """Immutable evidence rows with type-tagged cells."""
    return records.select(
        "raw_record_id", "upload_id", "source_file_name", "source_sheet", "source_row_number",
        tagged_cells(F.col("cells")).alias("raw_values"), "raw_hash",
    )
