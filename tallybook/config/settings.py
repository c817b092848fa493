"""Ingestion settings: which source column feeds which field, and the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from tallybook.functions.dates import DATE_FORMATS


@dataclass(frozen=True)
class ColumnMapping:
    transaction_date: str
    description: str
    amount: str | None = None
    debit_amount: str | None = None
    credit_amount: str | None = None
    source_transaction_id: str | None = None
    posted_date: str | None = None
    currency: str | None = None
    bank_account: str | None = None

    def headers(self) -> list[str]:
        return [h for h in vars(self).values() if h is not None]


@dataclass(frozen=True)
class IngestionConfig:
    """Checked once on the driver; everything row-level happens in columns."""

    mapping: ColumnMapping
    file_type: str = "csv"
    header_row: int = 1
    sheet_name: str | None = None
    date_format: str = "%Y-%m-%d"
    default_currency: str | None = None
    default_bank_account: str | None = None
    problems: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        found = tuple(self._problems())
        object.__setattr__(self, "problems", found)
        if found:
            raise ValueError("; ".join(found))

    def _problems(self):
        m = self.mapping
        split = m.debit_amount is not None or m.credit_amount is not None
        if (m.amount is not None) == split:
            yield "give either one signed amount column or debit/credit columns"
        if m.currency is None and self.default_currency is None:
            yield "give a currency column or a default currency"
        if m.bank_account is None and self.default_bank_account is None:
            yield "give a bank account column or a default bank account"
        code = (self.default_currency or "USD").strip()
        if len(code) != 3 or not code.isalpha():
            yield "the default currency must be three letters"
        if self.default_bank_account is not None and not self.default_bank_account.strip():
            yield "the default bank account must not be blank"
        if self.file_type not in ("csv", "xlsx"):
            yield "file type must be csv or xlsx"
        if self.file_type == "csv" and self.sheet_name is not None:
            yield "a csv file has no sheet"
        if self.header_row < 1:
            yield "header row counts from 1"
        if self.date_format not in DATE_FORMATS:
            yield f"unsupported date format {self.date_format!r}"
