"""Cash-basis profit and loss: entries, lines, statements, drill-down."""

from __future__ import annotations

from datetime import date
from calendar import monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.constants import APPROVED, REPORTED_TYPES, SECTION_FOR
from tallybook.functions import money, text
from tallybook.operators.accounts import (
    account_problem,
    lookup,
    target_problem,
    with_account,
)
from tallybook.operators.duplicates import is_canonical
from tallybook.session import store

TOTAL = "decimal(28,2)"


def check_period(start: date, end: date, currency: str) -> str:
    """Whole calendar months only; returns the currency code."""
    if start > end:
        raise ValueError("the period ends before it starts")
    if start.day != 1:
        raise ValueError("the period must start on the first day of a month")
    if end.day != monthrange(end.year, end.month)[1]:
        raise ValueError("the period must end on the last day of a month")
    code = currency.strip().upper()
    if len(code) != 3 or not code.isalpha():
        raise ValueError("the currency must have three letters")
    return code


def approved_sources(
    transactions: DataFrame, classifications: DataFrame, start: date, end: date, currency: str
) -> DataFrame:
    """Approved, canonical, P&L-typed rows of the period and currency.

    Both sides are filtered before the join, so the scan prunes by date, status and currency.
    """
    facts = transactions.where(
        is_canonical()
        & F.col("transaction_date").between(F.lit(start), F.lit(end))
        & (F.col("currency") == currency)
    ).select(
        "id", "transaction_date", "description_original", "description_normalized",
        "bank_account", "bank_key", "currency", "amount",
    )
    decisions = classifications.where(
        (F.col("review_status") == APPROVED) & F.col("transaction_type").isin(*REPORTED_TYPES)
    ).select("id", "version", "transaction_type", "account_number", "account_name")
    return facts.join(decisions, "id")


def prepare_entries(sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """P&L entries with report signs; `problem` names the evidence error of a row, if any."""
    rows = with_account(sources, accounts)
    account = F.col("account")
    description = text.first_text(F.col("description_original"), F.col("description_normalized"))
    problem = F.coalesce(
        F.when(F.col("transaction_date").isNull(), F.lit("missing_date")),
        F.when(F.col("amount").isNull(), F.lit("missing_amount")),
        F.when(F.col("bank_account").isNull(), F.lit("missing_bank_account")),
        account_problem(account, F.col("account_name")),
        target_problem(F.col("transaction_type"), account, F.col("bank_key")),
        F.when(description.isNull(), F.lit("missing_description")),
        # Presentation signs: revenue is positive, refunds negative, costs paid out.
        F.when(
            ((F.col("transaction_type") == "revenue") & (F.col("amount") <= 0))
            | ((F.col("transaction_type") != "revenue") & (F.col("amount") >= 0)),
            F.lit("wrong_sign"),
        ),
    )
    return rows.select(
        "id",
        "transaction_date",
        F.trunc("transaction_date", "MM").alias("month"),
        lookup(SECTION_FOR, account["account_type"]).alias("section"),
        account["account_type"].alias("account_type"),
        "account_number",
        "account_name",
        "transaction_type",
        description.alias("description"),
        "bank_account",
        "currency",
        F.col("amount").alias("source_amount"),
        money.report_amount(F.col("transaction_type"), F.col("amount")).alias("report_amount"),
        F.col("version").alias("classification_version"),
        problem.alias("problem"),
    )


def entry_problems(entries: DataFrame) -> DataFrame:
    return entries.where("problem is not null").select("id", "problem")


def refuse_broken(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """`rows`, or an error naming how many entries are broken and one of them, in the same job.

    One row of counts is joined to every row, so nothing can be read past a broken entry.
    """
    broken = F.col("problem").isNotNull()
    found = entries.agg(
        F.count_if(broken).alias("_broken"),
        F.min(F.when(broken, F.concat_ws(" ", "id", "problem"))).alias("_sample"),
    )
    checked = rows.join(found, F.lit(True))
    refusal = F.raise_error(F.concat(F.col("_broken").cast("string"), F.lit(" broken P&L rows, e.g. "), F.col("_sample")))
    return checked.where(F.when(F.col("_broken") == 0, F.lit(True)).otherwise(refusal.cast("boolean"))).drop("_broken", "_sample")


def account_lines(entries: DataFrame) -> DataFrame:
    """Totals per month, section and account, and over all months (`month` null).

    Entries are summed once per month and account; the grouping sets then run on that small
    result instead of multiplying the entries.
    """
    base = entries.where("problem is null").groupBy(
        "month", "section", "account_number", "account_name"
    ).agg(
        F.sum("report_amount").cast(TOTAL).alias("total"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    lines = base.groupingSets(
        [
            [F.col("month"), F.col("section"), F.col("account_number"), F.col("account_name")],
            [F.col("section"), F.col("account_number"), F.col("account_name")],
        ],
        "month", "section", "account_number", "account_name",
    ).agg(
        F.sum("total").cast(TOTAL).alias("total"),
        F.sum("transaction_count").alias("transaction_count"),
    )
    return lines


def _section_sum(section: str) -> Column:
    picked = F.when(F.col("section") == section, F.col("total")).otherwise(F.lit(0))
    return F.coalesce(F.sum(picked), F.lit(0)).cast(TOTAL)


def statements(entries: DataFrame, start: date, end: date) -> DataFrame:
    """One row per month of the period, empty months included, and one for the whole period."""
    lines = account_lines(entries)
    totals = lines.groupBy("month").agg(
        _section_sum("revenue").alias("total_revenue"),
        _section_sum("cost_of_goods_sold").alias("total_cogs"),
        _section_sum("operating_expense").alias("total_operating_expenses"),
        F.sum("transaction_count").alias("transaction_count"),
    )
    spine = entries.sparkSession.range(1).select(
        F.explode(
            F.concat(
                F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 month")),
                F.array(F.lit(None).cast("date")),
            )
        ).alias("month")
    )
    joined = spine.join(totals, spine["month"].eqNullSafe(totals["month"]), "left")
    zero = F.lit(0).cast(TOTAL)
    revenue = F.coalesce("total_revenue", zero)
    cogs = F.coalesce("total_cogs", zero)
    expenses = F.coalesce("total_operating_expenses", zero)
    month = spine["month"]
    return joined.select(
        F.when(month.isNull(), F.lit("consolidated")).otherwise(F.lit("monthly")).alias("statement"),
        F.coalesce(month, F.lit(start)).alias("start_date"),
        F.coalesce(F.last_day(month), F.lit(end)).alias("end_date"),
        revenue.alias("total_revenue"),
        cogs.alias("total_cogs"),
        (revenue - cogs).cast(TOTAL).alias("gross_profit"),
        expenses.alias("total_operating_expenses"),
        (revenue - cogs - expenses).cast(TOTAL).alias("net_profit"),
        F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"),
    )


def drilldown_order() -> list[Column]:
    return [F.col(c) for c in ("month", "account_number", "transaction_date", "id")]


def drilldown(entries: DataFrame, account_number: str | None = None, month: date | None = None) -> DataFrame:
    """Entries behind the lines, sorted by month, account, date and id.

    Kept flat: a line may stand for more rows than one task can hold.
    """
    rows = entries.where("problem is null")
    if account_number is not None:
        rows = rows.where(F.col("account_number") == account_number)
    if month is not None:
        rows = rows.where(F.col("month") == F.lit(month))
    return rows.drop("problem").orderBy(*drilldown_order())


def report_set(
    transactions: DataFrame,
    classifications: DataFrame,
    accounts: DataFrame,
    start: date,
    end: date,
    currency: str,
) -> DataFrame:
    """Monthly statements and the consolidated one, in one job; it fails if any entry is broken.

    `entry_problems` of the prepared entries lists what would have to be mended.
    """
    code = check_period(start, end, currency)
    sources = approved_sources(transactions, classifications, start, end, code)
    entries = store(prepare_entries(sources, accounts), "report_entries")
    return refuse_broken(statements(entries, start, end), entries)
