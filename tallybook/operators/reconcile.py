"""Reconciliation of internal statements with reports of an outside ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import text

TOTALS = (
    ("total_revenue", "Total revenue"),
    ("total_cogs", "Total COGS"),
    ("gross_profit", "Gross profit"),
    ("total_operating_expenses", "Total operating expenses"),
    ("net_profit", "Net profit"),
)
PERIOD = ("start_date", "end_date")
_MONEY = "decimal(28,2)"


def period_lines(lines: DataFrame, start, end) -> DataFrame:
    """Account lines (month null = whole period) keyed by period."""
    month = F.col("month")
    return lines.select(
        F.coalesce(month, F.lit(start)).alias("start_date"),
        F.coalesce(F.last_day(month), F.lit(end)).alias("end_date"),
        "account_number", "account_name", F.col("total").alias("amount"),
    )


def _compare(internal: Column, external: Column) -> dict[str, Column]:
    difference = (internal - external).cast(_MONEY)
    return {
        "internal_amount": internal.cast(_MONEY),
        "external_amount": external.cast(_MONEY),
        "difference": difference,
        "reconciled": difference == 0,
    }


def _label(inner: Column, outer: Column) -> Column:
    return (
        F.when(inner.isNull(), outer)
        .when(outer.isNull() | (inner == outer), inner)
        .otherwise(F.concat(inner, F.lit(" / "), outer))
    )


def reconcile_accounts(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Full outer comparison per period and account; a missing side counts as zero."""
    keys = [*PERIOD, "account_number"]
    left = internal.select(*keys, F.col("account_name").alias("inner_name"), F.col("amount").alias("inner"))
    right = external.select(*keys, F.col("account_name").alias("outer_name"), F.col("amount").alias("outer"))
    joined = left.join(right, keys, "full_outer")
    zero = F.lit(0).cast(_MONEY)
    return joined.select(
        *PERIOD,
        F.col("account_number").alias("key"),
        _label(F.col("inner_name"), F.col("outer_name")).alias("label"),
        *[c.alias(n) for n, c in _compare(F.coalesce("inner", zero), F.coalesce("outer", zero)).items()],
    )


def _unpivot(totals: DataFrame, value: str) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"), F.lit(label).alias("label"),
                F.col(key).cast(_MONEY).alias(value),
            )
            for key, label in TOTALS
        ]
    )
    return totals.select(*PERIOD, F.inline(entries))


def reconcile_totals(internal: DataFrame, external: DataFrame) -> DataFrame:
    """The five totals per period; a period that one side lacks is compared with zero and never reconciled."""
    left = _unpivot(internal, "inner").withColumnRenamed("label", "inner_label")
    right = _unpivot(external, "outer").withColumnRenamed("label", "outer_label")
    joined = left.join(right, [*PERIOD, "key"], "full_outer")
    zero = F.lit(0).cast(_MONEY)
    both = F.col("inner_label").isNotNull() & F.col("outer_label").isNotNull()
    compared = _compare(F.coalesce("inner", zero), F.coalesce("outer", zero))
    compared["reconciled"] = compared["reconciled"] & both & F.col("inner").isNotNull() & F.col("outer").isNotNull()
    return joined.select(
        *PERIOD, "key", F.coalesce("inner_label", "outer_label").alias("label"),
        *[c.alias(n) for n, c in compared.items()],
    )


def explain(lines: DataFrame) -> DataFrame:
    reason = F.when(F.col("reconciled"), F.lit("Both amounts match")).otherwise(
        F.lit("The internal amount differs from the outside cash-basis report")
    )
    return lines.withColumns(
        {
            "period": text.period_label(F.col("start_date"), F.col("end_date")),
            "explanation": reason,
        }
    )


def reconcile(
    internal_lines: DataFrame,
    internal_totals: DataFrame,
    external_lines: DataFrame,
    external_totals: DataFrame,
) -> DataFrame:
    """Every account and total of every period, in one job."""
    accounts = reconcile_accounts(internal_lines, external_lines)
    totals = reconcile_totals(internal_totals, external_totals)
    return explain(accounts.unionByName(totals))


def verdicts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PERIOD).agg(
        F.bool_and("reconciled").alias("reconciled"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.col("reconciled")).alias("differences"),
    )


def period_mismatches(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Periods (with currency) that only one side reports."""
    keys = [*PERIOD, "currency"]
    inner, outer = internal.select(*keys).distinct(), external.select(*keys).distinct()
    return (
        inner.exceptAll(outer).withColumn("only_in", F.lit("internal"))
        .union(outer.exceptAll(inner).withColumn("only_in", F.lit("external")))
    )


def missing_numbers(required: DataFrame, external: DataFrame) -> DataFrame:
    """Account numbers with internal activity that the outside ledger lacks."""
    have = external.where("account_number is not null").select("account_number")
    return required.select("account_number").distinct().join(have, "account_number", "left_anti")
