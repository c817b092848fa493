"""Nested P&L reports of an outside ledger, flattened with VARIANT.

Reports: report_id, payload (JSON text), expected_start, expected_end. A report is a header
plus a tree of sections; data rows carry an account id and an amount, sections a group and a
summary. All reports are flattened together, one tree level per step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import money
from tallybook.session import store

# Summary groups a report must carry, and the totals they stand for.
GROUPS = {
    "Income": "total_revenue",
    "COGS": "total_cogs",
    "GrossProfit": "gross_profit",
    "Expenses": "total_operating_expenses",
    "NetIncome": "net_profit",
}
_ROWS = "$.Rows.Row"


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _children(v: Column) -> Column:
    return F.explode(F.try_variant_get(v, _ROWS, "array<variant>"))


def parse_reports(reports: DataFrame) -> DataFrame:
    """Parsed payloads with header fields and the header's problem, if any."""
    parsed = reports.withColumn("doc", F.try_parse_json("payload"))
    doc = F.col("doc")
    start = _text(doc, "$.Header.StartPeriod").try_cast("date")
    end = _text(doc, "$.Header.EndPeriod").try_cast("date")
    currency = _text(doc, "$.Header.Currency")
    problem = (
        F.when(doc.isNull(), F.lit("invalid_json"))
        .when(F.try_variant_get(doc, "$.Header", "variant").isNull(), F.lit("missing_header"))
        .when(~_text(doc, "$.Header.ReportName").eqNullSafe(F.lit("ProfitAndLoss")), F.lit("wrong_report"))
        .when(~_text(doc, "$.Header.ReportBasis").eqNullSafe(F.lit("Cash")), F.lit("not_cash_basis"))
        .when(start.isNull() | end.isNull(), F.lit("invalid_period"))
        .when(
            (start != F.col("expected_start")) | (end != F.col("expected_end")),
            F.lit("other_period"),
        )
        .when(~F.coalesce(F.length(currency) == 3, F.lit(False)), F.lit("invalid_currency"))
        .when(F.try_variant_get(doc, "$.Rows", "variant").isNull(), F.lit("missing_rows"))
    )
    return parsed.select(
        "report_id", "doc", start.alias("start_date"), end.alias("end_date"),
        F.upper(currency).alias("currency"), problem.alias("header_problem"),
    )


def report_rows(parsed: DataFrame) -> DataFrame:
    """Every row of every report's tree, with its depth.

    Each level is stored as text and read once for the next, so the work follows the tree's size.
    """
    level = parsed.select("report_id", _children(F.col("doc")).alias("row"))
    levels = []
    while True:
        stored = store(level.select("report_id", F.to_json("row").alias("json")), "report_level")
        if stored.isEmpty():
            break
        level = stored.select("report_id", F.parse_json("json").alias("row"))
        levels.append(level.withColumn("depth", F.lit(len(levels))))
        level = level.select("report_id", _children(F.col("row")).alias("row"))
    if not levels:
        return level.withColumn("depth", F.lit(0))
    return reduce(DataFrame.unionByName, levels)


_CELLS = "array<struct<id:string,value:string>>"


def data_rows(rows: DataFrame) -> DataFrame:
    """Nonzero data rows: account id (first id among the cells) and amount (last number)."""
    cells = F.try_variant_get(F.col("row"), "$.ColData", _CELLS)
    flat = rows.where(_text(F.col("row"), "$.type") == "Data").select(
        "report_id",
        F.try_element_at(F.filter(F.transform(cells, lambda c: c["id"]), lambda i: i != ""), F.lit(1)).alias("external_id"),
        money.external_amount(cells).alias("amount"),
    )
    return flat.where("amount <> 0")


def section_totals(rows: DataFrame) -> DataFrame:
    cells = F.try_variant_get(F.col("row"), "$.Summary.ColData", _CELLS)
    return rows.where(~_text(F.col("row"), "$.type").eqNullSafe(F.lit("Data"))).select(
        "report_id", _text(F.col("row"), "$.group").alias("group"),
        cells.alias("cells"),
    ).where("group is not null and cells is not null").select(
        "report_id", "group", money.external_amount(F.col("cells")).alias("amount")
    )


def report_lines(data: DataFrame, external: DataFrame) -> DataFrame:
    """Data rows with the outside account they name; `problem` says what is wrong."""
    accounts = external.select(
        F.col("id").alias("external_id"), "account_number", F.col("name").alias("account_name"),
        F.lit(True).alias("_known"),
    )
    repeated = data.groupBy("report_id", "external_id").agg(F.count(F.lit(1)).alias("times"))
    joined = data.join(accounts, "external_id", "left").join(
        repeated.where("times > 1"), ["report_id", "external_id"], "left"
    )
    problem = (
        F.when(F.col("external_id").isNull(), F.lit("missing_account_id"))
        .when(F.col("_known").isNull(), F.lit("unknown_account"))
        .when(F.col("times").isNotNull(), F.lit("repeated_account"))
        .when(F.col("account_number").isNull(), F.lit("unnumbered_account"))
    )
    return joined.select(
        "report_id", "external_id", "account_number", "account_name", "amount", problem.alias("problem")
    )


def report_totals(parsed: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per report: its period, the five totals, missing and repeated groups."""
    wide = sections.groupBy("report_id").agg(
        *[F.max(F.when(F.col("group") == g, F.col("amount"))).alias(name) for g, name in GROUPS.items()],
        *[F.count_if(F.col("group") == g).alias(f"_{name}") for g, name in GROUPS.items()],
    )
    names = list(GROUPS.values())
    missing = F.array_sort(
        F.array_compact(
            F.array(*[F.when(F.coalesce(F.col(f"_{n}"), F.lit(0)) == 0, F.lit(g)) for g, n in GROUPS.items()])
        )
    )
    repeated = F.array_sort(
        F.array_compact(F.array(*[F.when(F.col(f"_{n}") > 1, F.lit(g)) for g, n in GROUPS.items()]))
    )
    joined = parsed.drop("doc").join(wide, "report_id", "left")
    return joined.select(
        "report_id", "start_date", "end_date", "currency", "header_problem", *names,
        missing.alias("missing_groups"), repeated.alias("repeated_groups"),
    )


def report_problems(totals: DataFrame, lines: DataFrame) -> DataFrame:
    """Everything that makes a report untrustworthy, one row per finding."""
    header = totals.where("header_problem is not null").select("report_id", F.col("header_problem").alias("problem"))
    missing = totals.where(F.size("missing_groups") > 0).select(
        "report_id", F.concat(F.lit("missing_totals: "), F.array_join("missing_groups", ", ")).alias("problem")
    )
    repeated = totals.where(F.size("repeated_groups") > 0).select(
        "report_id", F.concat(F.lit("repeated_totals: "), F.array_join("repeated_groups", ", ")).alias("problem")
    )
    rows = lines.where("problem is not null").select(
        "report_id", F.concat("problem", F.lit(": "), F.coalesce("external_id", F.lit("?"))).alias("problem")
    )
    return header.unionByName(missing).unionByName(repeated).unionByName(rows)


def external_statements(reports: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Account lines and totals of the trusted reports, and the problems of the others."""
    parsed = parse_reports(reports)
    rows = report_rows(parsed.where("header_problem is null"))
    lines = report_lines(data_rows(rows), external)
    totals = report_totals(parsed, section_totals(rows))
    problems = report_problems(totals, lines)
    # A report with any problem is refused whole: part of one would reconcile to a wrong result.
    refused = problems.select("report_id").distinct()
    trusted = totals.join(refused, "report_id", "left_anti")
    good = lines.join(trusted.select("report_id", "start_date", "end_date"), "report_id")
    return (
        good.select("start_date", "end_date", "account_number", "account_name", "amount"),
        trusted,
        problems,
    )
