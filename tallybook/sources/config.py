"""Configuration sources: chart of accounts and rules, from JSON or from the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.config import defaults
from tallybook.functions import text
from tallybook.schemas import ACCOUNT, RULE_COLUMNS


def default_chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, True) for row in defaults.ACCOUNTS], ACCOUNT)


def default_rules(spark: SparkSession) -> DataFrame:
    """Default rules as a table; phrases are cleaned the way stored ones are."""
    names = {a[0]: a[1] for a in defaults.ACCOUNTS}
    rows = [
        (
            rule_id, priority, phrases.get("exact", []), phrases.get("all", []),
            phrases.get("any", []), phrases.get("none", []), direction, bank, kind, account,
            names[account], confidence, f"{kind} booked to {names[account]}",
        )
        for rule_id, priority, phrases, direction, bank, kind, account, confidence in defaults.RULES
    ]
    layout = """id string, priority int, description_exact array<string>,
        description_all array<string>, description_any array<string>,
        description_none array<string>, direction string, bank_account string,
        transaction_type string, account_number string, account_name string,
        confidence string, explanation string"""
    table = spark.createDataFrame(rows, layout)
    return clean_rules(
        table.withColumns(
            {
                "active": F.lit(True),
                "currency": F.lit("USD"),
                "counterparty_name": F.lit(None).cast("string"),
                "review_required": F.lit(False),
            }
        )
    )


def clean_rules(rules: DataFrame) -> DataFrame:
    cleaned = rules.withColumns(
        {
            **{c: text.clean_phrases(F.col(c)) for c in
               ("description_exact", "description_all", "description_any", "description_none")},
            "bank_account": text.fold_name(F.col("bank_account")),
            "currency": F.upper(text.strip(F.col("currency"))),
            "confidence": F.col("confidence").cast("decimal(10,9)"),
        }
    )
    return cleaned.select(*RULE_COLUMNS)


def load_chart(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of a JSON catalog: {company_name, accounts: [{number, name, ...}]}."""
    account = """struct<number:string,name:string,qbo_account_type:string,
        suggested_detail_type:string,statement:string,purpose:string,active:boolean>"""
    catalog = spark.read.schema(f"company_name string, accounts array<{account}>").json(
        path, multiLine=True
    )
    rows = catalog.select(F.inline("accounts"))
    return rows.select(
        text.strip(F.col("number")).alias("number"),
        text.strip(F.col("name")).alias("name"),
        F.col("qbo_account_type").alias("account_type"),
        F.col("suggested_detail_type").alias("detail_type"),
        "statement", "purpose",
        F.coalesce("active", F.lit(True)).alias("active"),
    )


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file: {rules: [{id, priority, active, match, outcome}]}."""
    phrases = ",".join(
        f"{name}:array<string>"
        for name in ("description_exact", "description_contains_all",
                     "description_contains_any", "description_excludes")
    )
    match = f"struct<{phrases},direction:string,bank_account:string,currency:string>"
    outcome = """struct<transaction_type:string,account_number:string,account_name:string,
        counterparty_name:string,confidence_score:string,explanation:string,review_required:boolean>"""
    rule = f"struct<id:string,priority:int,active:boolean,match:{match},outcome:{outcome}>"
    rows = spark.read.schema(f"rules array<{rule}>").json(path, multiLine=True)
    rows = rows.select(F.inline("rules"))
    none = F.array().cast("array<string>")
    return clean_rules(
        rows.select(
            "id", "priority", F.coalesce("active", F.lit(True)).alias("active"),
            F.coalesce("match.description_exact", none).alias("description_exact"),
            F.coalesce("match.description_contains_all", none).alias("description_all"),
            F.coalesce("match.description_contains_any", none).alias("description_any"),
            F.coalesce("match.description_excludes", none).alias("description_none"),
            "match.direction", "match.bank_account", "match.currency",
            "outcome.transaction_type", "outcome.account_number", "outcome.account_name",
            "outcome.counterparty_name",
            F.col("outcome.confidence_score").alias("confidence"),
            "outcome.explanation", "outcome.review_required",
        )
    )
