"""Plan for bringing an outside ledger's accounts in line with the chart of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.config.defaults import EXTERNAL_DETAIL, EXTERNAL_TYPE
from tallybook.functions import text
from tallybook.operators.accounts import lookup


def catalog_diff(accounts: DataFrame, external: DataFrame) -> DataFrame:
    """Per active account: create, update, reuse, or a problem that blocks it."""
    entry = F.struct("id", "name", "account_number", "account_type", "account_sub_type", "active")
    by_number = external.where("account_number is not null").groupBy("account_number").agg(
        F.count(F.lit(1)).alias("number_matches"), F.min(entry).alias("by_number")
    )
    folded = external.withColumn("name_key", text.casefold(F.col("name")))
    by_name = folded.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("name_matches"), F.min(entry).alias("by_name")
    )
    desired = accounts.where("active").withColumns(
        {
            "name_key": text.casefold(F.col("name")),
            "expected_type": lookup(EXTERNAL_TYPE, F.col("account_type")),
            "expected_detail": lookup(EXTERNAL_DETAIL, F.col("detail_type")),
        }
    )
    joined = desired.join(
        by_number.withColumnRenamed("account_number", "number"), "number", "left"
    ).join(by_name, "name_key", "left")
    joined = joined.withColumn("current", F.coalesce("by_number", "by_name"))
    current = F.col("current")
    problem = (
        F.when(F.col("number_matches") > 1, F.lit("number_used_more_than_once"))
        .when(F.col("name_matches") > 1, F.lit("name_used_more_than_once"))
        .when(
            F.col("by_number.id") != F.col("by_name.id"), F.lit("number_and_name_belong_to_different_accounts")
        )
        .when(F.col("expected_type").isNull(), F.lit("unsupported_type"))
        .when(F.col("expected_detail").isNull(), F.lit("unsupported_detail_type"))
        .when(current["account_type"] != F.col("expected_type"), F.lit("incompatible_type"))
        .when(
            text.casefold(current["name"]) != F.col("name_key"), F.lit("number_taken_by_other_name")
        )
    )
    stale = ~current["account_number"].eqNullSafe(F.col("number")) | ~current["active"]
    action = (
        F.when(problem.isNotNull(), F.lit("blocked"))
        .when(current.isNull(), F.lit("create"))
        .when(stale, F.lit("update"))
        .otherwise(F.lit("reuse"))
    )
    differs = current.isNotNull() & ~current["account_sub_type"].eqNullSafe(F.col("expected_detail"))
    return joined.select(
        "number", "name", "expected_type", "expected_detail",
        action.alias("action"), problem.alias("problem"),
        current["id"].alias("external_id"),
        F.when(problem.isNull() & differs, F.coalesce(current["account_sub_type"], F.lit("unspecified"))).alias("detail_in_use"),
    )


def account_payloads(diff: DataFrame, accounts: DataFrame) -> DataFrame:
    """JSON bodies of the creates and updates."""
    rows = diff.join(accounts.select("number", "purpose"), "number")
    create = F.to_json(
        F.struct(
            F.col("name").alias("Name"), F.col("number").alias("AcctNum"),
            F.col("expected_type").alias("AccountType"),
            F.col("expected_detail").alias("AccountSubType"),
            F.col("purpose").alias("Description"), F.lit(True).alias("Active"),
        )
    )
    update = F.to_json(
        F.struct(
            F.col("external_id").alias("Id"), F.lit(True).alias("sparse"),
            F.col("number").alias("AcctNum"), F.lit(True).alias("Active"),
            F.col("purpose").alias("Description"),
        )
    )
    body = F.when(F.col("action") == "create", create).when(F.col("action") == "update", update)
    return rows.where(F.col("action").isin("create", "update")).select(
        "number", "action", body.alias("payload")
    )
