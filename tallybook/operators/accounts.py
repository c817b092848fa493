"""Account resolution and the agreement of transaction types with account types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.constants import ACCOUNT_TYPE_FOR, REFUND_ACCOUNT, TYPES_FOR_DIRECTION
from tallybook.functions import text


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small fixed mapping, null for other keys."""
    result = F.lit(None).cast("string")
    for k, v in mapping.items():
        result = F.when(key == k, F.lit(v)).otherwise(result)
    return result


def with_account(df: DataFrame, accounts: DataFrame, number: str = "account_number") -> DataFrame:
    """Add the catalog entry under `number` as the struct column `account` (null if unknown)."""
    catalog = accounts.select(
        F.col("number").alias("_number"),
        F.struct("number", "name", "account_type", "active").alias("account"),
    )
    return df.join(catalog, text.strip(F.col(number)) == F.col("_number"), "left").drop("_number")


def account_problem(account: Column, name: Column | None = None) -> Column:
    """Why a resolved account cannot be used; null when it can."""
    problem = F.when(account.isNull(), F.lit("unknown_account")).when(
        ~account["active"], F.lit("inactive_account")
    )
    if name is not None:
        problem = problem.when(account["name"] != name, F.lit("account_name_mismatch"))
    return problem


def target_problem(
    transaction_type: Column, account: Column, source_bank_key: Column | None = None
) -> Column:
    """Why a type may not post to an account; null when it may."""
    problem = (
        F.when(
            ~account["account_type"].eqNullSafe(lookup(ACCOUNT_TYPE_FOR, transaction_type)),
            F.lit("account_type_not_allowed"),
        )
        .when(
            (transaction_type == "refund") & (account["number"] != REFUND_ACCOUNT),
            F.lit("refund_needs_refund_account"),
        )
        .when(
            (transaction_type == "revenue") & (account["number"] == REFUND_ACCOUNT),
            F.lit("revenue_on_refund_account"),
        )
    )
    if source_bank_key is not None:
        same = text.fold_name(account["name"]) == source_bank_key
        problem = problem.when((transaction_type == "transfer") & same, F.lit("transfer_to_itself"))
    return problem


def type_allowed(transaction_type: Column, direction: Column) -> Column:
    """Whether an outside proposal or a correction may use the type for the direction."""
    allowed = F.lit(False)
    for side, types in TYPES_FOR_DIRECTION.items():
        allowed = allowed | ((direction == side) & transaction_type.isin(*types))
    return F.coalesce(allowed, F.lit(False))
