"""Classification cascade: learned pattern, else rule, else outside proposal, else a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.constants import REVIEW_THRESHOLD, SENSITIVE_TYPES, SOURCE_EXTERNAL
from tallybook.operators.accounts import (
    account_problem,
    target_problem,
    type_allowed,
    with_account,
)
from tallybook.operators.duplicates import is_canonical
from tallybook.operators.patterns import match_patterns
from tallybook.operators.rules import match_rules
from tallybook.schemas import CONFIDENCE

ALREADY, PATTERN, RULE, EXTERNAL, MANUAL, FAILED = (
    "already_classified", "learned_pattern", "deterministic_rule", "gemini",
    "manual_review_required", "failed",
)


def proposal_requests(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """One JSON request per transaction for an outside classifier, with the active accounts."""
    # One row that holds the catalog: a request carries it whole, so a task must hold it anyway.
    entry = F.struct("number", "name", "account_type", "statement", "purpose")
    catalog = accounts.where("active").agg(F.array_sort(F.collect_list(entry)).alias("allowed_accounts"))
    request = F.to_json(
        F.struct(
            F.col("id").alias("transaction_id"), "transaction_date", "description_original",
            "description_normalized", F.col("amount").cast("string").alias("amount"), "currency",
            "bank_account", "direction",
            "allowed_accounts",
        )
    )
    complete = (
        is_canonical() & F.col("transaction_date").isNotNull() & F.col("amount").isNotNull()
        & F.col("description_normalized").isNotNull() & F.col("currency").isNotNull()
        & F.col("bank_account").isNotNull() & F.col("direction").isNotNull()
    )
    return transactions.where(complete).join(catalog, F.lit(True)).select("id", request.alias("request"))


def _needs_review(confidence: Column, transaction_type: Column) -> Column:
    return (confidence < F.lit(REVIEW_THRESHOLD).cast(CONFIDENCE)) | transaction_type.isin(
        *SENSITIVE_TYPES
    )


def judge_proposals(transactions: DataFrame, proposals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add the struct column `proposal` with its `problem`, null where there is none.

    Proposals: id, transaction_type, account_number, counterparty_name, confidence, explanation.
    """
    side = with_account(proposals, accounts).select(
        "id",
        F.struct(
            "transaction_type", "counterparty_name", "account_number", "confidence",
            "explanation", "account",
        ).alias("p"),
    )
    joined = transactions.join(side, "id", "left")
    p = F.col("p")
    confidence = p["confidence"].cast(CONFIDENCE)
    problem = F.coalesce(
        account_problem(p["account"]),
        F.when(~type_allowed(p["transaction_type"], F.col("direction")), F.lit("type_not_allowed_for_direction")),
        target_problem(p["transaction_type"], p["account"], F.col("bank_key")),
        F.when(confidence.isNull() | (confidence < 0) | (confidence > 1), F.lit("confidence_out_of_range")),
    )
    judged = F.struct(
        p["transaction_type"].alias("transaction_type"),
        p["counterparty_name"].alias("counterparty_name"),
        p["account_number"].alias("account_number"),
        p["account"]["name"].alias("account_name"),
        confidence.alias("confidence"),
        F.concat(F.lit("Proposed by an outside classifier: "), p["explanation"]).alias("explanation"),
        F.lit(SOURCE_EXTERNAL).alias("source"),
        _needs_review(confidence, p["transaction_type"]).alias("review_required"),
        problem.alias("problem"),
    )
    return joined.withColumn("proposal", F.when(p.isNotNull(), judged)).drop("p")


_FIELDS = (
    "transaction_type", "counterparty_name", "account_number", "account_name", "confidence",
    "explanation", "source", "review_required", "problem",
)


def classify(
    transactions: DataFrame,
    patterns: DataFrame,
    rules: DataFrame,
    accounts: DataFrame,
    proposals: DataFrame | None = None,
    classified: DataFrame | None = None,
) -> DataFrame:
    """One outcome per canonical transaction, with its decision where there is one.

    A pattern or rule that no longer fits the catalog, or an unusable proposal, makes the row
    `failed`; the job goes on. `proposals=None` means outside classification is switched off;
    a missing proposal means it was not available. `classified` holds ids decided before.
    """
    rows = transactions.where(is_canonical())
    if classified is not None:
        known = classified.select("id", F.lit(True).alias("_known"))
        rows = rows.join(known, "id", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("boolean"))
    rows = match_rules(match_patterns(rows, patterns, accounts), rules, accounts)
    if proposals is not None:
        rows = judge_proposals(rows, proposals, accounts)
        reason = "gemini_unavailable"
    else:
        empty = "struct<" + ",".join(
            f"{f}:{CONFIDENCE if f == 'confidence' else 'boolean' if f == 'review_required' else 'string'}"
            for f in _FIELDS
        ) + ">"
        rows = rows.withColumn("proposal", F.lit(None).cast(empty))
        reason = "gemini_disabled"

    picks = [F.struct(*[F.col(c)[f].alias(f) for f in _FIELDS]) for c in ("pattern", "rule", "proposal")]
    pick = F.coalesce(
        *[F.when(F.col(c).isNotNull(), s) for c, s in zip(("pattern", "rule", "proposal"), picks)]
    )
    rows = rows.withColumn("_pick", pick)
    problem = F.col("_pick.problem")
    outcome = (
        F.when(F.col("_known"), F.lit(ALREADY))
        .when(problem.isNotNull(), F.lit(FAILED))
        .when(F.col("pattern").isNotNull(), F.lit(PATTERN))
        .when(F.col("rule").isNotNull(), F.lit(RULE))
        .when(F.col("proposal").isNotNull(), F.lit(EXTERNAL))
        .otherwise(F.lit(MANUAL))
    )
    rows = rows.withColumn("outcome", outcome)
    decided = F.col("outcome").isin(PATTERN, RULE, EXTERNAL)
    fields = {
        f: F.when(decided, F.col("_pick")[f]) for f in _FIELDS if f != "problem"
    }
    fields["counterparty_raw"] = F.when(
        decided & F.col("_pick.counterparty_name").isNotNull(), F.col("description_original")
    )
    fields["error"] = F.when(F.col("outcome") == FAILED, problem)
    fields["manual_reason"] = F.when(F.col("outcome") == MANUAL, F.lit(reason))
    fields["rule_id"] = F.when(F.col("outcome") == RULE, F.col("rule.rule_id"))
    fields["pattern_id"] = F.when(F.col("outcome") == PATTERN, F.col("pattern.pattern_id"))
    return rows.withColumns(fields).drop("_known", "_pick", "pattern", "rule", "proposal")


def initial_classifications(outcomes: DataFrame) -> DataFrame:
    """Version-one classification rows for every decided outcome."""
    return outcomes.where(F.col("outcome").isin(PATTERN, RULE, EXTERNAL)).select(
        "id", F.lit(1).alias("version"), "transaction_type", "counterparty_raw",
        "counterparty_name", "account_number", "account_name", "confidence", "explanation",
        "source", "review_required", F.lit("pending").alias("review_status"),
    )


def batch_summary(transactions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counters per upload; `balanced` says whether every record is accounted for."""
    totals = transactions.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(is_canonical()).alias("canonical_transactions"),
    )
    counters = outcomes.groupBy("upload_id").agg(
        *[
            F.count_if(F.col("outcome") == kind).alias(name)
            for kind, name in (
                (ALREADY, "already_classified"),
                (PATTERN, "classified_by_learned_pattern"),
                (RULE, "classified_by_deterministic_rule"),
                (EXTERNAL, "classified_by_gemini"),
                (MANUAL, "manual_review_required"),
                (FAILED, "failed"),
            )
        ]
    )
    joined = totals.join(counters, "upload_id", "left").na.fill(0)
    parts = [c for c in counters.columns if c != "upload_id"]
    total = sum((F.col(c) for c in parts), F.lit(0))
    return joined.withColumns(
        {
            "ignored_noncanonical": F.col("total_records") - F.col("canonical_transactions"),
            "balanced": total == F.col("canonical_transactions"),
        }
    )
