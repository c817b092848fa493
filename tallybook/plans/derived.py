"""Inputs derived from the given tables for operators that need more than bank exports.

The SQL texts run unchanged in Spark and DuckDB; they read `canonical` (canonical transactions)
or the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.config import defaults
from tallybook.operators.rules import match_rules
from tallybook.plans import stages, views
from tallybook.session import in_parts
from tallybook.sources import config

# A learned pattern per twentieth customer; some inactive, some naming an unknown account.
PATTERNS = """
SELECT concat('pattern-', cast(c_custkey AS string)) AS id,
       lower(concat('auto pay ', c_name, ' service plan ', c_mktsegment)) AS description_normalized,
       'Operating Checking' AS bank_account, 'inflow' AS direction, 'USD' AS currency,
       c_custkey % 40 = 0 AS active, concat('source-', cast(c_custkey AS string)) AS source_transaction_id,
       'revenue' AS transaction_type, concat('Customer ', cast(c_custkey AS string)) AS counterparty_name,
       CASE WHEN c_custkey % 120 = 0 THEN '4999' ELSE '4000' END AS account_number,
       'Repair Service Revenue' AS account_name, '1.000' AS confidence,
       'stored_correction' AS source, false AS review_required
FROM customer WHERE c_custkey % 20 = 0
"""

# Outside proposals for deposits; some missing, some unusable.
PROPOSALS = """
SELECT id,
       CASE WHEN row_no % 70 = 0 THEN 'operating_expense' WHEN row_no % 110 = 0 THEN 'owner_contribution'
            ELSE 'revenue' END AS transaction_type,
       CASE WHEN row_no % 130 = 0 THEN '9999' WHEN row_no % 70 = 0 THEN '6000'
            WHEN row_no % 110 = 0 THEN '3000' WHEN row_no % 170 = 0 THEN '4100' ELSE '4000' END AS account_number,
       CASE WHEN row_no % 20 = 0 THEN 'Depositor' END AS counterparty_name,
       concat('0.', lpad(cast(row_no % 1000 AS string), 3, '0')) AS confidence,
       'deposit of a customer' AS explanation
FROM canonical WHERE description_normalized LIKE 'deposit %' AND row_no % 30 <> 0
"""

# Review commands: an event of user u concerns order u.
COMMANDS = """
SELECT lpad(cast(event_id AS string), 12, '0') AS command_id, concat('ORD-', cast(user_id AS string)) AS target,
       ts AS at,
       CASE event_type WHEN 'view' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'correct' END AS kind,
       cast(1 + event_id % 5 AS int) AS expected_version,
       CASE WHEN event_id % 7 = 0 THEN 'operating_expense' ELSE 'revenue' END AS transaction_type,
       CASE WHEN event_id % 11 = 0 THEN '9999' WHEN event_id % 2 = 0 THEN '4000' ELSE '4010' END AS account_number,
       CASE WHEN event_id % 3 = 0 THEN concat('Party ', cast(event_id % 4 AS string)) END AS counterparty_name,
       event_type AS reason, concat('reviewer-', cast(event_id % 9 AS string)) AS reviewer_id,
       CASE WHEN event_id % 4 = 0 THEN concat('note ', cast(event_id AS string)) END AS notes
FROM events
"""

# Sync events: user u stands for posting u.
SYNC_EVENTS = """
SELECT lpad(cast(event_id AS string), 12, '0') AS event_id, concat('je-', cast(user_id AS string)) AS request_id,
       ts AS at,
       CASE WHEN event_type IN ('view', 'signup') THEN 'claim'
            WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'succeed'
            WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'permanent' ELSE 'retryable' END AS kind,
       cast(1 + event_id % 3 AS int) AS expected_attempt
FROM events
"""

# Posting attempts with their responses, one per event.
ATTEMPTS = """
SELECT cast(event_id AS string) AS event_id, concat('je-', cast(user_id AS string)) AS request_id,
       CASE WHEN event_type = 'error' THEN cast(400 + event_id % 105 AS int) END AS http_status,
       event_type = 'click' AND event_id % 3 = 0 AS transport_error,
       event_type = 'view' AND event_id % 5 = 0 AS bad_response,
       CASE WHEN event_id % 4 = 0 THEN concat('P', cast(event_id % 9 AS string)) END AS provider_code,
       concat('  answer   of ', event_type, '  ', props) AS message
FROM events
"""

# Accounts of an outside ledger that grows with the suppliers.
SUPPLIER_ACCOUNTS = """
SELECT cast(s_suppkey AS string) AS id, '0' AS sync_token,
       CASE WHEN s_suppkey % 50 = 7 THEN 'repair service revenue' WHEN s_suppkey % 50 = 8 THEN 'Utilities'
            WHEN s_suppkey = 9 THEN 'BANK FEES' WHEN s_suppkey = 10 THEN 'Payroll Expense'
            ELSE s_name END AS name,
       CASE WHEN s_suppkey % 90 = 8 THEN '6060' WHEN s_suppkey = 9 THEN '6080'
            WHEN s_suppkey = 12 THEN '6010'
            ELSE cast(100000 + s_suppkey AS string) END AS account_number,
       CASE WHEN s_suppkey = 10 THEN 'Bank' ELSE 'Expense' END AS account_type,
       CASE WHEN s_suppkey = 9 THEN 'BankCharges' ELSE 'Other' END AS account_sub_type,
       s_suppkey % 4 <> 1 AS active
FROM supplier
"""

INACTIVE_EXTERNAL = "6040"


def external_accounts(spark: SparkSession) -> DataFrame:
    """The chart of accounts as the outside ledger keeps it; one account is inactive there."""
    rows = [
        (f"X{number}", "0", name, number, defaults.EXTERNAL_TYPE[kind], defaults.EXTERNAL_DETAIL[detail],
         number != INACTIVE_EXTERNAL)
        for number, name, kind, detail, _, _ in defaults.ACCOUNTS
    ]
    return spark.createDataFrame(
        rows,
        "id string, sync_token string, name string, account_number string, account_type string, "
        "account_sub_type string, active boolean",
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register_tables(spark, sf_dir, "customer")
    return spark.sql(PATTERNS)


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages.canonical(spark, sf_dir).createOrReplaceTempView("canonical")
    return spark.sql(PROPOSALS)


def supplier_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register_tables(spark, sf_dir, "supplier")
    return spark.sql(SUPPLIER_ACCOUNTS)


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register_tables(spark, sf_dir, "events")
    return spark.sql(SYNC_EVENTS)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register_tables(spark, sf_dir, "events")
    return spark.sql(ATTEMPTS)


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review commands; those of orders that are no canonical transaction keep a bare target."""
    views.register_tables(spark, sf_dir, "events")
    ids = stages.canonical(spark, sf_dir).where("upload_seq = 1").select(
        F.col("source_transaction_id").alias("target"), F.col("id").alias("_id")
    )
    joined = spark.sql(COMMANDS).join(ids, "target", "left")
    return joined.withColumn("id", F.coalesce("_id", "target")).drop("_id", "target")


def review_status(row_no: Column) -> Column:
    slot = row_no % 130
    return (
        F.when(slot.between(70, 79), F.lit("pending"))
        .when(slot.between(110, 119), F.lit("rejected"))
        .otherwise(F.lit("approved"))
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored classification table: the rules' decisions, with review states spread over rows."""

    def build() -> list[DataFrame]:
        rows = match_rules(
            stages.canonical(spark, sf_dir), config.default_rules(spark), config.default_chart(spark)
        ).where("rule is not null")
        decided = rows.select(
            "id", "row_no", F.lit(1).alias("version"),
            "rule.transaction_type", F.lit(None).cast("string").alias("counterparty_raw"),
            "rule.counterparty_name", "rule.account_number", "rule.account_name",
            "rule.confidence", "rule.explanation", "rule.source", "rule.review_required",
            review_status(F.col("row_no")).alias("review_status"),
        )
        # Two parts: each matches the distinct descriptions again.
        return in_parts(decided, "id", 2)

    return stages.once(spark, sf_dir, "classified", build, key="id")
