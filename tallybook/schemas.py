"""Column layouts of the stored tables, as DDL."""

ISSUE = "struct<code:string,field:string,message:string,severity:string,raw_value:string>"
ISSUES = f"array<{ISSUE}>"

TRANSACTION = f"""
    id string, upload_id string, raw_record_id string, source_transaction_id string,
    transaction_date date, posted_date date, description_original string,
    description_normalized string, amount decimal(18,2), currency string,
    bank_account string, direction string, fingerprint string, status string,
    duplicate_of string, validation_issues {ISSUES}
"""
TRANSACTION_COLUMNS = (
    "id", "upload_id", "raw_record_id", "source_transaction_id", "transaction_date",
    "posted_date", "description_original", "description_normalized", "amount", "currency",
    "bank_account", "direction", "fingerprint", "status", "duplicate_of", "validation_issues",
)

ACCOUNT = """
    number string, name string, account_type string, detail_type string, statement string,
    purpose string, active boolean
"""
RULE_COLUMNS = (
    "id", "priority", "active", "description_exact", "description_all", "description_any",
    "description_none", "direction", "bank_account", "currency", "transaction_type",
    "account_number", "account_name", "counterparty_name", "confidence", "explanation",
    "review_required",
)
# Decision columns every classification carries, flat.
DECISION = (
    "transaction_type", "counterparty_raw", "counterparty_name", "account_number",
    "account_name", "confidence", "explanation", "source", "review_required",
)
CONFIDENCE = "decimal(10,9)"

EXTERNAL_ACCOUNT = """
    id string, sync_token string, name string, account_number string, account_type string,
    account_sub_type string, active boolean
"""
JOURNAL_LINE = (
    "struct<account_number:string,account_name:string,external_id:string,"
    "posting_type:string,amount:decimal(18,2),description:string>"
)
