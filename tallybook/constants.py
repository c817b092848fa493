"""Closed value sets shared by the operators."""

# Record states, directions and decision fields must carry these names.
VALID, INVALID, DUPLICATE = "valid", "invalid", "duplicate"
INFLOW, OUTFLOW = "inflow", "outflow"
ERROR, WARNING = "error", "warning"
PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"

TRANSACTION_TYPES = (
    "revenue",
    "cost_of_goods_sold",
    "operating_expense",
    "refund",
    "transfer",
    "owner_contribution",
    "owner_distribution",
    "fixed_asset_purchase",
)
REPORTED_TYPES = ("revenue", "refund", "cost_of_goods_sold", "operating_expense")

SOURCE_RULE = "deterministic_rule"
SOURCE_PATTERN = "stored_correction"
SOURCE_EXTERNAL = "gemini"
SOURCE_MANUAL = "manual_review"

SYNC_STATUSES = ("pending", "in_progress", "succeeded", "retryable_error", "permanent_error")
RETRYABLE_HTTP = (401, 408, 425, 429, 500, 502, 503, 504)

# Which transaction type may post to which ledger account type.
ACCOUNT_TYPE_FOR = {
    "revenue": "Income",
    "cost_of_goods_sold": "Cost of Goods Sold",
    "operating_expense": "Expenses",
    "refund": "Income",
    "transfer": "Bank",
    "owner_contribution": "Equity",
    "owner_distribution": "Equity",
    "fixed_asset_purchase": "Fixed Assets",
}
REFUND_ACCOUNT = "4100"

# Types an outside proposal or a manual correction may give per direction.
TYPES_FOR_DIRECTION = {
    INFLOW: ("revenue", "transfer", "owner_contribution"),
    OUTFLOW: (
        "cost_of_goods_sold",
        "operating_expense",
        "refund",
        "transfer",
        "owner_distribution",
        "fixed_asset_purchase",
    ),
}
# The only direction a single-source posting of a type may have.
POSTING_DIRECTION = {
    "revenue": INFLOW,
    "owner_contribution": INFLOW,
    "cost_of_goods_sold": OUTFLOW,
    "operating_expense": OUTFLOW,
    "refund": OUTFLOW,
    "owner_distribution": OUTFLOW,
    "fixed_asset_purchase": OUTFLOW,
}
# Proposals of these types always need a person.
SENSITIVE_TYPES = (
    "refund",
    "transfer",
    "owner_contribution",
    "owner_distribution",
    "fixed_asset_purchase",
)
REVIEW_THRESHOLD = "0.900"

# P&L section per ledger account type.
SECTION_FOR = {
    "Income": "revenue",
    "Cost of Goods Sold": "cost_of_goods_sold",
    "Expenses": "operating_expense",
}

# Limits per file.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_UNZIPPED_BYTES = 50 * 1024 * 1024
MAX_ARCHIVE_ENTRIES = 1_000
MAX_COLUMNS = 100
MAX_ROWS = 1_048_576  # of a workbook's sheet, by its file format
PREVIEW_ROWS = 10
