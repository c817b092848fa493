"""Shared SQL building blocks of the counterparts: the pipeline as plain CTEs."""

from __future__ import annotations

from tallybook.config import defaults
from tallybook.plans.derived import PATTERNS, PROPOSALS
from tallybook.plans.views import RAW_BANK

NORM = """
norm0 AS (
  SELECT *,
    substr(sha256(concat_ws('|', cast(upload_seq AS varchar), cast(row_no AS varchar), source_id,
                            description_text, amount_text)), 1, 32) AS id,
    concat('upload-', upload_seq) AS upload_id,
    source_id AS source_transaction_id,
    TRY_CAST(date_text AS DATE) AS transaction_date,
    description_text AS description_original,
    lower(trim(regexp_replace(description_text, '\\s+', ' ', 'g'))) AS description_normalized,
    CASE WHEN regexp_full_match(amount_text, '-?\\d+\\.\\d\\d') THEN CAST(amount_text AS DECIMAL(18,2))
         WHEN regexp_full_match(amount_text, '\\(\\d+\\.\\d\\d\\)')
         THEN CAST(concat('-', replace(replace(amount_text, '(', ''), ')', '')) AS DECIMAL(18,2)) END AS amount,
    CASE WHEN currency_text <> '' THEN upper(currency_text) END AS currency,
    trim(regexp_replace(bank_text, '\\s+', ' ', 'g')) AS bank_account
  FROM raw),
norm AS (
  SELECT *,
    CASE WHEN amount > 0 THEN 'inflow' WHEN amount < 0 THEN 'outflow' END AS direction,
    concat_ws(',', CASE WHEN transaction_date IS NULL THEN 'invalid_date' END,
                   CASE WHEN amount IS NULL THEN 'invalid_amount' END,
                   CASE WHEN amount = 0 THEN 'zero_amount' END,
                   CASE WHEN currency IS NULL THEN 'missing_currency' END) AS codes,
    sha256('{"amount":"' || amount || '","bank_account":"' || lower(bank_account) || '","currency":"' || currency
           || '","description":"' || description_normalized || '","transaction_date":"' || transaction_date || '"}') AS fingerprint
  FROM norm0)
"""

RESOLVED = """
usable AS (
  SELECT *, row_number() OVER (ORDER BY upload_seq, row_no, source_id, description_text, amount_text) AS pos
  FROM norm WHERE codes = ''),
firsts AS (
  SELECT *, min(pos) OVER (PARTITION BY lower(bank_account), lower(source_transaction_id)) AS s_first,
         min(pos) OVER (PARTITION BY fingerprint) AS f_first
  FROM usable),
heads AS (SELECT * FROM firsts WHERE pos = s_first AND pos = f_first),
matched AS (
  SELECT u.id AS mid, s.id AS s_id, s.upload_id AS s_up, s.fingerprint AS s_fp, f.id AS f_id, f.upload_id AS f_up,
         u.fingerprint AS fp
  FROM usable u
  LEFT JOIN heads s ON lower(s.bank_account) = lower(u.bank_account)
       AND lower(s.source_transaction_id) = lower(u.source_transaction_id) AND s.pos < u.pos
  LEFT JOIN heads f ON f.fingerprint = u.fingerprint AND f.pos < u.pos
  WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.pos = u.pos)),
kinds AS (
  SELECT mid, CASE WHEN s_id IS NOT NULL AND s_fp <> fp THEN 'conflict' WHEN s_id IS NOT NULL THEN 'source_transaction_id'
                   ELSE 'normalized_fingerprint' END AS match_kind,
         coalesce(s_id, f_id) AS target, CASE WHEN s_id IS NOT NULL THEN s_up ELSE f_up END AS canonical_upload
  FROM matched),
transactions AS (
  SELECT n.*, k.match_kind, k.canonical_upload,
         CASE WHEN k.match_kind <> 'conflict' THEN k.target END AS duplicate_of,
         CASE WHEN k.match_kind = 'conflict' THEN 'invalid' WHEN k.match_kind IS NOT NULL THEN 'duplicate'
              WHEN n.codes = '' THEN 'valid' ELSE 'invalid' END AS status,
         concat_ws(',', nullif(n.codes, ''), CASE WHEN k.match_kind = 'conflict' THEN 'source_transaction_id_conflict'
              WHEN k.match_kind IS NOT NULL THEN concat('duplicate_', k.match_kind) END) AS all_codes
  FROM norm n LEFT JOIN kinds k ON k.mid = n.id),
canonical AS (SELECT * FROM transactions WHERE status = 'valid' AND duplicate_of IS NULL)
"""


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def accounts_cte() -> str:
    rows = ",\n".join(
        "(" + ", ".join(_quote(v) for v in row) + ", true)" for row in defaults.ACCOUNTS
    )
    return f"accounts(number, name, account_type, detail_type, statement, purpose, active) AS (VALUES {rows})"


def rule_case(field: int | str) -> str:
    """CASE over the rules in priority order, giving a field of the first match."""
    names = {a[0]: a[1] for a in defaults.ACCOUNTS}
    parts = []
    for rule in sorted(defaults.RULES, key=lambda r: r[1]):
        rule_id, priority, phrases, direction, bank, kind, account, confidence = rule
        conditions = [f"direction = '{direction}'", f"lower(bank_account) = '{bank.lower()}'", "currency = 'USD'"]
        conditions += [f"contains(description_normalized, {_quote(p)})" for p in phrases.get("all", [])]
        conditions += [f"NOT contains(description_normalized, {_quote(p)})" for p in phrases.get("none", [])]
        if "any" in phrases:
            conditions.append("(" + " OR ".join(f"contains(description_normalized, {_quote(p)})" for p in phrases["any"]) + ")")
        if "exact" in phrases:
            conditions.append(f"description_normalized IN ({', '.join(_quote(p) for p in phrases['exact'])})")
        value = {"rule_id": rule_id, "type": kind, "account": account, "name": names[account],
                 "confidence": confidence, "priority": str(priority)}[field]
        parts.append(f"WHEN {' AND '.join(conditions)} THEN {_quote(value)}")
    return "CASE " + " ".join(parts) + " END"


def classified_cte() -> str:
    return f"""ruled AS (SELECT *, {rule_case('rule_id')} AS rule_id, {rule_case('type')} AS transaction_type,
      {rule_case('account')} AS account_number, {rule_case('name')} AS account_name,
      CAST({rule_case('confidence')} AS DECIMAL(10,9)) AS confidence FROM canonical),
    classified AS (SELECT *, 1 AS version, 'deterministic_rule' AS source, false AS review_required,
      CASE WHEN row_no % 130 BETWEEN 70 AND 79 THEN 'pending' WHEN row_no % 130 BETWEEN 110 AND 119 THEN 'rejected'
           ELSE 'approved' END AS review_status
      FROM ruled WHERE rule_id IS NOT NULL)"""


ENTRIES = """
entries AS (
  SELECT c.id, c.transaction_date, CAST(date_trunc('month', c.transaction_date) AS DATE) AS month,
         CASE a.account_type WHEN 'Income' THEN 'revenue' WHEN 'Cost of Goods Sold' THEN 'cost_of_goods_sold'
              ELSE 'operating_expense' END AS section,
         c.account_number, c.account_name, c.transaction_type, c.amount,
         CASE WHEN c.transaction_type IN ('revenue', 'refund') THEN c.amount ELSE -c.amount END AS report_amount
  FROM classified c JOIN accounts a ON a.number = c.account_number
  WHERE c.review_status = 'approved' AND c.currency = 'USD'
    AND c.transaction_type IN ('revenue', 'refund', 'cost_of_goods_sold', 'operating_expense')
    AND c.transaction_date BETWEEN DATE '1995-01-01' AND DATE '2001-11-30'),
lines AS (
  SELECT month, section, account_number, account_name, sum(report_amount) AS total, count(*) AS n
  FROM entries GROUP BY GROUPING SETS ((month, section, account_number, account_name), (section, account_number, account_name))),
months AS (
  SELECT CAST(m AS DATE) AS month FROM generate_series(DATE '1995-01-01', DATE '2001-11-30', INTERVAL 1 MONTH) g(m)
  UNION ALL SELECT NULL),
statements AS (
  SELECT CASE WHEN m.month IS NULL THEN 'consolidated' ELSE 'monthly' END AS statement,
         coalesce(m.month, DATE '1995-01-01') AS start_date,
         coalesce(last_day(m.month), DATE '2001-11-30') AS end_date,
         CAST(coalesce(sum(total) FILTER (section = 'revenue'), 0) AS DECIMAL(28,2)) AS total_revenue,
         CAST(coalesce(sum(total) FILTER (section = 'cost_of_goods_sold'), 0) AS DECIMAL(28,2)) AS total_cogs,
         CAST(coalesce(sum(total) FILTER (section = 'operating_expense'), 0) AS DECIMAL(28,2)) AS total_operating_expenses,
         CAST(coalesce(sum(n), 0) AS BIGINT) AS transaction_count
  FROM months m LEFT JOIN lines l ON l.month IS NOT DISTINCT FROM m.month GROUP BY m.month)
"""
PERIOD = ("1995-01-01", "2001-11-30")

_BLOCKS = {
    "raw": lambda: f"raw AS ({RAW_BANK})",
    "norm": lambda: NORM,
    "resolved": lambda: RESOLVED,
    "accounts": accounts_cte,
    "classified": classified_cte,
    "entries": lambda: ENTRIES,
    "patterns": lambda: f"patterns AS ({PATTERNS})",
    "proposals": lambda: f"proposals AS ({PROPOSALS})",
}
_NEEDS = {
    "norm": ("raw",),
    "resolved": ("norm",),
    "classified": ("resolved",),
    "entries": ("classified", "accounts"),
    "proposals": ("resolved",),
}


def with_blocks(*names: str, extra: str = "") -> str:
    """WITH clause holding the named blocks and what they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [_BLOCKS[n]().strip() for n in ordered]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
