"""Registered queries: P&L, posting, reconciliation, outside reports, sync state."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import hashing, money
from tallybook.operators import catalog, ledger, pnl, posting, reconcile, sync
from tallybook.plans import derived, stages, views
from tallybook.plans.registry import query
from tallybook.plans.sql import PERIOD, with_blocks
from tallybook.sources import config, paging, reports

START, END = (date.fromisoformat(d) for d in PERIOD)

# --- profit and loss ----------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.approved_sources(
        stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir), START, END, "USD"
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.once(
        spark, sf_dir, "entries",
        lambda: pnl.prepare_entries(_sources(spark, sf_dir), config.default_chart(spark)),
    )


_STATEMENT = """SELECT statement, start_date::varchar AS start_date, end_date::varchar AS end_date, cast(total_revenue AS varchar) AS total_revenue,
    cast(total_cogs AS varchar) AS total_cogs, cast(cast(total_revenue - total_cogs AS decimal(28,2)) AS varchar) AS gross_profit,
    cast(total_operating_expenses AS varchar) AS total_operating_expenses,
    cast(cast(total_revenue - total_cogs - total_operating_expenses AS decimal(28,2)) AS varchar) AS net_profit, transaction_count FROM statements"""


@query("e_k2_profit_and_loss", with_blocks("entries") + _STATEMENT)
def profit_and_loss(spark, sf_dir):
    """From raw bank exports to monthly and consolidated statements."""
    return pnl.report_set(
        stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir),
        config.default_chart(spark), START, END, "USD",
    )


@query(
    "e_c2_c3_d4_g3_approved_sources",
    with_blocks("entries") + "SELECT id, transaction_date::varchar AS transaction_date, transaction_type, cast(amount AS varchar) AS amount FROM entries",
)
def approved_sources(spark, sf_dir):
    return _sources(spark, sf_dir).select("id", "transaction_date", "transaction_type", "amount").orderBy(
        "transaction_date", "id"
    )


@query(
    "e_b18_e7_g4_drilldown",
    with_blocks("entries") + """SELECT month::varchar AS month, account_number, id, transaction_date::varchar AS transaction_date,
      cast(amount AS varchar) AS source_amount, cast(report_amount AS varchar) AS report_amount FROM entries""",
)
def drilldown(spark, sf_dir):
    return pnl.drilldown(_entries(spark, sf_dir)).select(
        F.col("month").cast("date").alias("month"), "account_number", "id", "transaction_date", "source_amount", "report_amount"
    )


@query(
    "e_e7_drilldown_page",
    with_blocks("entries") + """, placed AS (SELECT row_number() OVER (ORDER BY month, account_number, transaction_date, id) - 1 AS position,
        count(*) OVER () AS total, * FROM entries)
      SELECT position, month::varchar AS month, account_number, id, cast(amount AS varchar) AS source_amount
      FROM placed WHERE position BETWEEN total * 3 // 4 AND total * 3 // 4 + 199""",
)
def drilldown_page(spark, sf_dir):
    """The page three quarters down the drill-down, out of all entries put in order."""
    rows = _entries(spark, sf_dir).where("problem is null").drop("problem")
    ordered = paging.put_in_order(rows, pnl.drilldown_order())
    return paging.page(ordered, ordered.total * 3 // 4, 200).select(
        "position", F.col("month").cast("date").alias("month"), "account_number", "id", "source_amount"
    )


@query(
    "e_e4_e6_h7_account_lines",
    with_blocks("entries") + """SELECT month::varchar AS month, section, account_number, account_name, cast(cast(total AS decimal(28,2)) AS varchar) AS total,
      n AS transaction_count FROM lines""",
)
def account_lines(spark, sf_dir):
    return pnl.account_lines(_entries(spark, sf_dir))


@query("e_e5_d15_b25_statements", with_blocks("entries") + _STATEMENT)
def statements(spark, sf_dir):
    return pnl.statements(_entries(spark, sf_dir), START, END)


# --- posting plans ------------------------------------------------------------------------------

_PLANS = with_blocks(
    "classified",
    extra="""posts AS (SELECT t.*, c.version, c.transaction_type, c.account_number, c.review_status, c.id AS cid
        FROM canonical t LEFT JOIN classified c ON c.id = t.id),
      singles AS (SELECT *, CASE WHEN review_status = 'rejected' THEN 'The classification was rejected'
          WHEN account_number = '6040' THEN 'External account is inactive: 6040' END AS problem
        FROM posts WHERE transaction_type <> 'transfer'),
      sides AS (SELECT *, abs(amount) AS pair_amount, CASE WHEN review_status = 'rejected' THEN 'The classification was rejected' END AS problem
        FROM posts WHERE transaction_type = 'transfer'),
      pairs AS (SELECT transaction_date, pair_amount, currency, count(*) AS members, count(*) FILTER (direction = 'inflow') AS inflows,
          min(id) FILTER (direction = 'outflow') AS out_id, min(id) FILTER (direction = 'inflow') AS in_id,
          min(source_transaction_id) FILTER (direction = 'outflow') AS out_label, min(source_transaction_id) FILTER (direction = 'inflow') AS in_label,
          min(problem) AS problem FROM sides GROUP BY 1, 2, 3),
      plans AS (
        SELECT concat('je-', substr(sha256(id), 1, 40)) AS request_id, 'single' AS kind, transaction_date, currency,
          concat('Ledger ', source_transaction_id, ' | ', transaction_type, ' | classification v', version) AS private_note, abs(amount) AS amount,
          CASE WHEN direction = 'inflow' THEN 'X1000' ELSE concat('X', account_number) END AS debit,
          CASE WHEN direction = 'inflow' THEN concat('X', account_number) ELSE 'X1000' END AS credit, description_original AS description, id AS first_id, NULL AS second_id
        FROM singles WHERE problem IS NULL
        UNION ALL
        SELECT concat('je-', substr(sha256(concat_ws('|', least(out_id, in_id), greatest(out_id, in_id))), 1, 40)), 'transfer', transaction_date, currency,
          concat('Ledger transfer ', out_label, ' to ', in_label), pair_amount, 'X1010', 'X1000', 'Transfer from Operating Checking to Tax Reserve',
          least(out_id, in_id), greatest(out_id, in_id)
        FROM pairs WHERE members = 2 AND inflows = 1 AND problem IS NULL),
      issues AS (
        SELECT id, source_transaction_id, 'missing_classification' AS code, 'There is no current classification' AS message FROM posts WHERE cid IS NULL
        UNION ALL SELECT id, source_transaction_id, 'posting_plan_blocked', problem FROM singles WHERE problem IS NOT NULL
        UNION ALL SELECT s.id, s.source_transaction_id, CASE WHEN p.members = 2 AND p.inflows = 1 THEN 'transfer_plan_blocked' ELSE 'ambiguous_transfer_pair' END,
          CASE WHEN p.members = 2 AND p.inflows = 1 THEN p.problem ELSE 'The transfer is not exactly one inflow and one outflow' END
        FROM sides s JOIN pairs p ON p.transaction_date = s.transaction_date AND p.pair_amount = s.pair_amount AND p.currency = s.currency
        WHERE NOT (p.members = 2 AND p.inflows = 1 AND p.problem IS NULL)),
      journal AS (SELECT debit AS external_id, amount AS debit_amount, 0.00 AS credit_amount FROM plans UNION ALL SELECT credit, 0.00, amount FROM plans),
      moves AS (SELECT substr(external_id, 2) AS account_number, cast(sum(debit_amount) AS decimal(28,2)) AS debits,
          cast(sum(credit_amount) AS decimal(28,2)) AS credits FROM journal GROUP BY 1)""",
)


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return posting.inventory(
        stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir), derived.external_accounts(spark)
    )


def _inventory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Plans and issues as stored tables, from one pass over the joined postings."""
    made: list[DataFrame] = []

    def part(index: int) -> DataFrame:
        if not made:
            made.extend(_planned(spark, sf_dir))
        return made[index]

    return (
        stages.once(spark, sf_dir, "plans", lambda: part(0)),
        stages.once(spark, sf_dir, "issues", lambda: part(1)),
    )


@query(
    "e_k3_k4_b32_g5_plans",
    _PLANS + """SELECT request_id, kind, transaction_date::varchar AS transaction_date, private_note, cast(amount AS varchar) AS amount, debit, credit, description,
      first_id, second_id FROM plans""",
)
def plans(spark, sf_dir):
    made, _ = _planned(spark, sf_dir)
    line = F.col("lines")
    return posting.order_plans(made).select(
        "request_id", "kind", "transaction_date", "private_note", line[0]["amount"].alias("amount"),
        line[0]["external_id"].alias("debit"), line[1]["external_id"].alias("credit"), line[0]["description"].alias("description"),
        F.col("sources")[0]["id"].alias("first_id"), F.try_element_at("sources", F.lit(2))["id"].alias("second_id"),
    )


@query("e_k5_g6_c5_issues", _PLANS + "SELECT id, source_transaction_id, code, message FROM issues")
def issues(spark, sf_dir):
    return posting.order_issues(_inventory(spark, sf_dir)[1])


@query("e_e11_issue_counts", _PLANS + "SELECT code, count(*) AS n FROM issues GROUP BY 1")
def issue_counts(spark, sf_dir):
    return _inventory(spark, sf_dir)[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e_d12_transfer_pairs",
    _PLANS + """SELECT transaction_date::varchar AS transaction_date, cast(pair_amount AS varchar) AS pair_amount, members, inflows,
      CASE WHEN NOT (members = 2 AND inflows = 1) THEN 'ambiguous_transfer_pair' WHEN problem IS NOT NULL THEN 'transfer_plan_blocked' END AS code FROM pairs""",
)
def transfer_pairs(spark, sf_dir):
    rows = posting.with_external(
        posting.postings(stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir)), derived.external_accounts(spark)
    ).where("transaction_type = 'transfer'")
    keyed = rows.where(posting.transfer_reference_problem().isNull())
    return posting.pair_transfers(posting.transfer_sides(keyed)).select(
        "transaction_date", "pair_amount", "members", "inflows", "code"
    )


@query(
    "e_d10_d11_external_resolution",
    _PLANS + """SELECT p.id, CASE bank_account WHEN 'Operating Checking' THEN 'X1000' WHEN 'Tax Reserve' THEN 'X1010' END AS bank,
      CASE WHEN cid IS NOT NULL THEN concat('X', account_number) END AS target,
      CASE WHEN cid IS NOT NULL AND account_number = '6040' THEN 'External account is inactive: 6040' END AS problem FROM posts p""",
)
def external_resolution(spark, sf_dir):
    rows = posting.with_external(
        posting.postings(stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir)), derived.external_accounts(spark)
    )
    problem = F.when(F.col("transaction_type").isNotNull(), posting.target_account_problem())
    return rows.select("id", F.col("bank.account.id").alias("bank"), F.col("target.account.id").alias("target"), problem.alias("problem"))


@query(
    "e_e16_inventory_summary",
    _PLANS + """SELECT (SELECT count(*) FROM transactions) AS total_transactions, (SELECT count(*) FROM canonical) AS canonical_transactions,
      (SELECT count(*) FROM transactions WHERE status = 'duplicate') AS duplicate_transactions, (SELECT count(*) FROM transactions WHERE status = 'invalid') AS invalid_transactions,
      (SELECT count(*) FROM classified) AS classifications, (SELECT count(*) FROM plans WHERE kind = 'single') AS single_plans,
      (SELECT count(*) FROM plans WHERE kind = 'transfer') AS transfer_plans,
      (SELECT count(first_id) + count(second_id) FROM plans) AS syncable_transactions, (SELECT count(*) FROM issues) AS blocked_transactions""",
)
def inventory_summary(spark, sf_dir):
    made, blocked = _inventory(spark, sf_dir)
    return posting.inventory_summary(
        stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir), made, blocked
    )


@query(
    "e_e8_g7_account_movements",
    _PLANS + "SELECT account_number, cast(debits AS varchar) AS debits, cast(credits AS varchar) AS credits, cast(cast(debits - credits AS decimal(28,2)) AS varchar) AS net_debit FROM moves",
)
def account_movements(spark, sf_dir):
    return posting.account_movements(_inventory(spark, sf_dir)[0]).select(
        "account_number", "debits", "credits", F.col("net_debit").cast("decimal(28,2)").alias("net_debit")
    ).orderBy("account_number")


@query(
    "e_k6_e9_e10_posting_summary",
    _PLANS + """, s AS (SELECT sum(debits) AS d, sum(credits) AS c, coalesce(sum(credits - debits) FILTER (account_number LIKE '4%'), 0) AS r,
        coalesce(sum(debits - credits) FILTER (account_number LIKE '5%'), 0) AS g, coalesce(sum(debits - credits) FILTER (account_number LIKE '6%'), 0) AS x FROM moves)
    SELECT cast(cast(d AS decimal(28,2)) AS varchar) AS total_debits, cast(cast(c AS decimal(28,2)) AS varchar) AS total_credits, cast(cast(r AS decimal(28,2)) AS varchar) AS revenue,
      cast(cast(g AS decimal(28,2)) AS varchar) AS cost_of_goods_sold, cast(cast(x AS decimal(28,2)) AS varchar) AS operating_expenses,
      cast(cast(r - g AS decimal(28,2)) AS varchar) AS gross_profit, cast(cast(r - g - x AS decimal(28,2)) AS varchar) AS net_income, d = c AS balanced FROM s""",
)
def posting_summary(spark, sf_dir):
    return posting.posting_summary(posting.account_movements(_inventory(spark, sf_dir)[0]))


def _json_line(side: str, account: str) -> str:
    return (
        f"""'{{"Amount":' || amount || ',"DetailType":"JournalEntryLineDetail","JournalEntryLineDetail":{{"PostingType":"{side}","AccountRef":{{"value":"' || {account} || '"}}}},"Description":"' || description || '"}}'"""
    )


@query(
    "e_a18_journal_payloads",
    _PLANS + f"""SELECT request_id, '{{"TxnDate":"' || transaction_date || '","PrivateNote":"' || private_note || '","Line":[' || {_json_line('Debit', 'debit')}
      || ',' || {_json_line('Credit', 'credit')} || ']}}' AS payload, NULL::varchar AS code FROM plans""",
)
def journal_payloads(spark, sf_dir):
    return posting.journal_payloads(_inventory(spark, sf_dir)[0])


@query(
    "e_b29_request_ids",
    with_blocks("resolved") + "SELECT id, concat('je-', substr(sha256(id), 1, 40)) AS request_id, 43 AS width FROM canonical",
)
def request_ids(spark, sf_dir):
    made = hashing.request_id(F.array("id"))
    return stages.canonical(spark, sf_dir).select("id", made.alias("request_id"), F.length(made).alias("width"))


# --- outside reports and reconciliation ---------------------------------------------------------

# Planted: materials are a cent off in March, maintenance plans are missing in June.
_PLANTED = """total + CASE WHEN account_number = '5000' AND extract(month FROM start_date) = 3 THEN 0.01 ELSE 0.00 END"""
_LEFT_OUT = "account_number = '4020' AND extract(month FROM start_date) = 6"


def _internal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = _entries(spark, sf_dir)
    return (
        reconcile.period_lines(pnl.account_lines(entries), START, END),
        pnl.statements(entries, START, END),
    )


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON report per period, as the outside ledger sends them, with planted flaws.

    A period has at most as many lines as the chart has accounts.
    """
    lines, totals = _internal(spark, sf_dir)
    kept = lines.where(~F.expr(_LEFT_OUT)).withColumn(
        "amount", F.expr(_PLANTED.replace("total +", "amount +")).cast("decimal(28,2)")
    )
    amount = F.format_number("amount", 2)
    row = F.struct(
        F.lit("Data").alias("type"),
        F.array(
            F.struct(F.concat(F.lit("X"), F.col("account_number")).alias("id"), F.col("account_name").alias("value")),
            F.struct(F.lit("").alias("id"), amount.alias("value")),
        ).alias("ColData"),
    )
    group = (
        F.when(F.col("account_number").startswith("4"), F.lit("Income"))
        .when(F.col("account_number").startswith("5"), F.lit("COGS"))
        .otherwise(F.lit("Expenses"))
    )
    sections = kept.withColumn("group", group).groupBy("start_date", "end_date").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("group") == g, row))).alias(g)
            for g in ("Income", "COGS", "Expenses")
        ]
    )
    joined = totals.join(sections, ["start_date", "end_date"], "left")

    def section(name: str, total: str, rows: bool):
        summary = F.struct(
            F.array(
                F.struct(F.lit(None).cast("string").alias("id"), F.lit(f"Total {name}").alias("value")),
                F.struct(F.lit(None).cast("string").alias("id"), F.col(total).cast("string").alias("value")),
            ).alias("ColData")
        ).alias("Summary")
        if not rows:
            return F.to_json(F.struct(F.lit("Section").alias("type"), F.lit(name).alias("group"), summary))
        inner = F.struct(F.lit("Section").alias("type"), F.struct(F.col(name).alias("Row")).alias("Rows"))
        return F.to_json(
            F.struct(
                F.lit("Section").alias("type"), F.lit(name).alias("group"), summary,
                F.struct(F.array(inner).alias("Row")).alias("Rows"),
            )
        )

    header = F.to_json(
        F.struct(
            F.lit("ProfitAndLoss").alias("ReportName"), F.lit("Cash").alias("ReportBasis"),
            F.col("start_date").cast("string").alias("StartPeriod"), F.col("end_date").cast("string").alias("EndPeriod"),
            F.lit("usd").alias("Currency"),
        )
    )
    body = F.concat_ws(
        ",", section("Income", "total_revenue", True), section("COGS", "total_cogs", True),
        section("GrossProfit", "gross_profit", False), section("Expenses", "total_operating_expenses", True),
        section("NetIncome", "net_profit", False),
    )
    payload = F.concat(F.lit('{"Header":'), header, F.lit(',"Rows":{"Row":['), body, F.lit("]}}"))
    return joined.select(
        F.concat_ws("..", F.col("start_date").cast("string"), F.col("end_date").cast("string")).alias("report_id"),
        payload.alias("payload"), F.col("start_date").alias("expected_start"), F.col("end_date").alias("expected_end"),
    )


def _external(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = stages.once(spark, sf_dir, "reports", lambda: _reports(spark, sf_dir))
    return reports.external_statements(made, derived.external_accounts(spark))


_OUTSIDE = with_blocks(
    "entries",
    extra=f"""inner_lines AS (SELECT coalesce(month, DATE '{PERIOD[0]}') AS start_date, coalesce(last_day(month), DATE '{PERIOD[1]}') AS end_date,
        account_number, account_name, total FROM lines),
      outer_lines AS (SELECT start_date, end_date, account_number, account_name, cast({_PLANTED} AS decimal(28,2)) AS amount FROM inner_lines
        WHERE NOT ({_LEFT_OUT}) AND ({_PLANTED}) <> 0)""",
)


@query(
    "e_k7_a11_b21_b33_d18_external_lines",
    _OUTSIDE + "SELECT start_date::varchar AS start_date, end_date::varchar AS end_date, account_number, account_name, cast(amount AS varchar) AS amount FROM outer_lines",
)
def external_lines(spark, sf_dir):
    lines, _, _ = _external(spark, sf_dir)
    return lines.select("start_date", "end_date", "account_number", "account_name", F.col("amount").cast("decimal(28,2)").alias("amount"))


@query(
    "e_h5_external_totals",
    with_blocks("entries") + """SELECT start_date::varchar AS start_date, end_date::varchar AS end_date, cast(total_revenue AS varchar) AS total_revenue,
      cast(cast(total_revenue - total_cogs - total_operating_expenses AS decimal(28,2)) AS varchar) AS net_profit, 'USD' AS currency, '' AS missing FROM statements""",
)
def external_totals(spark, sf_dir):
    _, totals, _ = _external(spark, sf_dir)
    return totals.select(
        "start_date", "end_date", "total_revenue", "net_profit", "currency", F.array_join("missing_groups", ",").alias("missing")
    )


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, totals = _internal(spark, sf_dir)
    outside_lines, outside_totals, _ = _external(spark, sf_dir)
    return reconcile.reconcile(lines, totals, outside_lines, outside_totals)


_RECON = _OUTSIDE + """, compared AS (
    SELECT coalesce(i.start_date, o.start_date) AS start_date, coalesce(i.end_date, o.end_date) AS end_date, coalesce(i.account_number, o.account_number) AS key,
      coalesce(i.account_name, o.account_name) AS label, cast(coalesce(i.total, 0) AS decimal(28,2)) AS internal_amount, cast(coalesce(o.amount, 0) AS decimal(28,2)) AS external_amount
    FROM inner_lines i FULL JOIN outer_lines o ON o.start_date = i.start_date AND o.end_date = i.end_date AND o.account_number = i.account_number
    UNION ALL SELECT start_date, end_date, 'total_revenue', 'Total revenue', total_revenue, total_revenue FROM statements
    UNION ALL SELECT start_date, end_date, 'total_cogs', 'Total COGS', total_cogs, total_cogs FROM statements
    UNION ALL SELECT start_date, end_date, 'gross_profit', 'Gross profit', total_revenue - total_cogs, total_revenue - total_cogs FROM statements
    UNION ALL SELECT start_date, end_date, 'total_operating_expenses', 'Total operating expenses', total_operating_expenses, total_operating_expenses FROM statements
    UNION ALL SELECT start_date, end_date, 'net_profit', 'Net profit', total_revenue - total_cogs - total_operating_expenses, total_revenue - total_cogs - total_operating_expenses FROM statements)
"""


@query(
    "e_k8_d16_b20_h1_reconciliation",
    _RECON + """SELECT start_date::varchar AS start_date, end_date::varchar AS end_date, key, label, cast(cast(internal_amount AS decimal(28,2)) AS varchar) AS internal_amount,
      cast(cast(external_amount AS decimal(28,2)) AS varchar) AS external_amount, cast(cast(internal_amount - external_amount AS decimal(28,2)) AS varchar) AS difference,
      internal_amount = external_amount AS reconciled, concat(start_date, ' through ', end_date) AS period,
      CASE WHEN internal_amount = external_amount THEN 'Both amounts match' ELSE 'The internal amount differs from the outside cash-basis report' END AS explanation FROM compared""",
)
def reconciliation(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query(
    "e_e19_verdicts",
    _RECON + """SELECT start_date::varchar AS start_date, end_date::varchar AS end_date, bool_and(internal_amount = external_amount) AS reconciled, count(*) AS lines,
      count(*) FILTER (internal_amount <> external_amount) AS differences FROM compared GROUP BY ALL""",
)
def verdicts(spark, sf_dir):
    return reconcile.verdicts(_reconciled(spark, sf_dir))


@query("e_d21_h4_missing_numbers", with_blocks("entries") + "SELECT DISTINCT account_number FROM entries WHERE account_number NOT IN (SELECT number FROM accounts WHERE number <> '4020')")
def missing_numbers(spark, sf_dir):
    external = derived.external_accounts(spark).where("account_number <> '4020'")
    return reconcile.missing_numbers(_entries(spark, sf_dir), external)


@query(
    "e_d17_k13_catalog_diff",
    with_blocks("accounts") + f""", ext AS (SELECT *, lower(name) AS name_key FROM ({derived.SUPPLIER_ACCOUNTS})),
      byno AS (SELECT account_number, count(*) AS n, min(id) AS id FROM ext GROUP BY 1),
      byname AS (SELECT name_key, count(*) AS n, min(id) AS id FROM ext GROUP BY 1),
      wanted AS (SELECT *, CASE account_type WHEN 'Fixed Assets' THEN 'Fixed Asset' WHEN 'Expenses' THEN 'Expense' ELSE account_type END AS expected_type FROM accounts),
      found AS (SELECT w.*, byno.n AS no_n, byname.n AS name_n, byno.id AS no_id, byname.id AS name_id, coalesce(byno.id, byname.id) AS current_id
        FROM wanted w LEFT JOIN byno ON byno.account_number = w.number LEFT JOIN byname ON byname.name_key = lower(w.name)),
      judged AS (SELECT f.*, e.id AS external_id, e.account_sub_type, e.active AS e_active, e.account_number AS e_number,
        CASE WHEN no_n > 1 THEN 'number_used_more_than_once' WHEN name_n > 1 THEN 'name_used_more_than_once'
             WHEN no_id <> name_id THEN 'number_and_name_belong_to_different_accounts' WHEN e.account_type <> expected_type THEN 'incompatible_type'
             WHEN e.name_key <> lower(f.name) THEN 'number_taken_by_other_name' END AS problem
        FROM found f LEFT JOIN ext e ON e.id = f.current_id)
    SELECT number, problem, external_id, CASE WHEN problem IS NOT NULL THEN 'blocked' WHEN external_id IS NULL THEN 'create'
      WHEN e_number <> number OR NOT e_active THEN 'update' ELSE 'reuse' END AS action FROM judged""",
)
def catalog_diff(spark, sf_dir):
    return catalog.catalog_diff(config.default_chart(spark), derived.supplier_accounts(spark, sf_dir)).select(
        "number", "problem", "external_id", "action"
    )


# --- ledger views -------------------------------------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_rows(stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir))


@query(
    "e_b34_ledger_rows",
    with_blocks("classified") + """SELECT t.id, t.status AS record_status, t.duplicate_of IS NOT NULL AS duplicate, t.description_original AS description,
      c.account_number, c.review_status FROM transactions t LEFT JOIN classified c ON c.id = t.id""",
)
def ledger_rows(spark, sf_dir):
    return _ledger(spark, sf_dir).select(
        "id", "record_status", "duplicate", "description", "classification.account_number", "classification.review_status"
    )


@query(
    "e_c6_ledger_search",
    with_blocks("classified") + """SELECT t.id FROM transactions t JOIN classified c ON c.id = t.id
      WHERE c.review_status = 'pending' AND contains(lower(concat_ws(' ', t.description_original, t.bank_account, c.transaction_type, c.account_number, c.account_name)), 'payroll')""",
)
def ledger_search(spark, sf_dir):
    return ledger.search(_ledger(spark, sf_dir), " Payroll ", "pending").select("id")


@query(
    "e_g2_latest_rows",
    with_blocks("resolved") + """SELECT id, transaction_date::varchar AS transaction_date FROM transactions
      ORDER BY transaction_date DESC NULLS LAST, upload_seq DESC, id LIMIT 100""",
)
def latest_rows(spark, sf_dir):
    rows = stages.transactions(spark, sf_dir).withColumn(
        "created_at", F.timestamp_seconds(F.col("upload_seq").cast("long"))
    )
    return ledger.latest(rows).select("id", "transaction_date")


# --- sync state ---------------------------------------------------------------------------------

_SYNC = """WITH RECURSIVE ev AS (SELECT *, row_number() OVER (ORDER BY "at", event_id) AS pos FROM (""" + derived.SYNC_EVENTS + """)),
  posted AS (SELECT DISTINCT request_id FROM ev),
  chain AS (
    SELECT request_id, 0 AS attempt, cast(0 AS bigint) AS pos, 'pending' AS status FROM posted
    UNION ALL
    SELECT c.request_id, CASE WHEN c.status = 'in_progress' THEN c.attempt ELSE c.attempt + 1 END, n.pos,
      CASE n.kind WHEN 'claim' THEN 'in_progress' WHEN 'succeed' THEN 'succeeded' WHEN 'permanent' THEN 'permanent_error' ELSE 'retryable_error' END
    FROM chain c, LATERAL (SELECT e.pos, e.kind FROM ev e WHERE e.request_id = c.request_id AND e.pos > c.pos
        AND CASE WHEN c.status IN ('pending', 'retryable_error') THEN e.kind = 'claim'
                 WHEN c.status = 'in_progress' THEN e.kind <> 'claim' AND e.expected_attempt = c.attempt ELSE false END
      ORDER BY e.pos LIMIT 1) n),
  state AS (SELECT request_id, arg_max(status, pos) AS status, arg_max(attempt, pos) AS attempt_count, max(pos) AS pos FROM chain GROUP BY 1)
"""


def _postings(events: DataFrame) -> DataFrame:
    """A record per posting the events speak of, created when it is first heard of."""
    return events.groupBy("request_id").agg(F.min("at").alias("created_at"))


def _sync_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = derived.sync_events(spark, sf_dir)
    transitions = sync.fold_events(events)
    return events, transitions, sync.current_state(_postings(events), transitions)


@query("e_k10_event_verdicts", _SYNC + "SELECT event_id, CASE WHEN c.pos IS NULL THEN 'illegal_transition' ELSE 'accepted' END AS verdict, c.status AS status_after FROM ev LEFT JOIN chain c ON c.request_id = ev.request_id AND c.pos = ev.pos")
def event_verdicts(spark, sf_dir):
    events, transitions, _ = _sync_state(spark, sf_dir)
    return sync.event_verdicts(events, transitions).select("event_id", "verdict", "status_after")


_SYNC_HOT = _SYNC.replace("SELECT *, row_number()", "SELECT * REPLACE ('je-all' AS request_id), row_number()")


@query("e_k10_hot_key_state", _SYNC_HOT + "SELECT request_id, status, attempt_count FROM state")
def hot_key_state(spark, sf_dir):
    """All events as those of one posting: a key that holds every row."""
    events = derived.sync_events(spark, sf_dir).withColumn("request_id", F.lit("je-all"))
    state = sync.current_state(_postings(events), sync.fold_events(events))
    return state.select("request_id", "status", "attempt_count")


@query("e_f7_sync_state", _SYNC + "SELECT request_id, status, attempt_count FROM state")
def sync_state(spark, sf_dir):
    return _sync_state(spark, sf_dir)[2].select("request_id", "status", "attempt_count")


@query(
    "e_e12_status_counts",
    _SYNC + "SELECT s.status, count(st.status) AS n FROM (VALUES ('pending'), ('in_progress'), ('succeeded'), ('retryable_error'), ('permanent_error')) s(status) LEFT JOIN state st ON st.status = s.status GROUP BY 1",
)
def status_counts(spark, sf_dir):
    return sync.status_counts(_sync_state(spark, sf_dir)[2])


@query("e_e12_completion", _SYNC + "SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) > 0 AND bool_and(status = 'succeeded') AS complete FROM state")
def completion(spark, sf_dir):
    return sync.completion(_sync_state(spark, sf_dir)[2])


_LATE = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    "e_e17_run_summary",
    _SYNC + f""", t AS (SELECT c.*, e.at FROM chain c JOIN ev e ON e.pos = c.pos)
    SELECT count(*) FILTER (status = 'succeeded' AND t.at >= {_LATE}) AS new, count(*) FILTER (status = 'in_progress' AND attempt > 1 AND t.at >= {_LATE}) AS retries,
      count(DISTINCT request_id) FILTER (status = 'succeeded' AND t.at < {_LATE}) AS reused FROM t""",
)
def run_summary(spark, sf_dir):
    _, transitions, state = _sync_state(spark, sf_dir)
    late = F.col("pos.at") >= F.expr(_LATE)
    return sync.run_summary(state, transitions.where(late), transitions.where(~late))


@query(
    "e_k12_c10_stale_recovery",
    _SYNC + f""", s AS (SELECT st.request_id, st.status, st.attempt_count, e.at FROM state st JOIN ev e ON e.pos = st.pos)
    SELECT request_id, attempt_count, s.at > (SELECT max(ev.at) FROM ev) - INTERVAL 15 MINUTE AS blocks_run,
      CASE WHEN s.at <= (SELECT max(ev.at) FROM ev) - INTERVAL 15 MINUTE THEN 'retryable' END AS recovery_kind FROM s WHERE status = 'in_progress'""",
)
def stale_recovery(spark, sf_dir):
    events, _, state = _sync_state(spark, sf_dir)
    now = events.agg(F.max("at").alias("now")).first()["now"]
    return sync.stale_recovery(state, F.lit(now)).select("request_id", "attempt_count", "blocks_run", "recovery_kind")


@query(
    "e_k11_outcome_classification",
    f"""WITH a AS ({derived.ATTEMPTS}), k AS (SELECT *, transport_error OR bad_response OR http_status IS NOT NULL AS bad FROM a)
    SELECT event_id, CASE WHEN NOT bad THEN 'succeed' WHEN transport_error OR bad_response OR http_status IN (401,408,425,429,500,502,503,504) THEN 'retryable' ELSE 'permanent' END AS kind,
      CASE WHEN transport_error THEN 'transport_error' WHEN bad_response THEN 'invalid_response' WHEN http_status IS NOT NULL THEN coalesce(provider_code, concat('http_', http_status)) END AS error_code,
      CASE WHEN bad THEN trim(regexp_replace(message, '\\s+', ' ', 'g')) END AS error_message FROM k""",
)
def outcome_classification(spark, sf_dir):
    return sync.classify_outcomes(derived.attempts(spark, sf_dir)).select("event_id", "kind", "error_code", "error_message")


@query(
    "e_k9_create_pending",
    _PLANS + """, p AS (SELECT *, ('0x' || substr(request_id, 4, 2))::int % 4 AS slot FROM plans)
    SELECT outcome, count(*) AS n FROM (SELECT CASE slot WHEN 0 THEN 'existing' WHEN 1 THEN 'plan_conflict' WHEN 2 THEN 'source_conflict' ELSE 'created' END AS outcome FROM p) GROUP BY 1""",
)
def create_pending(spark, sf_dir):
    """Plans against records that hold some exactly, some changed, some under another id."""
    made, _ = _inventory(spark, sf_dir)
    slot = F.conv(F.substring("request_id", 4, 2), 16, 10).cast("int") % 4
    rows = made.withColumn("_slot", slot)
    records = rows.where("_slot < 3").withColumns(
        {
            "currency": F.when(F.col("_slot") == 1, F.lit("EUR")).otherwise(F.col("currency")),
            "request_id": F.when(F.col("_slot") == 2, F.concat(F.lit("old-"), "request_id")).otherwise(F.col("request_id")),
        }
    )
    judged = sync.create_pending(made, records)
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e_d19_succeeded_split",
    _PLANS + """, p AS (SELECT *, ('0x' || substr(request_id, 4, 2))::int % 4 AS slot FROM plans)
    SELECT count(*) FILTER (slot = 0) AS reused, count(*) FILTER (slot <> 0) AS to_post FROM p""",
)
def succeeded_split(spark, sf_dir):
    made, _ = _inventory(spark, sf_dir)
    slot = F.conv(F.substring("request_id", 4, 2), 16, 10).cast("int") % 4
    state = made.select("request_id", F.when(slot == 0, F.lit("succeeded")).otherwise(F.lit("pending")).alias("status"))
    done, todo = sync.split_succeeded(made.select("request_id"), state)
    marked = done.select(F.lit(1).alias("done")).union(todo.select(F.lit(0).alias("done")))
    return marked.agg(F.sum("done").alias("reused"), F.sum(1 - F.col("done")).alias("to_post"))


@query(
    "e_e13_dashboard",
    "WITH " + _SYNC.split("WITH RECURSIVE ", 1)[1].join(["RECURSIVE ", ""]) + ", " + with_blocks("classified").split("WITH ", 1)[1] + """
    SELECT (SELECT count(*) FROM transactions) AS normalized_transactions, (SELECT count(*) FROM canonical) AS canonical_transactions,
      (SELECT count(*) FROM transactions WHERE status = 'duplicate') AS duplicates, (SELECT count(*) FROM transactions WHERE status = 'invalid') AS invalid,
      (SELECT count(*) FROM classified) AS classifications, (SELECT count(*) FROM classified WHERE review_status = 'approved') AS approved,
      (SELECT count(*) FROM classified WHERE review_status = 'pending') AS pending_review, (SELECT count(*) FROM state) AS sync_records,
      (SELECT count(DISTINCT upload_seq) FROM raw) AS uploads, (SELECT count(*) FROM raw) AS raw_records""",
)
def dashboard(spark, sf_dir):
    raw = views.raw_bank(spark, sf_dir)
    uploads = raw.select("upload_seq").distinct()
    return ledger.dashboard(
        stages.transactions(spark, sf_dir), derived.classified(spark, sf_dir), _sync_state(spark, sf_dir)[2], uploads, raw
    )


@query(
    "e_b19_posting_amounts",
    with_blocks("resolved") + "SELECT id, cast(abs(amount) AS varchar) AS amount, direction FROM canonical",
)
def posting_amounts(spark, sf_dir):
    return stages.canonical(spark, sf_dir).select(
        "id", F.abs("amount").cast(money.MONEY).alias("amount"), money.direction(F.col("amount")).alias("direction")
    )
