"""Registered queries over tables with planted faults: every rule must name the rows that break it.

A row's fault follows from its id or number, by the same expression in Spark and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.config import defaults
from tallybook.constants import ACCOUNT_TYPE_FOR
from tallybook.operators import accounts as acc
from tallybook.operators import checks, patterns, pnl, posting, reconcile, review
from tallybook.plans import derived, report_queries, stages, views
from tallybook.plans.registry import query
from tallybook.plans.report_queries import _OUTSIDE, _PLANS, _SYNC, END, START, _entries, _internal, _inventory
from tallybook.plans.sql import with_blocks
from tallybook.sources import config, reports

_NAMES = {a[0]: a[1] for a in defaults.ACCOUNTS}
_ACCOUNT_TYPES = {a[0]: a[2] for a in defaults.ACCOUNTS}


def _first(name: str = "id") -> Column:
    """First hexadecimal digit of an id: the slot that decides its fault."""
    return F.substring(name, 1, 1)


def _planted(df: DataFrame, slot: Column, faults: dict[str, dict[str, Column]]) -> DataFrame:
    """Columns replaced in the rows of a slot."""
    slots: dict[str, Column] = {}
    for place, columns in faults.items():
        for name, value in columns.items():
            slots[name] = F.when(slot == place, value).otherwise(slots.get(name, F.col(name)))
    return df.withColumns(slots)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


# --- transactions -------------------------------------------------------------------------------


@query(
    "e_i1_transaction_violations",
    with_blocks("resolved") + """, v AS (SELECT id, direction, substr(id, 1, 1) AS slot FROM transactions WHERE status = 'valid')
    SELECT id, direction || CASE direction WHEN 'inflow' THEN '_not_positive' ELSE '_not_negative' END AS violation FROM v WHERE slot IN ('0', '2')
    UNION ALL SELECT id, unnest(CASE slot WHEN '1' THEN ['usable_row_incomplete'] WHEN '2' THEN ['usable_row_with_zero_amount'] WHEN '3' THEN ['invalid_row_without_errors']
      WHEN '4' THEN ['duplicate_without_link'] WHEN '5' THEN ['link_without_duplicate', 'link_to_itself'] WHEN '6' THEN ['currency_not_ascii_code']
      WHEN '7' THEN ['usable_row_with_errors'] ELSE [] END) FROM v""",
)
def transaction_violations(spark, sf_dir):
    rows = stages.transactions(spark, sf_dir).where("status = 'valid'")
    issues = rows.schema["validation_issues"].dataType
    wrong = F.from_json(F.lit('[{"code": "planted", "severity": "error"}]'), issues)
    faulty = _planted(
        rows, _first(),
        {
            "0": {"amount": -F.col("amount")},
            "1": {"currency": _none("string")},
            "2": {"amount": F.lit(0).cast(rows.schema["amount"].dataType)},
            "3": {"status": F.lit("invalid")},
            "4": {"status": F.lit("duplicate")},
            "5": {"duplicate_of": F.col("id")},
            "6": {"currency": F.lit("ÜSD")},
            "7": {"validation_issues": wrong},
        },
    )
    return checks.violations(faulty, checks.transaction_rules(), ["id"])


@query(
    "e_d13_orphan_classifications",
    with_blocks("classified") + "SELECT concat('gone-', id) AS id FROM classified WHERE row_no % 17 = 0",
)
def orphan_classifications(spark, sf_dir):
    gone = F.when(F.col("row_no") % 17 == 0, F.concat(F.lit("gone-"), F.col("id"))).otherwise(F.col("id"))
    held = derived.classified(spark, sf_dir).withColumn("id", gone)
    return review.orphan_classifications(held, stages.transactions(spark, sf_dir)).select("id")


# Types that may post to an account of the type that account 1000 has.
_ON_1000 = ", ".join(f"'{kind}'" for kind, account in ACCOUNT_TYPE_FOR.items() if account == _ACCOUNT_TYPES["1000"])


@query(
    "e_i9_decision_targets",
    with_blocks("classified") + f"""SELECT id, unnest(CASE substr(id, 1, 1) WHEN '0' THEN ['unusable_account', 'wrong_target'] WHEN '1' THEN ['unusable_account']
      WHEN '2' THEN CASE WHEN transaction_type IN ({_ON_1000 or "''"}) THEN [] ELSE ['wrong_target'] END ELSE [] END) AS violation FROM classified""",
)
def decision_targets(spark, sf_dir):
    """Stored decisions whose account is unknown, misnamed, or of a type that the decision may not use."""
    held = _planted(
        derived.classified(spark, sf_dir), _first(),
        {
            "0": {"account_number": F.lit("9999")},
            "1": {"account_name": F.lit("Misnamed")},
            "2": {"account_number": F.lit("1000"), "account_name": F.lit(_NAMES["1000"])},
        },
    )
    rows = acc.with_account(held, config.default_chart(spark))
    rules = {
        "unusable_account": acc.account_problem(F.col("account"), F.col("account_name")).isNotNull(),
        "wrong_target": acc.target_problem(F.col("transaction_type"), F.col("account")).isNotNull(),
    }
    return checks.violations(rows, rules, ["id"])


# --- history and patterns -----------------------------------------------------------------------


@query(
    "e_f5_j9_history_violations",
    with_blocks("classified") + """SELECT id, CASE row_no % 5 WHEN 1 THEN 'step_skips_versions' WHEN 2 THEN 'chain_broken'
      WHEN 3 THEN 'chain_starts_late' WHEN 4 THEN 'state_differs_from_history' END AS violation FROM classified WHERE row_no % 5 <> 0""",
)
def history_violations(spark, sf_dir):
    """Three steps for every transaction; a step missing, too long, or a state that is not the last step's."""
    held = derived.classified(spark, sf_dir).select("id", "row_no")
    slot, step = F.col("row_no") % 5, F.col("from_version")
    steps = held.withColumn("from_version", F.explode(F.sequence(F.lit(1), F.lit(3))))
    steps = steps.where(~(((slot == 2) & (step == 2)) | ((slot == 3) & (step == 1))))
    history = steps.select("id", "from_version", (step + F.when((slot == 1) & (step == 2), 2).otherwise(1)).alias("to_version"))
    state = held.select("id", F.when(slot == 4, 5).otherwise(4).alias("version"))
    return review.history_violations(history, state)


# Every classified row, as if a reviewer had corrected and then approved or rejected it.
_CORRECTED = """, corrected AS (SELECT c.id, c.row_no, 2 AS version, concat('Party ', c.row_no % 4) AS party, c.account_number, c.review_status,
      concat('reviewer-', c.row_no % 9) AS reviewer, t.description_normalized, t.bank_account, t.direction, t.currency
      FROM classified c JOIN canonical t ON t.id = c.id),
    learned AS (SELECT * FROM corrected WHERE review_status = 'approved')"""


def _corrected(spark, sf_dir) -> DataFrame:
    row_no = F.col("row_no")
    return derived.classified(spark, sf_dir).withColumns(
        {
            "version": F.lit(2), "source": F.lit("manual_review"),
            "counterparty_name": F.concat(F.lit("Party "), (row_no % 4).cast("string")),
            "reviewed_by": F.concat(F.lit("reviewer-"), (row_no % 9).cast("string")),
            "reviewed_at": F.timestamp_seconds(row_no.cast("long")),
        }
    )


def _learned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    state = _corrected(spark, sf_dir)
    learned = patterns.learn_patterns(stages.transactions(spark, sf_dir), state, config.default_chart(spark))
    return stages.once(spark, sf_dir, "learned_patterns", lambda: learned), state


@query(
    "e_j10_learned_patterns",
    with_blocks("classified") + _CORRECTED + """ SELECT id AS source_transaction_id, version AS source_version, description_normalized, account_number,
      party AS counterparty_name, reviewer AS approved_by FROM learned""",
)
def learned_patterns(spark, sf_dir):
    return _learned(spark, sf_dir)[0].select(
        "source_transaction_id", "source_version", "description_normalized", "account_number", "counterparty_name", "approved_by"
    )


@query(
    "e_j11_save_patterns",
    with_blocks("classified") + _CORRECTED + """, held AS (SELECT description_normalized, bank_account, direction, currency, arg_min(id, (row_no, id)) AS id,
        arg_min(row_no, (row_no, id)) AS held_row FROM learned WHERE row_no % 20 = 0 GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY description_normalized, bank_account, direction, currency ORDER BY row_no, id) AS place FROM learned)
    SELECT r.id AS source_transaction_id, CASE WHEN h.id = r.id AND held_row % 3 <> 0 THEN 'unchanged' WHEN h.id IS NOT NULL THEN 'conflict'
        WHEN place = 1 THEN 'inserted' ELSE 'conflict' END AS outcome
      FROM ranked r LEFT JOIN held h USING (description_normalized, bank_account, direction, currency)""",
)
def save_patterns(spark, sf_dir):
    """Learned patterns, many for one key, against a store that holds some, a third of those with another counterparty."""
    learned, state = _learned(spark, sf_dir)
    some = learned.join(state.select(F.col("id").alias("source_transaction_id"), "row_no"), "source_transaction_id")
    stored = patterns.first_per_key(some.where("row_no % 20 = 0")).withColumn(
        "counterparty_name", F.when(F.col("row_no") % 3 == 0, F.lit("Somebody else")).otherwise(F.col("counterparty_name"))
    )
    return patterns.save_patterns(learned, stored).select("source_transaction_id", "outcome")


@query(
    "e_d14_pattern_provenance",
    with_blocks("classified") + _CORRECTED + """ SELECT CASE WHEN slot = '0' THEN 'gone-' ELSE '' END || id AS source_transaction_id,
      CASE slot WHEN '0' THEN 'missing_transaction' WHEN '1' THEN 'key_differs' WHEN '2' THEN 'version_differs' WHEN '3' THEN 'decision_differs'
        WHEN '4' THEN 'missing_classification' WHEN '5' THEN 'not_approved' END AS violation
      FROM (SELECT *, substr(id, 1, 1) AS slot FROM learned) WHERE slot < '6'""",
)
def pattern_provenance(spark, sf_dir):
    learned, state = _learned(spark, sf_dir)
    slot = _first("source_transaction_id")
    faulty = _planted(
        learned, slot,
        {
            "1": {"description_normalized": F.concat("description_normalized", F.lit(" x"))},
            "2": {"source_version": F.col("source_version") + 1},
            "3": {"account_number": F.lit("9999")},
        },
    )
    gone = F.when(slot == "0", F.concat(F.lit("gone-"), F.col("source_transaction_id")))
    faulty = faulty.withColumn("source_transaction_id", F.coalesce(gone, F.col("source_transaction_id")))
    current = state.where(_first() != "4").withColumn(
        "review_status", F.when(_first() == "5", F.lit("pending")).otherwise(F.col("review_status"))
    )
    found = patterns.provenance_violations(faulty, stages.transactions(spark, sf_dir), current)
    return found.select("source_transaction_id", "violation")


# --- profit and loss ----------------------------------------------------------------------------


def _faulty_entries(spark, sf_dir) -> DataFrame:
    rows = report_queries._sources(spark, sf_dir)
    faulty = _planted(
        rows, _first(),
        {
            "0": {"account_number": F.lit("4999")},
            "1": {"account_name": F.lit("Misnamed")},
            "2": {"bank_account": _none("string")},
            "3": {"amount": -F.col("amount")},
            "4": {"description_original": _none("string"), "description_normalized": _none("string")},
            "5": {"transaction_date": _none("date")},
            "6": {"amount": _none("decimal(18,2)")},
            "7": {"account_number": F.lit("1000"), "account_name": F.lit(_NAMES["1000"])},
        },
    )
    entries = pnl.prepare_entries(faulty, config.default_chart(spark))
    return _planted(entries, _first(), {"8": {"report_amount": F.col("report_amount") + 1}})


@query(
    "e_i2_i11_entry_violations",
    with_blocks("entries") + """SELECT id, unnest(CASE substr(id, 1, 1) WHEN '0' THEN ['unknown_account'] WHEN '1' THEN ['account_name_mismatch']
      WHEN '2' THEN ['missing_bank_account'] WHEN '3' THEN ['wrong_sign', CASE transaction_type WHEN 'revenue' THEN 'revenue_not_positive' WHEN 'refund' THEN 'refund_not_negative'
      ELSE 'cost_not_negative' END] WHEN '4' THEN ['missing_description'] WHEN '5' THEN ['missing_date'] WHEN '6' THEN ['missing_amount']
      WHEN '7' THEN ['account_type_not_allowed'] WHEN '8' THEN ['report_amount_differs'] ELSE [] END) AS violation FROM entries""",
)
def entry_violations(spark, sf_dir):
    entries = _faulty_entries(spark, sf_dir)
    return checks.violations(entries, checks.entry_rules(), ["id"]).union(pnl.entry_problems(entries))


@query(
    "e_i3_line_violations",
    with_blocks("entries") + """, l AS (SELECT *, extract(month FROM month) AS m FROM lines WHERE month IS NOT NULL)
    SELECT month::varchar AS month, account_number, unnest(CASE WHEN m = 1 THEN ['total_differs'] WHEN m = 2 THEN ['count_differs']
      WHEN m = 3 THEN ['total_differs', 'count_differs', 'unknown_section', 'total_differs', 'count_differs'] || CASE WHEN total < 0 THEN ['negative_cost'] ELSE [] END
      WHEN m = 4 AND section <> 'revenue' THEN ['total_differs', 'negative_cost'] ELSE [] END) AS violation FROM l""",
)
def line_violations(spark, sf_dir):
    """Lines a unit off, miscounted, under an unknown section, and costs of the wrong sign."""
    entries = _entries(spark, sf_dir)
    costs = F.col("section") != "revenue"
    lines = _planted(
        pnl.account_lines(entries), F.month("month"),
        {
            1: {"total": (F.col("total") + 1).cast("decimal(28,2)")},
            2: {"transaction_count": F.col("transaction_count") + 1},
            3: {"section": F.lit("other")},
            4: {"total": F.when(costs, -F.col("total")).otherwise(F.col("total"))},
        },
    )
    return checks.line_violations(lines, entries)


@query(
    "e_i4_i5_statement_violations",
    with_blocks("entries") + """, s AS (SELECT *, extract(month FROM start_date) AS m FROM statements WHERE statement = 'monthly')
    SELECT CASE WHEN m = 6 THEN start_date + 1 ELSE start_date END::DATE::varchar AS start_date,
      unnest(CASE m WHEN 3 THEN ['gross_profit_differs', 'net_profit_differs'] WHEN 4 THEN ['net_profit_differs']
        WHEN 5 THEN ['period_backwards', 'month_too_long'] WHEN 6 THEN ['not_whole_months']
        WHEN 7 THEN ['not_whole_months', 'month_too_long'] WHEN 8 THEN ['negative_count'] ELSE [] END) AS violation FROM s
    UNION ALL SELECT NULL, unnest(['gross_profit_differs', 'net_profit_differs', 'transaction_count_differs'])""",
)
def statement_violations(spark, sf_dir):
    made = _planted(
        pnl.statements(_entries(spark, sf_dir), START, END),
        F.when(F.col("statement") == "monthly", F.month("start_date")),
        {
            3: {"gross_profit": (F.col("gross_profit") + 1).cast("decimal(28,2)")},
            4: {"net_profit": (F.col("net_profit") + 1).cast("decimal(28,2)")},
            5: {"end_date": F.date_sub("start_date", 1)},
            6: {"start_date": F.date_add("start_date", 1)},
            7: {"end_date": F.date_add("end_date", 10)},
            8: {"transaction_count": F.lit(-1).cast("long")},
        },
    )
    single = checks.violations(made, checks.statement_rules(), ["start_date"])
    whole = checks.report_set_violations(made).select(_none("date").alias("start_date"), "violation")
    return single.unionByName(whole)


@query(
    "e_f6_month_gaps",
    with_blocks("entries") + """, s AS (SELECT start_date, end_date FROM statements WHERE statement = 'monthly' AND extract(month FROM start_date) % 5 <> 0)
    SELECT start_date::varchar AS start_date, end_date::varchar AS end_date FROM s WHERE (end_date + 1)::DATE NOT IN (SELECT start_date FROM s) AND end_date < (SELECT max(end_date) FROM s)""",
)
def month_gaps(spark, sf_dir):
    made = pnl.statements(_entries(spark, sf_dir), START, END)
    return checks.month_gaps(made.where((F.col("statement") != "monthly") | (F.month("start_date") % 5 != 0)))


@query(
    "e_h3_month_union",
    with_blocks("entries") + """SELECT id, CASE extract(day FROM transaction_date) WHEN 13 THEN 'right' ELSE 'left' END AS only_in FROM entries
      WHERE extract(day FROM transaction_date) IN (13, 14)""",
)
def month_union(spark, sf_dir):
    """Ids of the whole period against those of the months; each side lacks one day of every month."""
    day = F.dayofmonth("transaction_date")
    whole = report_queries._sources(spark, sf_dir).where(day != 13).select("id")
    monthly = _entries(spark, sf_dir).where(F.col("month").between(F.lit(START), F.lit(END)) & (day != 14)).select("id")
    return checks.set_differences(whole, monthly)


# --- posting plans and sync ---------------------------------------------------------------------


@query(
    "e_h2_coverage",
    _PLANS + """, k AS (SELECT first_id AS id FROM plans UNION ALL SELECT second_id FROM plans WHERE second_id IS NOT NULL UNION ALL
        SELECT id FROM issues WHERE substr(id, 1, 1) <> '0' UNION ALL SELECT id FROM issues WHERE substr(id, 1, 1) = '1' UNION ALL SELECT 'gone-' || id FROM issues WHERE substr(id, 1, 1) = '2')
    SELECT coalesce(c.id, k.id) AS id, count(DISTINCT c.id) AS canonical, count(k.id) AS covered FROM canonical c FULL JOIN k ON k.id = c.id
      GROUP BY 1 HAVING count(DISTINCT c.id) <> 1 OR count(k.id) <> 1""",
)
def coverage(spark, sf_dir):
    """Rows covered by nothing, twice, and rows that are covered without being there."""
    made, blocked = _inventory(spark, sf_dir)
    twice = blocked.where(_first() == "1")
    gone = blocked.where(_first() == "2").withColumn("id", F.concat(F.lit("gone-"), F.col("id")))
    faulty = blocked.where(_first() != "0").unionByName(twice).unionByName(gone)
    return posting.coverage_violations(stages.transactions(spark, sf_dir), made, faulty)


@query(
    "e_i6_plan_violations",
    _PLANS + """, p AS (SELECT *, ('0x' || substr(request_id, 4, 1))::int AS slot FROM plans)
    SELECT CASE WHEN slot = 4 THEN 'x' ELSE '' END || request_id AS request_id, unnest(CASE slot WHEN 0 THEN ['not_two_lines', 'one_sided', 'unbalanced']
      WHEN 1 THEN ['currency_not_a_code'] WHEN 2 THEN ['amount_not_positive'] WHEN 3 THEN ['same_account'] WHEN 4 THEN ['request_id_not_derived']
      WHEN 5 THEN ['repeated_source', 'request_id_not_derived'] || CASE kind WHEN 'transfer' THEN ['not_one_or_two_sources'] ELSE [] END
      WHEN 6 THEN ['unbalanced'] WHEN 7 THEN ['same_account_number'] ELSE [] END) AS violation FROM p""",
)
def plan_violations(spark, sf_dir):
    made, _ = _inventory(spark, sf_dir)
    lines = F.col("lines")
    kind = made.schema["lines"].dataType

    def second(**changes) -> Column:
        """The lines with fields of the second one replaced."""
        line = lines[1]
        for name, value in changes.items():
            line = line.withField(name, value)
        return F.array(lines[0], line).cast(kind)

    negative = F.transform(lines, lambda l: l.withField("amount", (-l["amount"]).cast("decimal(18,2)"))).cast(kind)
    faulty = _planted(
        made, F.conv(F.substring("request_id", 4, 1), 16, 10).cast("int"),
        {
            0: {"lines": F.slice(lines, 1, 1)},
            1: {"currency": F.lower("currency")},
            2: {"lines": negative},
            3: {"lines": second(external_id=lines[0]["external_id"])},
            4: {"request_id": F.concat(F.lit("x"), F.col("request_id"))},
            5: {"sources": F.concat("sources", "sources")},
            6: {"lines": second(amount=(lines[1]["amount"] + 1).cast("decimal(18,2)"))},
            7: {"lines": second(account_number=lines[0]["account_number"])},
        },
    )
    return checks.violations(faulty, checks.plan_rules(), ["request_id"])


@query(
    "e_i_sync_violations",
    _SYNC + """SELECT request_id, CASE slot WHEN 0 THEN 'updated_before_created' WHEN 1 THEN 'pending_with_attempts' ELSE 'started_without_attempt' END AS violation
      FROM (SELECT request_id, cast(substr(request_id, 4) AS bigint) % 5 AS slot FROM state) WHERE slot < 3""",
)
def sync_violations(spark, sf_dir):
    state = report_queries._sync_state(spark, sf_dir)[2]
    faulty = _planted(
        state, F.substring("request_id", 4, 20).cast("long") % 5,
        {
            0: {"updated_at": F.col("created_at") - F.expr("interval 1 day"), "status": F.lit("pending"), "attempt_count": F.lit(0)},
            1: {"updated_at": F.col("created_at"), "status": F.lit("pending"), "attempt_count": F.lit(2)},
            2: {"updated_at": F.col("created_at"), "status": F.lit("succeeded"), "attempt_count": F.lit(0)},
        },
    )
    return checks.violations(faulty, checks.sync_rules(), ["request_id"])


# --- outside reports ----------------------------------------------------------------------------

_UNKNOWN = '"id":"X5000"'


def _faulty_reports(spark, sf_dir) -> DataFrame:
    """Monthly reports of eight months of every year, each kind of month with one flaw."""
    made = stages.once(spark, sf_dir, "reports", lambda: report_queries._reports(spark, sf_dir))
    payload = F.col("payload")

    def swap(old: str, new: str) -> Column:
        return F.replace(payload, F.lit(old), F.lit(new))

    monthly = made.where(F.last_day("expected_start") == F.col("expected_end"))
    return _planted(
        monthly, F.month("expected_start"),
        {
            1: {"payload": swap('"Cash"', '"Accrual"')},
            2: {"payload": swap('"ProfitAndLoss"', '"BalanceSheet"')},
            3: {"payload": swap('"usd"', '"us"')},
            4: {"payload": swap('"group":"NetIncome"', '"group":"Other"')},
            5: {"payload": swap('"group":"GrossProfit"', '"group":"Income"')},
            6: {"payload": F.substring(payload, 1, 100)},
            7: {"payload": swap(_UNKNOWN, '"id":"X0000"')},
            8: {"expected_start": F.add_months("expected_start", -1)},
        },
    )


_TRUSTED = """extract(month FROM start_date) > 8 OR extract(month FROM start_date) = 7 AND NOT EXISTS
      (SELECT 1 FROM outer_lines o WHERE o.account_number = '5000' AND o.start_date = x.start_date AND o.end_date = x.end_date)"""


@query(
    "e_k7_report_problems",
    _OUTSIDE + """, x AS (SELECT *, extract(month FROM start_date) AS m, start_date::varchar || '..' || end_date::varchar AS report_id FROM statements WHERE statement = 'monthly')
    SELECT report_id, unnest(CASE m WHEN 1 THEN ['not_cash_basis'] WHEN 2 THEN ['wrong_report'] WHEN 3 THEN ['invalid_currency'] WHEN 4 THEN ['missing_totals: NetIncome']
      WHEN 5 THEN ['missing_totals: GrossProfit', 'repeated_totals: Income'] WHEN 6 THEN ['invalid_json'] WHEN 8 THEN ['other_period'] ELSE [] END) AS problem FROM x
    UNION ALL SELECT report_id, 'unknown_account: X0000' FROM x JOIN outer_lines o ON o.start_date = x.start_date AND o.end_date = x.end_date AND o.account_number = '5000' WHERE m = 7""",
)
def report_problems(spark, sf_dir):
    problems = reports.external_statements(_faulty_reports(spark, sf_dir), derived.external_accounts(spark))[2]
    # Without its header a report has no totals either: that follows from the first finding.
    header = problems.where(~F.col("problem").contains(": ")).select("report_id").distinct()
    follows = F.col("problem").startswith("missing_totals")
    kept = problems.where(~follows).unionByName(problems.where(follows).join(header, "report_id", "left_anti"))
    return kept.select("report_id", "problem")


@query(
    "e_k7_trusted_lines",
    _OUTSIDE + f"""SELECT start_date::varchar AS start_date, end_date::varchar AS end_date, account_number, cast(amount AS varchar) AS amount FROM outer_lines x
      WHERE end_date = last_day(start_date) AND ({_TRUSTED})""",
)
def trusted_lines(spark, sf_dir):
    """Lines of the reports without any problem: a flawed report gives none at all."""
    lines = reports.external_statements(_faulty_reports(spark, sf_dir), derived.external_accounts(spark))[0]
    return lines.select("start_date", "end_date", "account_number", F.col("amount").cast("decimal(28,2)").alias("amount"))


_GAPS = """, t AS (SELECT start_date, end_date, extract(month FROM start_date) AS m, total_revenue FROM statements WHERE statement = 'monthly'),
    kept AS (SELECT *, m <> 9 AS outside, m <> 10 AS inside FROM t)"""


@query(
    "e_k8_period_mismatches",
    with_blocks("entries") + _GAPS + """SELECT start_date::varchar AS start_date, end_date::varchar AS end_date, 'USD' AS currency,
      CASE WHEN inside THEN 'internal' ELSE 'external' END AS only_in FROM kept WHERE inside <> outside""",
)
def period_mismatches(spark, sf_dir):
    monthly = F.last_day("start_date") == F.col("end_date")
    totals = _internal(spark, sf_dir)[1].where(monthly).withColumn("currency", F.lit("USD"))
    return reconcile.period_mismatches(
        totals.where(F.month("start_date") != 10), totals.where(F.month("start_date") != 9)
    )


@query(
    "e_k8_one_sided_totals",
    with_blocks("entries") + _GAPS + """SELECT start_date::varchar AS start_date, cast(CASE WHEN inside THEN total_revenue ELSE 0 END AS varchar) AS internal_amount,
      cast(CASE WHEN outside THEN total_revenue ELSE 0 END AS varchar) AS external_amount, inside AND outside AS reconciled FROM kept""",
)
def one_sided_totals(spark, sf_dir):
    """A period that one side lacks stays in the comparison, against zero, and is never reconciled."""
    monthly = F.last_day("start_date") == F.col("end_date")
    totals = _internal(spark, sf_dir)[1].where(monthly)
    compared = reconcile.reconcile_totals(
        totals.where(F.month("start_date") != 10), totals.where(F.month("start_date") != 9)
    )
    return compared.where("key = 'total_revenue'").select("start_date", "internal_amount", "external_amount", "reconciled")


# --- configuration ------------------------------------------------------------------------------

# A chart of accounts from the suppliers; their numbers decide the faults.
CHART = """
SELECT CASE s_suppkey % 20 WHEN 1 THEN 'A12' WHEN 5 THEN lpad(cast(s_suppkey - 1 AS string), 4, '0') ELSE lpad(cast(s_suppkey AS string), 4, '0') END AS number,
       CASE s_suppkey % 20 WHEN 4 THEN '  ' WHEN 7 THEN concat('SAME ', cast(s_suppkey - 1 AS string)) WHEN 6 THEN concat('same ', cast(s_suppkey AS string)) ELSE s_name END AS name,
       CASE s_suppkey % 20 WHEN 2 THEN 'Odd' ELSE CASE s_suppkey % 3 WHEN 0 THEN 'Bank' ELSE 'Expenses' END END AS account_type,
       CASE WHEN s_suppkey % 20 = 3 THEN 'other' WHEN s_suppkey % 3 = 0 THEN 'balance_sheet' ELSE 'profit_and_loss' END AS statement, true AS active
FROM supplier
"""


@query(
    "e_i7_chart_violations",
    f"""WITH c AS ({CHART})
    SELECT number, 'number_not_four_digits' AS violation FROM c WHERE NOT regexp_full_match(number, '[0-9]{{4}}')
    UNION ALL SELECT number, 'unknown_type' FROM c WHERE account_type NOT IN ('Bank', 'Fixed Assets', 'Equity', 'Income', 'Cost of Goods Sold', 'Expenses')
    UNION ALL SELECT number, 'wrong_statement' FROM c WHERE account_type = 'Bank' AND statement <> 'balance_sheet' OR account_type = 'Expenses' AND statement <> 'profit_and_loss'
    UNION ALL SELECT number, 'blank_name' FROM c WHERE trim(name) = ''
    UNION ALL SELECT number, 'repeated_number' FROM c GROUP BY number HAVING count(*) > 1
    UNION ALL SELECT number, 'repeated_name' FROM c WHERE lower(name) IN (SELECT lower(name) FROM c GROUP BY 1 HAVING count(*) > 1)""",
)
def chart_violations(spark, sf_dir):
    views.register_tables(spark, sf_dir, "supplier")
    return checks.chart_violations(spark.sql(CHART))


# Rules from the parts: messy phrases and names as configuration files hold them, and planted faults.
RULES = """
SELECT CASE WHEN p_partkey % 20 = 7 THEN concat('rule-', cast(p_partkey - 1 AS string)) ELSE concat('rule-', cast(p_partkey AS string)) END AS id,
       cast(CASE WHEN p_partkey % 20 = 6 THEN p_partkey - 1 ELSE p_partkey END AS int) AS priority,
       CASE WHEN p_partkey % 20 = 1 THEN '' ELSE concat('  ', p_brand, '   Shop ') END AS phrase,
       CASE WHEN p_partkey % 20 = 2 THEN concat(p_brand, ' shop') ELSE 'void' END AS excluded,
       CASE WHEN p_partkey % 20 = 3 THEN '0.5' ELSE '0.95' END AS confidence,
       CASE WHEN p_partkey % 20 = 4 THEN 'nonsense' ELSE 'operating_expense' END AS transaction_type,
       CASE WHEN p_partkey % 20 = 5 THEN '9999' WHEN p_partkey % 20 = 8 THEN '4000' ELSE '6010' END AS account_number,
       CASE WHEN p_partkey % 20 = 8 THEN 'Repair Service Revenue' WHEN p_partkey % 20 = 9 THEN 'Misnamed' ELSE 'Rent Expense' END AS account_name,
       concat(' ', p_type, '  Straße ') AS bank_account
FROM part
"""


def _part_rules(spark, sf_dir) -> DataFrame:
    views.register_tables(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    return config.clean_rules(
        spark.sql(RULES).select(
            "*", none.alias("description_exact"), none.alias("description_all"), F.array("phrase").alias("description_any"),
            F.array("excluded").alias("description_none"), F.lit(True).alias("active"), F.lit("outflow").alias("direction"),
            F.lit(" usd").alias("currency"), _none("string").alias("counterparty_name"), F.lit("derived").alias("explanation"),
            F.lit(False).alias("review_required"),
        )
    )


@query(
    "e_i8_rule_violations",
    f"""WITH r AS (SELECT *, trim(regexp_replace(lower(phrase), '\\s+', ' ', 'g')) AS p, lower(excluded) AS x FROM ({RULES}))
    SELECT id, 'no_positive_phrase' AS violation FROM r WHERE p = ''
    UNION ALL SELECT id, 'phrase_required_and_excluded' FROM r WHERE p = x
    UNION ALL SELECT id, 'confidence_out_of_range' FROM r WHERE confidence::decimal(10,9) NOT BETWEEN 0.9 AND 1
    UNION ALL SELECT id, 'unknown_type' FROM r WHERE transaction_type = 'nonsense'
    UNION ALL SELECT id, 'unusable_account' FROM r WHERE account_number = '9999' OR account_name = 'Misnamed'
    UNION ALL SELECT id, 'wrong_target' FROM r WHERE transaction_type = 'nonsense' OR account_number IN ('9999', '4000')
    UNION ALL SELECT id, 'repeated_id' FROM r GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT id, 'repeated_priority' FROM r WHERE priority IN (SELECT priority FROM r GROUP BY 1 HAVING count(*) > 1)""",
)
def rule_violations(spark, sf_dir):
    return checks.rule_violations(_part_rules(spark, sf_dir), config.default_chart(spark))


@query(
    "e_a10_b31_clean_rules",
    f"""SELECT id, trim(regexp_replace(lower(phrase), '\\s+', ' ', 'g')) AS phrase, trim(regexp_replace(replace(lower(bank_account), 'ß', 'ss'), '\\s+', ' ', 'g')) AS bank_account,
      'USD' AS currency FROM ({RULES})""",
)
def clean_rules(spark, sf_dir):
    rows = _part_rules(spark, sf_dir)
    return rows.select("id", F.array_join("description_any", "|").alias("phrase"), "bank_account", "currency")


@query(
    "e_h6_expected_configuration",
    f"""WITH c AS ({CHART}), r AS ({RULES}) SELECT label, actual, expected = actual AS met FROM (
      SELECT 'accounts' AS label, (SELECT count(*) FROM c)::varchar AS actual, (SELECT count(*) FROM supplier)::varchar AS expected
      UNION ALL SELECT 'numbers', (SELECT count(DISTINCT number) FROM c)::varchar, (SELECT count(*) FROM supplier)::varchar
      UNION ALL SELECT 'rules', (SELECT count(*) FROM r)::varchar, (SELECT count(*) FROM part)::varchar)""",
)
def expected_configuration(spark, sf_dir):
    """Configuration measured against what it was made from; an unmet label shows as such."""
    views.register_tables(spark, sf_dir, "supplier", "part")
    chart, rules = spark.sql(CHART), _part_rules(spark, sf_dir)
    actual = checks.measure(chart, {"accounts": F.count(F.lit(1)), "numbers": F.countDistinct("number")}).union(
        checks.measure(rules, {"rules": F.count(F.lit(1))})
    )
    suppliers, parts = spark.table("supplier"), spark.table("part")
    expected = checks.measure(suppliers, {"accounts": F.count(F.lit(1)), "numbers": F.count(F.lit(1))}).union(
        checks.measure(parts, {"rules": F.count(F.lit(1))})
    )
    return checks.expectations(actual, expected).select("label", "actual", "met")
