"""Classification, P&L, posting, reconciliation, folds and sync on small literal tables."""

import json
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.operators import cascade, catalog, checks, ledger, patterns, pnl, posting, reconcile, review, rules, sync
from tallybook.plans import derived
from tallybook.schemas import ISSUES
from tallybook.sources import config, reports

TX = f"""id string, upload_id string, source_transaction_id string, transaction_date date, description_original string,
    description_normalized string, amount decimal(18,2), currency string, bank_account string, bank_key string, direction string,
    status string, duplicate_of string, validation_issues {ISSUES}"""


def tx(spark, *rows):
    """Rows: (id, day, description, amount, bank[, status])."""
    data = []
    for i, day, text, amount, bank, *status in rows:
        value = Decimal(amount)
        data.append((
            i, "u", f"S-{i}", date.fromisoformat(day), text, text.casefold(), value, "USD", bank, " ".join(bank.casefold().split()),
            "inflow" if value > 0 else "outflow", status[0] if status else "valid", None, [],
        ))
    return spark.createDataFrame(data, TX)


CL = """id string, version int, transaction_type string, account_number string, account_name string, counterparty_name string,
    confidence decimal(10,9), explanation string, source string, review_required boolean, review_status string"""


def cl(spark, *rows):
    """Rows: (id, type, account, name, review status[, source, review required])."""
    data = [
        (i, 1, kind, number, name, None, Decimal("1"), "e", (more + ["deterministic_rule"])[0], (more + ["", False])[1] if len(more) > 1 else False, status)
        for i, kind, number, name, status, *more in rows
    ]
    return spark.createDataFrame(data, CL)


MAIN, TAX = "Operating Checking", "Tax Reserve"
RULE_CASES = [
    ("ONLINE TRANSFER TO TAX RESERVE TAX RESERVE TRANSFER", "-5", MAIN, "reserve-out"),
    ("ONLINE TRANSFER FROM OPERATING TAX RESERVE TRANSFER", "5", TAX, "reserve-in"),
    ("ACH refund to ACME", "-5", MAIN, "money-back"), ("Owner deposit", "5", MAIN, "owner-pays-in"), ("Owner deposits", "5", MAIN, None),
    ("purchase of new tools", "-5", MAIN, "tools-bought"), ("AUTO PAY Jo SERVICE PLAN x", "5", MAIN, "plans"),
    ("equipment install job", "5", MAIN, "installs"), ("repair job 7", "5", MAIN, "repairs"), ("repair and install", "5", MAIN, None),
    ("repair job 7", "-5", MAIN, None), ("Google Ads", "-5", MAIN, "ads"), ("google ads 2", "-5", MAIN, None),
    ("wire charge", "-5", MAIN, "bank-charge"), ("adp payroll", "-5", TAX, None), ("pa", "-5", MAIN, None),
]


def test_rules(spark):
    rows = tx(spark, *[(f"t{i:02d}", "2026-04-01", d, a, b) for i, (d, a, b, _) in enumerate(RULE_CASES)])
    found = rules.match_rules(rows, config.default_rules(spark), config.default_chart(spark)).orderBy("id").collect()
    assert [r["rule"] and r["rule"]["rule_id"] for r in found] == [c[3] for c in RULE_CASES]


def test_many_rules_and_accounts(spark):
    """5,000 rules, 20,000 accounts: the first by priority wins; phrases fold like descriptions."""
    accounts = spark.range(20_000).selectExpr(
        "lpad(cast(id as string), 5, '0') as number", "concat('Account ', id) as name", "'Income' as account_type", "'x' as detail_type",
        "'profit_and_loss' as statement", "'' as purpose", "id % 100 <> 7 as active",
    )
    none = F.array().cast("array<string>")
    table = spark.range(5_000).select(
        F.concat(F.lit("r"), "id").alias("id"), (F.lit(5_000) - F.col("id")).cast("int").alias("priority"),
        none.alias("description_exact"), none.alias("description_all"),
        F.array(F.concat(F.lit("Straße "), F.col("id").cast("string"), F.lit(" end"))).alias("description_any"), none.alias("description_none"),
        F.when(F.col("id") % 2 == 0, F.lit("inflow")).alias("direction"), F.lit("Große Bank").alias("bank_account"), F.lit("usd").alias("currency"),
        F.lit("revenue").alias("transaction_type"), F.lpad((F.col("id") * 3).cast("string"), 5, "0").alias("account_number"),
        F.concat(F.lit("Account "), F.col("id") * 3).alias("account_name"), F.lit(None).cast("string").alias("counterparty_name"),
        F.lit("1").alias("confidence"), F.lit("x").alias("explanation"), F.lit(True).alias("active"), F.lit(False).alias("review_required"),
    )
    rows = tx(spark, *[(f"t{i:04d}", "2026-04-01", f"at STRASSE {i} END and strasse {i // 2} end", "5" if i % 4 else "-5", "GROSSE bank") for i in range(0, 4_000, 37)])
    found = {r["id"]: r["rule"] for r in rules.match_rules(rows, config.clean_rules(table), accounts).collect()}
    for i in range(0, 4_000, 37):
        fits = [n for n in (i, i // 2) if n % 2 or i % 4]
        rule = found[f"t{i:04d}"]
        assert (rule and rule["rule_id"]) == (f"r{max(fits)}" if fits else None)
        if rule:
            assert rule["problem"] == ("inactive_account" if max(fits) * 3 % 100 == 7 else None)


def test_folded_bank_names_resolve(spark):
    external = spark.createDataFrame([("X1", "0", "STRASSE Konto", "1000", "Bank", "Checking", True)], "id string, sync_token string, name string, account_number string, account_type string, account_sub_type string, active boolean")
    rows = tx(spark, ("a", "2026-04-01", "x", "5", "Straße  Konto"))
    posted = posting.with_external(posting.postings(rows, cl(spark, ("a", "revenue", "4000", "Repair Service Revenue", "approved"))), external)
    assert posted.first()["bank"]["account"]["id"] == "X1"


def test_broken_entries_refuse_the_report(spark):
    rows = tx(spark, ("a", "2026-04-05", "good", "50", MAIN), ("b", "2026-04-06", "bad", "100", MAIN))
    good = ("a", "revenue", "4000", "Repair Service Revenue", "approved")
    made = pnl.report_set(rows, cl(spark, good), config.default_chart(spark), *Q2, "USD")
    assert made.where("statement = 'consolidated'").first()["total_revenue"] == 50
    broken = pnl.report_set(rows, cl(spark, good, ("b", "revenue", "4999", "Nowhere", "approved")), config.default_chart(spark), *Q2, "USD")
    with pytest.raises(Exception, match="1 broken P&L rows, e.g. b unknown_account"):
        broken.collect()


def test_cascade_order_and_failures(spark):
    rows = tx(
        spark, ("a", "2026-04-01", "repair job", "5", MAIN), ("b", "2026-04-01", "known", "5", MAIN), ("c", "2026-04-01", "stale", "5", MAIN),
        ("d", "2026-04-01", "new", "5", MAIN), ("e", "2026-04-01", "new", "-5", MAIN), ("f", "2026-04-01", "other", "5", MAIN),
        ("g", "2026-04-01", "done", "5", MAIN), ("h", "2026-04-01", "repair job", "5", MAIN, "duplicate"),
    )
    stored = spark.createDataFrame(
        [("p1", "known", MAIN, "inflow", "USD", True, "s", "revenue", "Joe", "4000", "Repair Service Revenue", "1.000", "stored_correction", False),
         ("p2", "stale", MAIN, "inflow", "USD", True, "s", "revenue", None, "4000", "Old name", "1.000", "stored_correction", False),
         ("p3", "other", MAIN, "inflow", "USD", False, "s", "revenue", None, "4000", "Repair Service Revenue", "1.000", "stored_correction", False)],
        "id string, description_normalized string, bank_account string, direction string, currency string, active boolean, source_transaction_id string, "
        "transaction_type string, counterparty_name string, account_number string, account_name string, confidence string, source string, review_required boolean",
    )
    proposals = spark.createDataFrame(
        [("d", "revenue", "4010", "X", "0.95", "why"), ("e", "revenue", "4010", None, "0.95", "why"), ("g", "revenue", "4010", None, "0.5", "why")],
        "id string, transaction_type string, account_number string, counterparty_name string, confidence string, explanation string",
    )
    known = spark.createDataFrame([("g",)], "id string")
    out = cascade.classify(rows, stored, config.default_rules(spark), config.default_chart(spark), proposals, known)
    found = {r["id"]: r for r in out.collect()}
    assert {i: r["outcome"] for i, r in found.items()} == {
        "a": "deterministic_rule", "b": "learned_pattern", "c": "failed", "d": "gemini", "e": "failed", "f": "manual_review_required", "g": "already_classified",
    }
    assert found["b"]["counterparty_raw"] == "known" and found["b"]["counterparty_name"] == "Joe" and found["b"]["confidence"] == 1
    assert found["c"]["error"] == "account_name_mismatch" and found["e"]["error"] == "type_not_allowed_for_direction"
    assert found["d"]["review_required"] is False and found["f"]["manual_reason"] == "gemini_unavailable"
    [summary] = cascade.batch_summary(rows, out).collect()
    assert summary["balanced"] and summary["ignored_noncanonical"] == 1 and summary["failed"] == 2


PNL_TX = [("r", "2026-04-05", "repair", "1000", MAIN), ("f", "2026-04-30", "refund", "-100", MAIN), ("c", "2026-05-01", "wood", "-300", MAIN), ("o", "2026-06-30", "rent", "-200", MAIN),
          ("p", "2026-05-05", "pending", "900", MAIN), ("t", "2026-05-06", "transfer", "-50", MAIN), ("d", "2026-05-07", "dup", "70", MAIN, "duplicate"), ("x", "2026-07-01", "late", "10", MAIN)]
PNL_CL = [("r", "revenue", "4000", "Repair Service Revenue", "approved"), ("f", "refund", "4100", "Customer Refunds", "approved"), ("c", "cost_of_goods_sold", "5000", "Materials & Supplies", "approved"),
          ("o", "operating_expense", "6010", "Rent Expense", "approved"), ("p", "revenue", "4000", "Repair Service Revenue", "pending"), ("t", "transfer", "1010", TAX, "approved"),
          ("d", "revenue", "4000", "Repair Service Revenue", "approved"), ("x", "revenue", "4000", "Repair Service Revenue", "approved")]
Q2 = (date(2026, 4, 1), date(2026, 6, 30))


def test_profit_and_loss(spark):
    made = pnl.report_set(tx(spark, *PNL_TX), cl(spark, *PNL_CL), config.default_chart(spark), *Q2, "usd")
    nets = {(r["statement"], str(r["start_date"])): (r["net_profit"], r["transaction_count"]) for r in made.collect()}
    assert nets == {("monthly", "2026-04-01"): (900, 2), ("monthly", "2026-05-01"): (-300, 1), ("monthly", "2026-06-01"): (-200, 1), ("consolidated", "2026-04-01"): (400, 4)}
    assert checks.report_set_violations(made).isEmpty() and checks.month_gaps(made).isEmpty()
    broken = made.where("start_date <> '2026-05-01'")
    assert {r["violation"] for r in checks.report_set_violations(broken).collect()} >= {"month_missing", "net_profit_differs"}
    assert checks.month_gaps(broken).count() == 1


def test_empty_months_appear(spark):
    made = pnl.report_set(tx(spark, PNL_TX[0]), cl(spark, PNL_CL[0]), config.default_chart(spark), *Q2, "USD")
    assert sorted(r["transaction_count"] for r in made.collect()) == [0, 0, 1, 1]


def test_refused_evidence_and_periods(spark):
    rows = tx(spark, ("a", "2026-04-01", "x", "5", MAIN), ("b", "2026-04-01", "x", "5", MAIN), ("c", "2026-04-01", "x", "-5", MAIN), ("d", "2026-04-01", "x", "5", MAIN))
    decided = cl(spark, ("a", "revenue", "9999", "No", "approved"), ("b", "revenue", "4000", "Wrong", "approved"), ("c", "revenue", "4000", "Repair Service Revenue", "approved"), ("d", "revenue", "4100", "Customer Refunds", "approved"))
    entries = pnl.prepare_entries(pnl.approved_sources(rows, decided, *Q2, "USD"), config.default_chart(spark))
    problems = {r["id"]: r["problem"] for r in pnl.entry_problems(entries).collect()}
    assert problems == {"a": "unknown_account", "b": "account_name_mismatch", "c": "wrong_sign", "d": "revenue_on_refund_account"}
    with pytest.raises(Exception, match="broken"):
        pnl.refuse_broken(entries, entries).collect()
    for start, end, code in ((Q2[1], Q2[0], "USD"), (date(2026, 4, 2), Q2[1], "USD"), (Q2[0], date(2026, 6, 29), "USD"), (*Q2, "US")):
        with pytest.raises(ValueError):
            pnl.check_period(start, end, code)


def _inventory(spark, rows, decided, external=None):
    plans, issues = posting.inventory(tx(spark, *rows), cl(spark, *decided), external or derived.external_accounts(spark))
    return plans, {r["id"]: r["code"] for r in issues.collect()}


TRANSFERS = [("t1", "2026-04-03", "to", "-20", MAIN), ("t2", "2026-04-03", "from", "20", TAX)]
TRANSFER_CL = [("t1", "transfer", "1010", TAX, "pending"), ("t2", "transfer", "1000", MAIN, "pending")]


def test_inventory_and_summary(spark):
    rows = [("r", "2026-04-01", "repair", "300", MAIN), ("c", "2026-04-02", "wood", "-90", MAIN), ("o", "2026-04-02", "rent", "-40", MAIN), *TRANSFERS,
            ("m", "2026-04-04", "missing", "7", MAIN), ("d", "2026-04-04", "dup", "7", MAIN, "duplicate")]
    decided = [("r", "revenue", "4000", "repair  service REVENUE", "approved"), ("c", "cost_of_goods_sold", "5000", "Materials & Supplies", "approved"),
               ("o", "operating_expense", "6010", "Rent Expense", "pending"), *TRANSFER_CL]
    plans, codes = _inventory(spark, rows, decided)
    assert codes == {"m": "missing_classification"}
    assert checks.violations(plans, checks.plan_rules(), ["request_id"]).isEmpty()
    assert posting.coverage_violations(tx(spark, *rows), plans, spark.createDataFrame([("m",)], "id string")).isEmpty()
    [s] = posting.posting_summary(posting.account_movements(plans)).collect()
    assert (s["total_debits"], s["gross_profit"], s["net_income"], s["balanced"]) == (450, 210, 170, True)
    [t] = plans.where("kind = 'transfer'").collect()
    assert [(l["account_number"], l["posting_type"]) for l in t["lines"]] == [("1010", "Debit"), ("1000", "Credit")]
    assert [x["id"] for x in t["sources"]] == ["t1", "t2"]
    payload = json.loads(posting.journal_payloads(plans.where("kind = 'transfer'")).first()["payload"])
    assert payload["Line"][0]["Amount"] == 20 and payload["Line"][1]["JournalEntryLineDetail"]["AccountRef"]["value"] == "X1000"


def test_refused_postings(spark):
    rows = [(i, "2026-04-01", "x", a, b) for i, a, b in (
        ("rejected", "5", MAIN), ("needs", "5", MAIN), ("external", "5", MAIN), ("direction", "-5", MAIN), ("bank", "5", "Other Bank"),
        ("inactive", "-5", MAIN), ("name", "5", MAIN), ("self", "5", MAIN))]
    decided = [
        ("rejected", "revenue", "4000", "Repair Service Revenue", "rejected"), ("needs", "revenue", "4000", "Repair Service Revenue", "pending", "deterministic_rule", True),
        ("external", "revenue", "4000", "Repair Service Revenue", "pending", "gemini"), ("direction", "revenue", "4000", "Repair Service Revenue", "approved"),
        ("bank", "revenue", "4000", "Repair Service Revenue", "approved"), ("inactive", "operating_expense", "6040", "Marketing & Advertising", "approved"),
        ("name", "revenue", "4000", "Other", "approved"), ("self", "revenue", "1000", MAIN, "approved"),
    ]
    plans, codes = _inventory(spark, rows, decided)
    assert plans.isEmpty() and set(codes.values()) == {"posting_plan_blocked"} and len(codes) == 8


def test_transfer_groups(spark):
    assert _inventory(spark, TRANSFERS[:1], TRANSFER_CL[:1])[1] == {"t1": "ambiguous_transfer_pair"}
    third = ("t3", "2026-04-03", "to", "-20", MAIN)
    codes = _inventory(spark, [*TRANSFERS, third], [*TRANSFER_CL, ("t3", "transfer", "1010", TAX, "approved")])[1]
    assert codes == dict.fromkeys(("t1", "t2", "t3"), "ambiguous_transfer_pair")
    blocked = [TRANSFER_CL[0], ("t2", "transfer", "1000", MAIN, "rejected")]
    assert _inventory(spark, TRANSFERS, blocked)[1] == dict.fromkeys(("t1", "t2"), "transfer_plan_blocked")
    lost = [TRANSFER_CL[0], ("t2", "transfer", "4000", MAIN, "approved")]
    assert _inventory(spark, TRANSFERS, lost)[1] == {"t1": "ambiguous_transfer_pair", "t2": "invalid_transfer_reference"}


def _report(**changes):
    def total(group, value):
        return {"type": "Section", "group": group, "Summary": {"ColData": [{"value": "Total"}, {"value": value}]}}

    data = {"type": "Data", "ColData": [{"id": "X4000", "value": "Repair"}, {"value": "1,000.00"}]}
    income = total("Income", "1,000.00") | {"Rows": {"Row": [{"type": "Section", "Rows": {"Row": [data, {"type": "Data", "ColData": [{"value": "empty"}, {"value": ""}]}]}}]}}
    header = {"ReportName": "ProfitAndLoss", "ReportBasis": "Cash", "StartPeriod": "2026-04-01", "EndPeriod": "2026-04-30", "Currency": "usd"}
    rows = [income, total("COGS", "0.00"), total("GrossProfit", "1000.00"), total("Expenses", ""), total("NetIncome", "1000")]
    doc = {"Header": header | changes.pop("header", {}), "Rows": {"Row": rows + changes.pop("rows", [])}}
    return json.dumps(doc | changes)


def test_outside_reports(spark):
    again = {"type": "Data", "ColData": [{"id": "X4000"}, {"value": "5"}]}
    odd = [{"type": "Data", "ColData": [{"id": "nope"}, {"value": "5"}]}, {"type": "Data", "ColData": [{"value": "no id"}, {"value": "5"}]}]
    payloads = {
        "good": _report(), "json": "{", "basis": _report(header={"ReportBasis": "Accrual"}), "period": _report(header={"EndPeriod": "2026-05-31"}),
        "twice": _report(rows=[again]), "odd": _report(rows=odd), "totals": _report(rows=[{"type": "Section", "group": "COGS", "Summary": {"ColData": []}}]),
    }
    table = spark.createDataFrame([(k, v, date(2026, 4, 1), date(2026, 4, 30)) for k, v in payloads.items()], "report_id string, payload string, expected_start date, expected_end date")
    lines, totals, problems = reports.external_statements(table, derived.external_accounts(spark))
    found = {}
    for r in problems.collect():
        found.setdefault(r["report_id"], set()).add(r["problem"])
    assert {k: v for k, v in found.items() if k not in ("json", "basis", "period")} == {
        "twice": {"repeated_account: X4000"}, "odd": {"unknown_account: nope", "missing_account_id: ?"}, "totals": {"repeated_totals: COGS"},
    }
    assert "invalid_json" in found["json"] and "not_cash_basis" in found["basis"] and "other_period" in found["period"]
    [good] = totals.where("report_id = 'good'").collect()
    assert (good["total_revenue"], good["total_operating_expenses"], good["currency"], good["missing_groups"]) == (1000, 0, "USD", [])


def test_reconciliation(spark):
    keys = "start_date date, end_date date, account_number string, account_name string, amount decimal(28,2)"
    period = (date(2026, 4, 1), date(2026, 4, 30))
    inner = spark.createDataFrame([(*period, "4000", "Repair", Decimal("10")), (*period, "5000", "Wood", Decimal("3"))], keys)
    outer = spark.createDataFrame([(*period, "4000", "Repairs", Decimal("10")), (*period, "6000", "Pay", Decimal("1"))], keys)
    sums = "start_date date, end_date date, total_revenue decimal(28,2), total_cogs decimal(28,2), gross_profit decimal(28,2), total_operating_expenses decimal(28,2), net_profit decimal(28,2)"
    left = spark.createDataFrame([(*period, *map(Decimal, (10, 3, 7, 0, 7)))], sums)
    right = spark.createDataFrame([(*period, *map(Decimal, (10, 0, 10, 1, 9)))], sums)
    rows = {r["key"]: r for r in reconcile.reconcile(inner, left, outer, right).collect()}
    assert rows["4000"]["reconciled"] and rows["4000"]["label"] == "Repair / Repairs"
    assert (rows["5000"]["difference"], rows["6000"]["difference"], rows["6000"]["label"]) == (3, -1, "Pay")
    assert rows["total_revenue"]["reconciled"] and rows["net_profit"]["difference"] == -2 and len(rows) == 8
    [verdict] = reconcile.verdicts(reconcile.reconcile(inner, left, outer, right)).collect()
    assert verdict["reconciled"] is False and verdict["differences"] == 6


COMMANDS = "command_id string, id string, at timestamp, kind string, expected_version int, transaction_type string, account_number string, counterparty_name string, reason string"


def _model_fold(commands, status):
    """Sequential model of the version-guarded commands of valid corrections and reviews."""
    version, last, name, out = 1, None, None, {}
    for c in commands:
        if c[4] != version:
            out[c[0]] = "stale_version"
        elif c[3] != "correct":
            out[c[0]] = "accepted" if status == "pending" else "review_conflict"
            status = {"approve": "approved", "reject": "rejected"}[c[3]] if status == "pending" else status
        elif c[6] == "9999":
            out[c[0]] = "invalid_correction"
        else:
            party = c[7] or name
            content = (c[5], c[6], c[8], party)
            if content == last:
                out[c[0]] = "unchanged_decision"
            else:
                version, status, last, name, out[c[0]] = version + 1, "pending", content, party, "accepted"
    return version, status, out


def _random_commands(seed, count):
    pick = random.Random(seed)
    return [
        (f"c{i:03d}", "a", datetime(2026, 1, 1, 0, i // 60, i % 60), pick.choice(["correct", "correct", "approve", "reject"]), pick.randint(1, 4), "revenue",
         pick.choice(["4000", "4010", "9999"]), pick.choice([None, "P", "Q"]), pick.choice(["x", "y"]))
        for i in range(count)
    ]


@pytest.mark.parametrize("held", ["pending", "approved", "rejected"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_command_fold(spark, held, seed):
    commands = _random_commands(seed, 25)
    rows = tx(spark, ("a", "2026-04-01", "x", "5", MAIN))
    start = cl(spark, ("a", "revenue", "4000", "Repair Service Revenue", held))
    given = spark.createDataFrame(random.Random(seed).sample(commands, len(commands)), COMMANDS).withColumn("reviewer_id", F.concat(F.lit("r-"), "command_id"))
    verdicts, history, state = review.fold_commands(given, start, rows, config.default_chart(spark))
    version, status, expected = _model_fold(commands, held)
    assert {r["command_id"]: r["verdict"] for r in verdicts.collect()} == expected
    [current] = state.collect()
    assert (current["version"], current["review_status"]) == (version, status)
    kinds = {c[0]: c[3] for c in commands}
    last = max((c for c, v in expected.items() if v == "accepted"), default=None)
    assert current["reviewed_by"] == (f"r-{last}" if last and kinds[last] != "correct" else None)
    steps = sorted(history.collect(), key=lambda r: r["to_version"])
    assert len(steps) == version - 1 and review.history_violations(history, state).isEmpty()
    assert [r["corrected_by"] for r in steps] == [f"r-{c}" for c in sorted(expected) if expected[c] == "accepted" and kinds[c] == "correct"]
    assert [r["previous_account_number"] for r in steps] == ["4000", *[r["account_number"] for r in steps]][: len(steps)]


def _jobs(spark, action):
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    action()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


def test_a_key_of_many_events(spark):
    """100,000 commands, and as many sync events, of one key: an accepted step each, in a few jobs."""
    n = 100_000
    rows = tx(spark, ("a", "2026-04-01", "x", "5", MAIN))
    start = cl(spark, ("a", "revenue", "4000", "Repair Service Revenue", "pending"))
    commands = spark.range(n).selectExpr(
        "lpad(cast(id as string), 9, '0') as command_id", "'a' as id", "timestamp_seconds(id) as at", "'correct' as kind",
        "cast(id + 1 as int) as expected_version", "'revenue' as transaction_type",
        "if(id % 2 = 0, '4010', '4000') as account_number", "cast(null as string) as counterparty_name", "'x' as reason",
    )
    kept = {}

    def fold():
        verdicts, _, state = review.fold_commands(commands, start, rows, config.default_chart(spark))
        kept["accepted"], kept["version"] = verdicts.where("verdict = 'accepted'").count(), state.first()["version"]

    assert _jobs(spark, fold) <= 20 and kept == {"accepted": n, "version": n + 1}
    events = spark.range(n).selectExpr(
        "lpad(cast(id as string), 9, '0') as event_id", "'je' as request_id", "timestamp_seconds(id) as at",
        "if(id % 2 = 0, 'claim', 'retryable') as kind", "cast(id / 2 + 0.5 as int) as expected_attempt",
    )
    assert _jobs(spark, lambda: kept.update(moves=sync.fold_events(events).count())) <= 4 and kept["moves"] == n


def test_learning_and_saving_patterns(spark):
    rows = tx(spark, ("a", "2026-04-01", "Zed", "5", MAIN), ("b", "2026-04-02", "Zed", "9", MAIN), ("c", "2026-04-02", "Other", "9", MAIN))
    state = cl(spark, ("a", "revenue", "4010", "Installation Revenue", "approved", "manual_review"), ("b", "revenue", "4020", "Maintenance Plan Revenue", "approved", "manual_review"), ("c", "revenue", "4010", "Wrong", "approved", "manual_review")).withColumn("version", F.lit(2))
    learned = patterns.learn_patterns(rows, state, config.default_chart(spark))
    assert sorted(r["source_transaction_id"] for r in learned.collect()) == ["a", "b"]
    outcomes = {r["source_transaction_id"]: r["outcome"] for r in patterns.save_patterns(learned, learned.limit(0)).collect()}
    assert outcomes == {"a": "inserted", "b": "conflict"}
    kept = learned.where("source_transaction_id = 'a'")
    assert {r["outcome"] for r in patterns.save_patterns(kept, kept).collect()} == {"unchanged"}
    assert patterns.provenance_violations(kept, rows, state).isEmpty()
    assert patterns.provenance_violations(kept, rows, state.withColumn("version", F.lit(3))).first()["violation"] == "version_differs"
    found = patterns.match_patterns(rows, kept, config.default_chart(spark))
    assert {r["id"] for r in found.where("pattern is not null").collect()} == {"a", "b"}


def _model_sync(events):
    status, attempt, out = "pending", 0, {}
    for e in events:
        ok = status in ("pending", "retryable_error") if e[3] == "claim" else status == "in_progress" and e[4] == attempt
        out[e[0]] = "accepted" if ok else "illegal_transition"
        if ok:
            status = {"claim": "in_progress", "succeed": "succeeded", "retryable": "retryable_error", "permanent": "permanent_error"}[e[3]]
            attempt += e[3] == "claim"
    return status, attempt, out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sync_fold(spark, seed):
    pick = random.Random(seed)
    events = [(f"e{i:03d}", "je", datetime(2026, 1, 1, 0, 0, i), pick.choice(["claim", "retryable", "claim", "retryable", "succeed", "permanent"][: 5 + seed % 2]), pick.randint(1, 3)) for i in range(30)]
    table = spark.createDataFrame(pick.sample(events, len(events)), "event_id string, request_id string, at timestamp, kind string, expected_attempt int")
    moves = sync.fold_events(table)
    status, attempt, expected = _model_sync(events)
    assert {r["event_id"]: r["verdict"] for r in sync.event_verdicts(table, moves).collect()} == expected
    records = spark.createDataFrame([("je", datetime(2026, 1, 1)), ("idle", datetime(2026, 1, 1))], "request_id string, created_at timestamp")
    state = sync.current_state(records, moves)
    assert {r["request_id"]: (r["status"], r["attempt_count"]) for r in state.collect()} == {"je": (status, attempt), "idle": ("pending", 0)}
    assert checks.violations(state, checks.sync_rules(), ["request_id"]).isEmpty()
    assert {r["status"]: r["n"] for r in sync.status_counts(state).collect()}["pending"] == (2 if status == "pending" else 1)


def test_stale_recovery(spark):
    state = spark.createDataFrame(
        [("old", "in_progress", 2, datetime(2026, 1, 1, 11, 45)), ("young", "in_progress", 1, datetime(2026, 1, 1, 11, 46)), ("done", "succeeded", 1, datetime(2026, 1, 1))],
        "request_id string, status string, attempt_count int, updated_at timestamp",
    )
    found = {r["request_id"]: (r["blocks_run"], r["recovery_kind"]) for r in sync.stale_recovery(state, F.lit(datetime(2026, 1, 1, 12))).collect()}
    assert found == {"old": (False, "retryable"), "young": (True, None)}


def test_create_pending(spark):
    plans, _ = _inventory(spark, TRANSFERS, TRANSFER_CL)
    assert {r["outcome"] for r in sync.create_pending(plans, plans.limit(0)).collect()} == {"created"}
    assert {r["outcome"] for r in sync.create_pending(plans, plans).collect()} == {"existing"}
    assert {r["outcome"] for r in sync.create_pending(plans, plans.withColumn("currency", F.lit("EUR"))).collect()} == {"plan_conflict"}
    assert {r["outcome"] for r in sync.create_pending(plans, plans.withColumn("request_id", F.lit("z"))).collect()} == {"source_conflict"}


def test_save_initial_and_queue(spark):
    rows = tx(spark, *[(i, "2026-04-01", "x", "5", MAIN) for i in "abcd"], ("e", "2026-04-01", "x", "5", MAIN, "duplicate"))
    new = cl(spark, *[(i, "revenue", "4000", "Repair Service Revenue", "pending") for i in "abcde"])
    stored = new.where("id in ('b', 'c')").withColumn("account_number", F.when(F.col("id") == "c", F.lit("4010")).otherwise(F.col("account_number")))
    found = {r["id"]: r["outcome"] for r in review.save_initial(new, stored, rows).collect()}
    assert found == {"a": "inserted", "b": "unchanged", "c": "conflict", "d": "inserted", "e": "transaction_not_canonical"}
    queue = new.withColumns({"review_required": F.col("id").isin("c", "d"), "confidence": F.when(F.col("id") == "d", F.lit("0.5").cast("decimal(10,9)")).otherwise(F.col("confidence"))})
    top = review.review_queue(queue, rows, 3).collect()
    assert [(r["position"], r["id"]) for r in top] == [(1, "d"), (2, "c"), (3, "a")]
    for limit in (0, 201):
        with pytest.raises(ValueError):
            review.review_queue(queue, rows, limit)


def test_catalog_diff(spark):
    chart = config.default_chart(spark).where("number in ('4000', '4010', '5000', '6000', '6010', '6050')")
    external = spark.createDataFrame(
        [("1", "0", "repair service revenue", "4000", "Income", "ServiceFeeIncome", True), ("2", "0", "Installation Revenue", None, "Income", "Other", True),
         ("3", "0", "Payroll Expense", "6000", "Income", "x", True), ("4", "0", "Else", "6010", "Expense", "x", True), ("5", "0", "Insurance Expense", "7", "Expense", "Insurance", False), ("6", "0", "A", "6050", "Expense", "Insurance", True)],
        "id string, sync_token string, name string, account_number string, account_type string, account_sub_type string, active boolean",
    )
    diff = catalog.catalog_diff(chart, external)
    assert {r["number"]: (r["action"], r["problem"]) for r in diff.collect()} == {
        "4000": ("reuse", None), "4010": ("update", None), "5000": ("create", None), "6000": ("blocked", "incompatible_type"),
        "6010": ("blocked", "number_taken_by_other_name"), "6050": ("blocked", "number_and_name_belong_to_different_accounts"),
    }
    assert {r["number"] for r in catalog.account_payloads(diff, chart).collect()} == {"4010", "5000"}
    assert {r["number"]: r["detail_in_use"] for r in diff.collect()}["4010"] == "Other"


def test_outcome_classification(spark):
    rows = [("a", None, False, False, None, ""), ("b", 503, False, False, None, " x  y "), ("c", 400, False, False, "E1", ""), ("d", None, True, False, None, ""), ("e", 404, False, False, None, "z")]
    table = spark.createDataFrame(rows, "request_id string, http_status int, transport_error boolean, bad_response boolean, provider_code string, message string")
    found = {r["request_id"]: (r["kind"], r["error_code"], r["error_message"]) for r in sync.classify_outcomes(table).collect()}
    assert found == {"a": ("succeed", None, None), "b": ("retryable", "http_503", "x y"), "c": ("permanent", "E1", "The posting failed"), "d": ("retryable", "transport_error", "The posting failed"), "e": ("permanent", "http_404", "z")}


def test_ledger_search(spark):
    rows = ledger.ledger_rows(tx(spark, *PNL_TX), cl(spark, *PNL_CL))
    assert {r["id"] for r in ledger.search(rows, " RENT expense ").collect()} == {"o"}
    assert {r["id"] for r in ledger.search(rows, "", "duplicate").collect()} == set()
    assert {r["id"] for r in ledger.search(rows, "", "pending").collect()} == {"p"}
