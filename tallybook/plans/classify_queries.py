"""Registered queries: rules, patterns, cascade, review, corrections, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import accounts as acc
from tallybook.operators import cascade, ledger, patterns, review, rules
from tallybook.plans import derived, stages
from tallybook.plans.registry import query
from tallybook.plans.sql import rule_case, with_blocks
from tallybook.session import in_parts
from tallybook.sources import config

_RULED = with_blocks("resolved")


@query(
    "e_d7_f1_b7_c4_rule_match",
    _RULED + f"""SELECT id, {rule_case('rule_id')} AS rule_id, cast({rule_case('priority')} AS int) AS priority,
      {rule_case('type')} AS transaction_type, {rule_case('account')} AS account_number FROM canonical""",
)
def rule_match(spark, sf_dir):
    rows = rules.match_rules(
        stages.canonical(spark, sf_dir), config.default_rules(spark), config.default_chart(spark)
    )
    return rows.select("id", "rule.rule_id", "rule.priority", "rule.transaction_type", "rule.account_number")


@query(
    "e_d8_pattern_match",
    with_blocks("resolved", "patterns", "accounts") + """SELECT t.id, p.id AS pattern_id,
      CASE WHEN p.id IS NOT NULL AND a.number IS NULL THEN 'unknown_account' END AS problem, p.counterparty_name
      FROM canonical t LEFT JOIN patterns p ON p.active AND p.description_normalized = t.description_normalized
       AND p.bank_account = t.bank_account AND p.direction = t.direction AND p.currency = t.currency
      LEFT JOIN accounts a ON a.number = p.account_number""",
)
def pattern_match(spark, sf_dir):
    rows = patterns.match_patterns(
        stages.canonical(spark, sf_dir), derived.patterns(spark, sf_dir), config.default_chart(spark)
    )
    return rows.select("id", "pattern.pattern_id", "pattern.problem", "pattern.counterparty_name")


@query(
    "e_d9_account_resolution",
    with_blocks("classified", "accounts") + """SELECT c.id, CASE WHEN a.number IS NULL THEN 'unknown_account' WHEN NOT a.active THEN 'inactive_account'
      WHEN a.name <> c.account_name THEN 'account_name_mismatch' END AS problem, a.account_type FROM classified c LEFT JOIN accounts a ON a.number = c.account_number""",
)
def account_resolution(spark, sf_dir):
    rows = acc.with_account(derived.classified(spark, sf_dir), config.default_chart(spark))
    return rows.select(
        "id", acc.account_problem(F.col("account"), F.col("account_name")).alias("problem"), "account.account_type"
    )


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with patterns, rules and proposals, stored once and lean; some of the rows are decided already."""

    def build() -> list[DataFrame]:
        known = stages.canonical(spark, sf_dir).where("row_no % 16 = 4").select("id")
        outcomes = cascade.classify(
            stages.transactions(spark, sf_dir), derived.patterns(spark, sf_dir), config.default_rules(spark),
            config.default_chart(spark), derived.proposals(spark, sf_dir), known,
        )
        return [stages.lean(part) for part in in_parts(outcomes, "id")]

    return stages.whole(stages.once(spark, sf_dir, "cascade", build))


_CASCADE = with_blocks(
    "classified", "patterns", "proposals", "accounts",
    extra="""judged AS (SELECT p.*, CASE WHEN a.number IS NULL THEN 'unknown_account'
        WHEN p.transaction_type NOT IN ('revenue', 'transfer', 'owner_contribution') THEN 'type_not_allowed_for_direction'
        WHEN p.transaction_type = 'revenue' AND a.account_type <> 'Income' OR p.transaction_type = 'owner_contribution' AND a.account_type <> 'Equity'
          THEN 'account_type_not_allowed'
        WHEN p.transaction_type = 'revenue' AND p.account_number = '4100' THEN 'revenue_on_refund_account' END AS problem,
        a.name AS account_name FROM proposals p LEFT JOIN accounts a ON a.number = p.account_number),
      outcomes AS (SELECT t.id, t.upload_id, t.row_no, r.rule_id, p.id AS pattern_id, pr.problem AS proposal_problem,
        CASE WHEN t.row_no % 16 = 4 THEN 'already_classified' WHEN p.id IS NOT NULL AND pa.number IS NULL THEN 'failed'
             WHEN p.id IS NOT NULL THEN 'learned_pattern' WHEN r.rule_id IS NOT NULL THEN 'deterministic_rule'
             WHEN pr.problem IS NOT NULL THEN 'failed' WHEN pr.id IS NOT NULL THEN 'gemini' ELSE 'manual_review_required' END AS outcome,
        coalesce(p.account_number, r.account_number, pr.account_number) AS pick_account,
        cast(coalesce(cast(p.confidence AS decimal(10,9)), r.confidence, cast(pr.confidence AS decimal(10,9))) AS decimal(10,9)) AS pick_confidence,
        coalesce(p.counterparty_name, CASE WHEN p.id IS NULL AND r.rule_id IS NULL THEN pr.counterparty_name END) AS pick_party,
        CASE WHEN p.id IS NOT NULL THEN 'stored_correction' WHEN r.rule_id IS NOT NULL THEN 'deterministic_rule' ELSE 'gemini' END AS pick_source,
        CASE WHEN p.id IS NOT NULL OR r.rule_id IS NOT NULL THEN false
             ELSE cast(pr.confidence AS decimal(10,9)) < 0.9 OR pr.transaction_type = 'owner_contribution' END AS pick_review,
        CASE WHEN p.id IS NOT NULL AND pa.number IS NULL THEN 'unknown_account' ELSE pr.problem END AS error
        FROM canonical t LEFT JOIN ruled r ON r.id = t.id
        LEFT JOIN patterns p ON p.active AND p.description_normalized = t.description_normalized AND p.bank_account = t.bank_account
             AND p.direction = t.direction AND p.currency = t.currency
        LEFT JOIN accounts pa ON pa.number = p.account_number LEFT JOIN judged pr ON pr.id = t.id)""",
)
_DECIDED = "outcome IN ('learned_pattern', 'deterministic_rule', 'gemini')"


@query(
    "e_j1_j2_j3_j5_cascade",
    _CASCADE + f"""SELECT id, outcome, CASE WHEN outcome = 'deterministic_rule' THEN rule_id END AS rule_id,
      CASE WHEN outcome = 'learned_pattern' THEN pattern_id END AS pattern_id,
      CASE WHEN {_DECIDED} THEN pick_account END AS account_number, cast(CASE WHEN {_DECIDED} THEN pick_confidence END AS varchar) AS confidence,
      CASE WHEN {_DECIDED} THEN pick_party END AS counterparty_name, CASE WHEN {_DECIDED} THEN pick_source END AS source,
      CASE WHEN {_DECIDED} THEN pick_review END AS review_required, CASE WHEN outcome = 'failed' THEN error END AS error,
      CASE WHEN outcome = 'manual_review_required' THEN 'gemini_unavailable' END AS manual_reason FROM outcomes""",
)
def cascade_outcomes(spark, sf_dir):
    return _cascade(spark, sf_dir).select(
        "id", "outcome", "rule_id", "pattern_id", "account_number", "confidence", "counterparty_name", "source",
        "review_required", "error", "manual_reason",
    )


@query(
    "e_e3_batch_summary",
    _CASCADE + """, t AS (SELECT upload_id, count(*) AS total_records, count(*) FILTER (status = 'valid' AND duplicate_of IS NULL) AS canonical_transactions
        FROM transactions GROUP BY 1)
    SELECT t.upload_id, total_records, canonical_transactions, total_records - canonical_transactions AS ignored_noncanonical,
      count(*) FILTER (outcome = 'already_classified') AS already_classified, count(*) FILTER (outcome = 'learned_pattern') AS classified_by_learned_pattern,
      count(*) FILTER (outcome = 'deterministic_rule') AS classified_by_deterministic_rule, count(*) FILTER (outcome = 'gemini') AS classified_by_gemini,
      count(*) FILTER (outcome = 'manual_review_required') AS manual_review_required, count(*) FILTER (outcome = 'failed') AS failed, true AS balanced
      FROM t LEFT JOIN outcomes o ON o.upload_id = t.upload_id GROUP BY t.upload_id, total_records, canonical_transactions""",
)
def batch_summary(spark, sf_dir):
    return cascade.batch_summary(stages.transactions(spark, sf_dir), _cascade(spark, sf_dir))


@query(
    "e_d20_c8_c9_proposals",
    _CASCADE + """SELECT id, problem, CASE WHEN problem IS NULL THEN cast(confidence AS decimal(10,9)) < 0.9 OR transaction_type = 'owner_contribution' END AS review_required FROM judged""",
)
def proposals(spark, sf_dir):
    rows = cascade.judge_proposals(
        stages.canonical(spark, sf_dir), derived.proposals(spark, sf_dir), config.default_chart(spark)
    )
    return rows.where("proposal is not null").select(
        "id", "proposal.problem",
        F.when(F.col("proposal.problem").isNull(), F.col("proposal.review_required")).alias("review_required"),
    )


@query(
    "e_j4_proposal_requests",
    with_blocks("resolved") + """SELECT id, cast(amount AS varchar) AS amount, direction, 21 AS n_accounts, description_normalized FROM canonical""",
)
def proposal_requests(spark, sf_dir):
    requests = cascade.proposal_requests(stages.transactions(spark, sf_dir), config.default_chart(spark))
    shape = "amount string, direction string, description_normalized string, allowed_accounts array<struct<number:string>>"
    body = F.from_json("request", shape)
    return requests.select("id", body.alias("r")).select(
        "id", "r.amount", "r.direction", F.size("r.allowed_accounts").alias("n_accounts"), "r.description_normalized"
    )


@query(
    "e_d6_classified_split",
    with_blocks("classified") + """SELECT upload_id, count(*) FILTER (c.id IS NOT NULL) AS done, count(*) FILTER (c.id IS NULL) AS todo
      FROM canonical t LEFT JOIN (SELECT id FROM classified) c ON c.id = t.id GROUP BY 1""",
)
def classified_split(spark, sf_dir):
    rows = stages.canonical(spark, sf_dir).select("id", "upload_id")
    known = derived.classified(spark, sf_dir).select("id")
    done = rows.join(known, "id", "left_semi").withColumn("done", F.lit(1))
    todo = rows.join(known, "id", "left_anti").withColumn("done", F.lit(0))
    return done.union(todo).groupBy("upload_id").agg(
        F.sum("done").alias("done"), F.sum(1 - F.col("done")).alias("todo")
    )


@query("e_d5_missing_classification", with_blocks("classified") + "SELECT id FROM canonical WHERE id NOT IN (SELECT id FROM classified)")
def missing_classification(spark, sf_dir):
    return stages.canonical(spark, sf_dir).select("id").join(
        derived.classified(spark, sf_dir).select("id"), "id", "left_anti"
    )


@query(
    "e_g1_review_queue",
    _CASCADE + f"""SELECT row_number() OVER (ORDER BY pick_review DESC, pick_confidence, o.id) AS position, o.id, cast(pick_confidence AS varchar) AS confidence,
      pick_review AS review_required, cast(t.amount AS varchar) AS amount FROM outcomes o JOIN canonical t ON t.id = o.id WHERE {_DECIDED} ORDER BY pick_review DESC, pick_confidence, o.id LIMIT 100""",
)
def review_queue(spark, sf_dir):
    pending = cascade.initial_classifications(_cascade(spark, sf_dir))
    return review.review_queue(pending, stages.transactions(spark, sf_dir), 100).select(
        "position", "id", "confidence", "review_required", "amount"
    )


@query(
    "e_c7_pending_queues",
    _CASCADE + f"""SELECT pick_review AS review_required, count(*) AS n FROM outcomes WHERE {_DECIDED} GROUP BY 1""",
)
def pending_queues(spark, sf_dir):
    pending = cascade.initial_classifications(_cascade(spark, sf_dir)).where("review_status = 'pending'")
    return pending.groupBy("review_required").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e_j6_save_initial",
    with_blocks("classified") + """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN row_no % 3 = 0 THEN 'inserted' WHEN row_no % 3 = 1 THEN 'unchanged'
      ELSE 'conflict' END AS outcome FROM classified) GROUP BY 1""",
)
def save_initial(spark, sf_dir):
    new = derived.classified(spark, sf_dir)
    stored = new.where("row_no % 3 <> 0").withColumn(
        "account_number", F.when(F.col("row_no") % 3 == 2, F.lit("6090")).otherwise(F.col("account_number"))
    )
    judged = review.save_initial(new, stored, stages.transactions(spark, sf_dir))
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# --- commands folded into versioned state -------------------------------------------------------

_FOLD = with_blocks(
    "classified", "accounts",
    extra="""RECURSIVE_MARK cmd AS (SELECT lpad(cast(event_id AS varchar), 12, '0') AS command_id, concat('ORD-', user_id) AS target, ts AS at,
        CASE event_type WHEN 'view' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'correct' END AS kind, 1 + event_id % 5 AS expected_version,
        CASE WHEN event_id % 7 = 0 THEN 'operating_expense' ELSE 'revenue' END AS transaction_type,
        CASE WHEN event_id % 11 = 0 THEN '9999' WHEN event_id % 2 = 0 THEN '4000' ELSE '4010' END AS account_number,
        CASE WHEN event_id % 3 = 0 THEN concat('Party ', event_id % 4) END AS party, event_type AS reason,
        concat('reviewer-', event_id % 9) AS reviewer_id FROM events),
      cmds AS (SELECT c.*, t.id, k.id IS NOT NULL AS known, k.review_status AS held_status, row_number() OVER (ORDER BY c.at, c.command_id) AS pos,
        CASE WHEN c.kind = 'correct' AND c.transaction_type = 'operating_expense' THEN 'type_not_allowed_for_direction'
             WHEN c.kind = 'correct' AND c.account_number = '9999' THEN 'unknown_account' END AS problem
        FROM cmd c LEFT JOIN (SELECT id, source_transaction_id FROM canonical WHERE upload_seq = 1) t ON t.source_transaction_id = c.target
        LEFT JOIN (SELECT id, review_status FROM classified) k ON k.id = t.id),
      chain AS (
        SELECT id, 1 AS version, cast(0 AS bigint) AS pos, '' AS content, NULL::varchar AS party, NULL::varchar AS account_number FROM classified
        UNION ALL
        SELECT c.id, ch.version + 1, n.pos, n.content, n.party, n.account_number FROM chain ch JOIN (SELECT DISTINCT id FROM cmds) c ON c.id = ch.id,
          LATERAL (SELECT x.pos, concat(x.transaction_type, '|', x.account_number, '|', x.reason, '|', coalesce(x.party, ch.party, '')) AS content,
                     coalesce(x.party, ch.party) AS party, x.account_number
                   FROM cmds x WHERE x.id = ch.id AND x.kind = 'correct' AND x.problem IS NULL AND x.expected_version = ch.version AND x.pos > ch.pos
                     AND concat(x.transaction_type, '|', x.account_number, '|', x.reason, '|', coalesce(x.party, ch.party, '')) <> ch.content
                   ORDER BY x.pos LIMIT 1) n),
      spans AS (SELECT *, lead(pos) OVER (PARTITION BY id ORDER BY version) AS until FROM chain),
      placed AS (SELECT c.*, s.version, s.until, s.version IS NOT NULL AND c.pos > s.pos AND (s.until IS NULL OR c.pos <= s.until) AS is_current
        FROM cmds c LEFT JOIN spans s ON s.id = c.id AND s.version = c.expected_version),
      reviewed AS (SELECT *, min(pos) FILTER (kind <> 'correct' AND is_current) OVER (PARTITION BY id, version) AS first_review FROM placed),
      verdicts AS (SELECT *, CASE WHEN NOT known THEN 'not_found' WHEN NOT is_current THEN 'stale_version'
        WHEN kind <> 'correct' AND version = 1 AND held_status <> 'pending' THEN 'review_conflict' WHEN kind <> 'correct' AND pos = first_review THEN 'accepted'
        WHEN kind <> 'correct' THEN 'review_conflict' WHEN problem IS NOT NULL THEN 'invalid_correction' WHEN pos = until THEN 'accepted'
        ELSE 'unchanged_decision' END AS verdict FROM reviewed)""",
).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK ", "")


def _folded(spark, sf_dir):
    """Verdicts, history and state, judged once per input."""
    held = derived.classified(spark, sf_dir)
    return tuple(
        stages.once(spark, sf_dir, name, lambda table=table: table)
        for name, table in zip(
            ("verdicts", "history", "review_state"),
            review.fold_commands(
                derived.commands(spark, sf_dir), held, stages.transactions(spark, sf_dir), config.default_chart(spark)
            ),
        )
    )


@query("e_j7_j8_command_verdicts", _FOLD + "SELECT command_id, verdict FROM verdicts")
def command_verdicts(spark, sf_dir):
    return _folded(spark, sf_dir)[0].select("command_id", "verdict")


_FOLD_HOT = _FOLD.replace(
    "LEFT JOIN (SELECT id, source_transaction_id FROM canonical WHERE upload_seq = 1) t ON t.source_transaction_id = c.target",
    "LEFT JOIN (SELECT min(id) AS id FROM classified WHERE review_status = 'pending' AND direction = 'inflow') t ON true",
)


@query("e_j8_hot_key_verdicts", _FOLD_HOT + "SELECT command_id, verdict FROM verdicts")
def hot_key_verdicts(spark, sf_dir):
    """All commands as those of one transaction: a key that holds every row."""
    held = derived.classified(spark, sf_dir)
    inflows = stages.canonical(spark, sf_dir).where("direction = 'inflow'").select("id")
    one = held.where("review_status = 'pending'").join(inflows, "id").agg(F.min("id")).first()[0]
    commands = derived.commands(spark, sf_dir).withColumn("id", F.lit(one))
    verdicts, _, _ = review.fold_commands(
        commands, held, stages.transactions(spark, sf_dir), config.default_chart(spark)
    )
    return verdicts.select("command_id", "verdict")


_LAST = """, last AS (SELECT id, max(version) AS version, arg_max(account_number, version) AS account_number, arg_max(party, version) AS party FROM chain GROUP BY 1),
      rev AS (SELECT id, version, kind, reviewer_id, "at" FROM verdicts WHERE kind <> 'correct' AND verdict = 'accepted'),
      final AS (SELECT l.*, c.review_status AS held_status, coalesce(l.account_number, c.account_number) AS account, r.kind, r.reviewer_id, r."at",
        CASE WHEN r.kind = 'approve' THEN 'approved' WHEN r.kind = 'reject' THEN 'rejected' WHEN l.version > 1 THEN 'pending' ELSE c.review_status END AS review_status
        FROM last l JOIN classified c ON c.id = l.id LEFT JOIN rev r ON r.id = l.id AND r.version = l.version)"""


@query(
    "e_f7_j8_review_state",
    _FOLD + _LAST + " SELECT id, version, account AS account_number, party AS counterparty_name, review_status, reviewer_id AS reviewed_by FROM final",
)
def review_state(spark, sf_dir):
    return _folded(spark, sf_dir)[2].select(
        "id", "version", "account_number", "counterparty_name", "review_status", "reviewed_by"
    )


@query(
    "e_j8_correction_history",
    _FOLD + """ SELECT c.id, c.version - 1 AS from_version, c.version AS to_version, m.command_id, m.reviewer_id AS corrected_by,
      c.account_number, coalesce(p.account_number, k.account_number) AS previous_account_number, p.party AS previous_counterparty_name
      FROM chain c JOIN cmds m ON m.id = c.id AND m.pos = c.pos JOIN chain p ON p.id = c.id AND p.version = c.version - 1 JOIN classified k ON k.id = c.id""",
)
def correction_history(spark, sf_dir):
    return _folded(spark, sf_dir)[1].select(
        "id", "from_version", "to_version", "command_id", "corrected_by", "account_number", "previous_account_number",
        "previous_counterparty_name",
    )


@query(
    "e_e14_counts_per_account",
    with_blocks("classified") + "SELECT account_number, account_name, count(*) AS n FROM classified GROUP BY 1, 2",
)
def counts_per_account(spark, sf_dir):
    return ledger.counts_per_account(derived.classified(spark, sf_dir))
