"""Registered queries: files, scalars, normalization, duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import dates, hashing, money, text
from tallybook.functions.cells import Cell, row_cells, tagged_cells
from tallybook.config.settings import ColumnMapping, IngestionConfig
from tallybook.operators import checks, duplicates, ledger, match_index
from tallybook.operators.normalize import normalize_fields, normalize_records
from tallybook.plans import fixtures, stages, views
from tallybook.plans.registry import query
from tallybook.plans.sql import with_blocks
from tallybook.session import PARTS, shared_dir
from tallybook.sources import commits, files, paging, scan, tables
from tallybook.streaming import landing

# --- E-A: files -------------------------------------------------------------------------------

_FILE_NAME = """concat(CASE WHEN doc_id % 5 = 0 THEN 'C:\\up\\' WHEN doc_id % 5 = 1 THEN '/var/in/' ELSE '' END,
    source, '-', cast(doc_id AS string),
    CASE WHEN doc_id % 7 = 3 THEN '.xlsx' WHEN doc_id % 7 = 5 THEN '.xls' WHEN doc_id % 7 = 6 THEN '.CSV ' ELSE '.csv' END)"""
_SAFE = """concat(source, '-', cast(doc_id AS string), CASE WHEN doc_id % 7 = 3 THEN '.xlsx' WHEN doc_id % 7 = 5 THEN '.xls'
    WHEN doc_id % 7 = 6 THEN '.CSV' ELSE '.csv' END)"""


def _scanned_exports(spark: SparkSession, sf_dir: str, header_row: int | None = None) -> DataFrame:
    """Order exports, scanned once into a stored table that every later step reads."""
    accepted = files.accepted_files(files.identify(fixtures.order_exports(spark, sf_dir)))
    return stages.once(spark, sf_dir, f"exports-{header_row}", lambda: scan.scan(accepted, header_row))


def _documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an uploaded file under a name as browsers send them."""
    docs = views.table(spark, sf_dir, "documents")
    escaped = _FILE_NAME.replace("\\", "\\\\")
    return docs.select(
        F.expr(escaped).alias("file_name"), F.encode("text", "UTF-8").alias("content")
    )


@query(
    "e_a1_a3_file_identity",
    f"""SELECT {_SAFE} AS safe_name, octet_length(encode(text)) AS size_bytes, sha256(text) AS file_sha256 FROM documents""",
)
def file_identity(spark, sf_dir):
    return files.identify(_documents_as_files(spark, sf_dir)).select(
        "safe_name", F.col("size_bytes").cast("long").alias("size_bytes"), "file_sha256"
    )


@query(
    "e_a2_file_gate",
    """SELECT coalesce(CASE WHEN octet_length(encode(text)) = 0 THEN 'empty_file' WHEN octet_length(encode(text)) > 10485760 THEN 'file_too_large'
         WHEN doc_id % 7 = 5 THEN 'unsupported_extension' WHEN doc_id % 7 = 3 THEN 'signature_mismatch' END, 'accepted') AS code,
       count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1""",
)
def file_gate(spark, sf_dir):
    identified = files.identify(_documents_as_files(spark, sf_dir))
    return identified.groupBy(F.coalesce("code", F.lit("accepted")).alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").cast("long").alias("bytes")
    )


@query(
    "e_a14_whole_file_dedupe",
    f"""SELECT sha256(text) AS file_sha256, min({_FILE_NAME}) AS kept, count(*) - 1 AS refused FROM documents GROUP BY 1""",
)
def whole_file_dedupe(spark, sf_dir):
    identified = files.identify(_documents_as_files(spark, sf_dir)).select("file_name", "file_sha256")
    kept, refused = files.split_known_files(identified)
    counts = refused.groupBy("file_sha256").agg(F.count(F.lit(1)).alias("refused"))
    return kept.join(counts, "file_sha256", "left").select(
        "file_sha256", F.col("file_name").alias("kept"), F.coalesce("refused", F.lit(0)).alias("refused")
    )


@query("e_a4_a5_a8_e18_document_profile")
def document_profile(spark, sf_dir):
    """Decode, sniff and shape of every document read as CSV; refusals keep their code."""
    accepted = files.accepted_files(files.identify(_documents_as_files(spark, sf_dir)))
    facts = scan.file_facts(scan.scan(accepted))
    return facts.select(
        "file_name", "file_sha256", "sheet", "rows", "columns", "encoding", "delimiter",
        F.array_join("warnings", ",").alias("warnings"), "code",
    )


@query(
    "e_a6_csv_records",
    fixtures.EXPORT_RECORDS_SQL,
)
def csv_records(spark, sf_dir):
    scanned = _scanned_exports(spark, sf_dir)
    return scan.records(scanned).select(
        "file_name", "row_no", F.size("cells").alias("n_cells"),
        F.array_join(F.transform("cells", lambda c: c["value"]), "~").alias("cells"),
    )


@query("e_a8_f4_preview_profile", fixtures.EXPORT_PROFILE_SQL)
def export_profile(spark, sf_dir):
    scanned = _scanned_exports(spark, sf_dir)
    shown = scan.preview(scanned, 2).groupBy("file_name").agg(F.count(F.lit(1)).alias("previewed"))
    return scan.profile(scanned).join(shown, "file_name").select(
        "file_name", F.col("rows").cast("long").alias("rows"), F.col("columns").cast("long").alias("columns"),
        "encoding", "delimiter", "previewed",
    )


@query("e_a9_header_check", fixtures.EXPORT_PROBLEMS_SQL)
def header_check(spark, sf_dir):
    scanned = _scanned_exports(spark, sf_dir, header_row=1)
    return scan.file_problems(scanned, fixtures.EXPORT_CONFIG).select("file_name", "code")


@query("e_b1_b30_export_transactions", fixtures.EXPORT_TRANSACTIONS_SQL)
def export_transactions(spark, sf_dir):
    """Files to normalized rows: scan, headers, padding, extra cells, issues."""
    scanned = _scanned_exports(spark, sf_dir, header_row=1)
    rows = normalize_records(scan.data_records(scanned, fixtures.EXPORT_CONFIG), fixtures.EXPORT_CONFIG)
    return rows.select(
        "source_file_name", F.col("source_row_number").cast("long").alias("row_no"), "source_transaction_id",
        "transaction_date", "description_normalized", "amount", "currency", "bank_account", "status",
        F.array_join(F.transform("validation_issues", lambda i: i["code"]), ",").alias("codes"),
    )


@query("e_a7_xlsx_records", fixtures.WORKBOOK_RECORDS_SQL)
def xlsx_records(spark, sf_dir):
    scanned = scan.scan(files.accepted_files(files.identify(fixtures.order_workbooks(spark, sf_dir))))
    return scan.records(scanned).select(
        "file_name", "sheet", "row_no",
        F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["kind"], c["value"])), "~").alias("cells"),
    )


@query("e_a7_e18_workbook_problems", fixtures.WORKBOOK_FACTS_SQL)
def workbook_problems(spark, sf_dir):
    """Broken workbooks are refused with a code; sound ones show formulas and outside links."""
    scanned = scan.scan(files.accepted_files(files.identify(fixtures.faulty_workbooks(spark, sf_dir))))
    return scan.file_facts(scanned).select(
        "file_name", "sheet", "code", "formulas", F.array_join("warnings", ",").alias("warnings")
    )


_CELLS = ("source_id", "date_text", "description_text", "amount_text", "currency_text", "bank_text")


@query(
    "e_a13_b28_raw_evidence",
    with_blocks("raw") + """SELECT upload_seq, row_no, source_id, amount_text, 6 AS n_cells,
        sha256('{"amount_text":"' || amount_text || '","bank_text":"' || bank_text || '","currency_text":"' || currency_text
        || '","date_text":"' || date_text || '","description_text":"' || description_text || '","source_id":"' || source_id || '"}') AS raw_hash
        FROM raw""",
)
def raw_evidence(spark, sf_dir):
    raw = views.raw_bank(spark, sf_dir)
    cells = row_cells(
        F.array(*[F.lit(c) for c in _CELLS]),
        F.array(*[F.struct(F.lit("str").alias("kind"), F.col(c).alias("value")) for c in _CELLS]),
    )
    return raw.withColumn("cells", cells).select(
        "upload_seq", "row_no", "source_id", "amount_text",
        F.size(tagged_cells(F.col("cells"))).alias("n_cells"), hashing.raw_hash(F.col("cells")).alias("raw_hash"),
    )


@query(
    "e_a12_keyed_append",
    with_blocks("norm") + """SELECT CASE WHEN row_no % 2 = 1 THEN 'inserted' WHEN row_no % 6 = 0 THEN 'conflict' ELSE 'existing' END AS outcome,
        count(*) AS n FROM norm GROUP BY 1""",
)
def keyed_append(spark, sf_dir):
    new = stages.normalized_table(spark, sf_dir).select("id", "row_no", "amount", "description_normalized")
    stored = new.where("row_no % 2 = 0").withColumn(
        "amount", F.when(F.col("row_no") % 6 == 0, F.col("amount") + 1).otherwise(F.col("amount"))
    ).withColumn("amount", F.coalesce("amount", F.when(F.col("row_no") % 6 == 0, F.lit(1))).cast(money.MONEY))
    # The stored rows are appended first, then all rows against them.
    target = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    for rows in (stored, new):
        commit = commits.Commit(spark, target)
        judged = tables.append_new(rows, commit, "rows", "id", buckets=16, parts=PARTS)
        commit.publish()
    return tables.append_counts(judged).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in tables.OUTCOMES])).alias("r")
    ).select("r.*")


@query(
    "e_a15_keyed_reads",
    with_blocks("resolved") + """SELECT id, row_no, status FROM transactions WHERE upload_seq = 3""",
)
def keyed_reads(spark, sf_dir):
    rows = stages.transactions(spark, sf_dir)
    wanted = tables.upload_rows(rows, "upload-3").select("id")
    return tables.by_ids(rows, wanted).select("id", "row_no", "status")


@query(
    "e_a16_a17_snapshot",
    with_blocks("resolved") + """SELECT id, transaction_date::varchar AS transaction_date, source_transaction_id,
        cast(amount AS varchar) AS amount, currency, status FROM transactions""",
)
def snapshot(spark, sf_dir):
    return tables.snapshot(stages.transactions(spark, sf_dir)).select(
        "id", "transaction_date", "source_transaction_id", "amount", "currency", "status"
    )


@query(
    "e_a16_snapshot_page",
    with_blocks("resolved") + """, placed AS (SELECT row_number() OVER (ORDER BY transaction_date NULLS LAST, coalesce(source_transaction_id, ''), id) - 1 AS position,
        count(*) OVER () AS total, id, source_transaction_id FROM transactions)
      SELECT position, total, id, source_transaction_id FROM placed WHERE position BETWEEN total // 2 AND total // 2 + 199""",
)
def snapshot_page(spark, sf_dir):
    """The page in the middle of the snapshot, out of all rows put in order."""
    rows = stages.transactions(spark, sf_dir).select("id", "source_transaction_id", "transaction_date")
    ordered = paging.put_in_order(rows, tables.snapshot_order())
    found = paging.page(ordered, ordered.total // 2, 200)
    return found.select("position", F.lit(ordered.total).cast("long").alias("total"), "id", "source_transaction_id")


# --- E-B: scalars -----------------------------------------------------------------------------

_DUCK_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    "e_b2_b3_b4_whitespace",
    f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^{_DUCK_WS}+|{_DUCK_WS}+$', '', 'g'), '{_DUCK_WS}+', ' ', 'g')) AS collapsed,
        sha256(regexp_replace(text, '^{_DUCK_WS}+|{_DUCK_WS}+$', '', 'g')) AS stripped,
        regexp_full_match(text, '{_DUCK_WS}*') AS blank FROM documents""",
)
def whitespace(spark, sf_dir):
    t = F.col("text")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.collapse(t), 256).alias("collapsed"), F.sha2(text.strip(t), 256).alias("stripped"),
        text.is_blank(t).alias("blank"),
    )


@query("e_b5_b6_description")
def descriptions(spark, sf_dir):
    """NFKC, collapsed and case-folded text of whole documents (checked in pytest)."""
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.normalize_description(F.col("text")), 256).alias("normalized"),
        F.sha2(text.fold_name(F.col("text")), 256).alias("name_key"),
    )


@query(
    "e_b10_b11_b12_b13_labels",
    with_blocks("norm") + """SELECT id, coalesce(nullif(source_transaction_id, ''), id) AS label,
        substr(description_normalized, 1, 500) AS message,
        CASE WHEN transaction_date IS NULL THEN '' ELSE concat(cast(date_trunc('month', transaction_date) AS date), ' through ', last_day(transaction_date)) END AS period FROM norm""",
)
def labels(spark, sf_dir):
    rows = stages.normalized_table(spark, sf_dir)
    day = F.col("transaction_date")
    return rows.select(
        "id", text.first_text(F.col("source_transaction_id"), F.col("id")).alias("label"),
        text.safe_message(F.col("description_normalized")).alias("message"),
        text.period_label(F.trunc(day, "MM").cast("date"), F.last_day(day)).alias("period"),
    )


_MONEY_VARIANT = """CASE l_orderkey % 14
    WHEN 0 THEN concat('($', x, ')') WHEN 1 THEN concat('$-', x) WHEN 2 THEN concat('-$', x)
    WHEN 3 THEN concat('USD ', x) WHEN 4 THEN concat('usd $', x) WHEN 5 THEN concat('  +', x, ' ')
    WHEN 6 THEN concat(x, '5') WHEN 7 THEN concat('1,', lpad(cast(l_orderkey % 1000 AS string), 3, '0'), '.5')
    WHEN 8 THEN concat('.', cast(l_linenumber AS string)) WHEN 9 THEN concat(cast(l_linenumber AS string), '.')
    WHEN 10 THEN concat('1,', cast(l_linenumber AS string)) WHEN 11 THEN 'n/a' WHEN 12 THEN concat('(-', x, ')') ELSE x END"""


@query(
    "e_b14_b15_parse_money",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, x, {_MONEY_VARIANT} AS t FROM
        (SELECT *, cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS x FROM lineitem))
    SELECT l_orderkey, l_linenumber, l_partkey, cast(CASE l_orderkey % 14
        WHEN 0 THEN -cast(x AS decimal(18,2)) WHEN 1 THEN -cast(x AS decimal(18,2)) WHEN 3 THEN cast(x AS decimal(18,2))
        WHEN 4 THEN cast(x AS decimal(18,2)) WHEN 5 THEN cast(x AS decimal(18,2))
        WHEN 7 THEN cast(1000 + l_orderkey % 1000 + 0.5 AS decimal(18,2)) WHEN 8 THEN cast(l_linenumber / 10.0 AS decimal(18,2))
        WHEN 12 THEN -cast(x AS decimal(18,2)) WHEN 13 THEN cast(x AS decimal(18,2)) END AS varchar) AS amount FROM v""",
)
def parse_money(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").withColumn(
        "x", F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    )
    return lines.withColumn("t", F.expr(_MONEY_VARIANT)).select(
        "l_orderkey", "l_linenumber", "l_partkey", money.parse_money_text(F.col("t")).alias("amount")
    )


@query(
    "e_b16_split_amount",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, cast(l_extendedprice AS decimal(18,2)) AS x, l_orderkey % 6 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, cast(CASE k WHEN 0 THEN -x WHEN 1 THEN x WHEN 4 THEN 0.00::decimal(18,2) WHEN 5 THEN -x END AS varchar) AS amount,
      CASE k WHEN 2 THEN 'ambiguous_split_amount' WHEN 3 THEN 'missing_amount' WHEN 4 THEN 'zero_amount' ELSE '' END AS codes,
      CASE WHEN k IN (0, 5) THEN 'outflow' WHEN k = 1 THEN 'inflow' END AS direction FROM v""",
)
def split_amount(spark, sf_dir):
    x = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    k = F.col("l_orderkey") % 6
    lines = views.table(spark, sf_dir, "lineitem").withColumns(
        {
            "debit": F.when(k.isin(0, 2), x).when(k == 5, F.concat(F.lit("("), x, F.lit(")"))),
            "credit": F.when(k.isin(1, 2), x).when(k == 4, F.lit("0.00")).otherwise(F.lit(" ")),
            "day": F.col("l_shipdate").cast("date").cast("string"),
        }
    )
    config = IngestionConfig(
        ColumnMapping("day", "l_returnflag", debit_amount="debit", credit_amount="credit"),
        default_currency="USD", default_bank_account="Operating Checking",
    )
    fields = {n: Cell.of_text(F.col(h)) for n, h in vars(config.mapping).items() if h}
    rows = normalize_fields(lines, fields, config)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "amount",
        F.array_join(F.transform("validation_issues", lambda i: i["code"]), ",").alias("codes"), "direction",
    )


_DATE_TEXTS = {
    "%Y-%m-%d": ("yyyy-M-d", "%Y-%-m-%-d"),
    "%m/%d/%Y": ("MM/dd/yyyy", "%m/%d/%Y"),
    "%m/%d/%y": ("M/d/yy", "%-m/%-d/%y"),
    "%d/%m/%Y": ("d/M/yyyy", "%-d/%-m/%Y"),
    "%Y/%m/%d": ("yyyy/MM/dd", "%Y/%m/%d"),
    "%m-%d-%Y": ("M-d-yyyy", "%-m-%-d-%Y"),
}


@query(
    "e_b22_parse_date",
    """SELECT o_orderkey, """ + ", ".join(
        f"CASE WHEN o_orderkey % 7 <> {i} THEN cast(o_orderdate AS date)::varchar END AS d{i}" for i in range(6)
    ) + " FROM orders",
)
def parse_date(spark, sf_dir):
    """Each of the six formats; one order in seven carries a text that fits no format."""
    orders = views.table(spark, sf_dir, "orders")
    parsed = []
    for i, (fmt, (spark_format, _)) in enumerate(_DATE_TEXTS.items()):
        shown = F.when(F.col("o_orderkey") % 7 == i, F.lit("31.12.1999")).otherwise(
            F.date_format("o_orderdate", spark_format)
        )
        parsed.append(dates.parse_date_text(F.concat(F.lit(" "), shown), fmt).alias(f"d{i}"))
    return orders.select("o_orderkey", *parsed)


@query(
    "e_b23_posted_before",
    """SELECT count(*) AS warned FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
       WHERE cast(l_shipdate AS date) < cast(o_orderdate AS date)""",
)
def posted_before(spark, sf_dir):
    lines, orders = views.table(spark, sf_dir, "lineitem"), views.table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.col("l_shipdate").cast("date").cast("string").alias("posted"),
        F.col("l_returnflag").alias("about"), F.lit("1.00").alias("amount"),
    )
    config = IngestionConfig(
        ColumnMapping("day", "about", amount="amount", posted_date="posted"),
        default_currency="USD", default_bank_account="Operating Checking",
    )
    fields = {n: Cell.of_text(F.col(h)) for n, h in vars(config.mapping).items() if h}
    # Counted in the rows: an explode would have the planner repeat every issue's expression in a filter below it.
    warned = F.filter(
        "validation_issues", lambda i: (i["code"] == "posted_before_transaction") & (i["severity"] == "warning")
    )
    return normalize_fields(rows, fields, config).agg(
        F.coalesce(F.sum(F.size(warned)), F.lit(0)).cast("long").alias("warned")
    )


@query(
    "e_b24_b25_b26_calendar",
    """WITH d AS (SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders)
    SELECT o_orderkey, day(day) = 1 AS is_start, last_day(day) = day AS is_end,
      cast(date_trunc('month', day) + INTERVAL 1 MONTH AS date)::varchar AS next_start,
      cast(date_diff('month', day, DATE '2001-12-31') + 1 AS bigint) AS months_left FROM d""",
)
def calendar(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    day = F.col("day")
    return orders.select(
        "o_orderkey", dates.is_month_start(day).alias("is_start"), dates.is_month_end(day).alias("is_end"),
        dates.next_month_start(day).alias("next_start"),
        F.size(dates.month_starts(day, F.lit("2001-12-31").cast("date"))).cast("long").alias("months_left"),
    )


@query(
    "e_b27_b8_b9_b17_normalized",
    with_blocks("norm") + """SELECT id, transaction_date::varchar AS transaction_date, description_normalized,
      cast(amount AS varchar) AS amount, currency, bank_account, direction, fingerprint, codes,
      CASE WHEN codes = '' THEN 'valid' ELSE 'invalid' END AS status FROM norm""",
)
def normalized(spark, sf_dir):
    return stages.normalized(spark, sf_dir).select(
        "id", "transaction_date", "description_normalized", "amount", "currency", "bank_account", "direction",
        "fingerprint", F.array_join(F.transform("validation_issues", lambda i: i["code"]), ",").alias("codes"), "status",
    )


@query(
    "e_b31_phrase_lists",
    """SELECT p_partkey, array_to_string(list_filter([lower(p_name), lower(p_type)], lambda x: x <> ''), '|') AS phrases FROM part""",
)
def phrase_lists(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    name, kind = F.col("p_name"), F.col("p_type")
    listed = F.array(
        name, F.upper(name), F.concat(F.lit("  "), name, F.lit(" ")), F.lit(" "), kind, F.initcap(kind)
    )
    return part.select("p_partkey", F.array_join(text.clean_phrases(listed), "|").alias("phrases"))


# --- E-C, E-D, E-E, E-F: duplicates -------------------------------------------------------------

_COUNTS = """SELECT upload_id, count(*) AS physical, count(*) FILTER (status = 'valid') AS valid,
    count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'duplicate') AS duplicate,
    CASE WHEN count(*) FILTER (status = 'invalid') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS upload_status
    FROM transactions GROUP BY upload_id"""


@query(
    "e_f2_d1_d2_duplicate_resolution",
    with_blocks("resolved") + """SELECT id, status, duplicate_of, match_kind, canonical_upload, all_codes AS codes FROM transactions""",
)
def duplicate_resolution(spark, sf_dir):
    rows = duplicates.resolve_duplicates(stages.normalized_table(spark, sf_dir), stages.ARRIVAL)
    return rows.select(
        "id", "status", "duplicate_of", "match_kind", "canonical_upload",
        F.array_join(F.transform("validation_issues", lambda i: i["code"]), ",").alias("codes"),
    )


@query("e_f2_incremental_resolution", with_blocks("resolved") + """SELECT id, status, duplicate_of, match_kind FROM transactions""")
def incremental_resolution(spark, sf_dir):
    """Uploads 1 and 2 first, then 3 and 4 against what they left stored."""
    rows = stages.normalized_table(spark, sf_dir)
    first = duplicates.resolve_duplicates(rows.where("upload_seq <= 2"), stages.ARRIVAL)
    new = rows.where("upload_seq > 2")
    stored = duplicates.existing_matches(new, first)
    second = duplicates.resolve_duplicates(new, stages.ARRIVAL, stored)
    return first.unionByName(second).select("id", "status", "duplicate_of", "match_kind")


@query(
    "e_d3_existing_matches",
    with_blocks("resolved") + """SELECT id FROM transactions t WHERE upload_seq < 4 AND status = 'valid' AND (
      EXISTS (SELECT 1 FROM norm n WHERE n.upload_seq = 4 AND lower(n.source_transaction_id) = lower(t.source_transaction_id)
              AND lower(n.bank_account) = lower(t.bank_account))
      OR EXISTS (SELECT 1 FROM norm n WHERE n.upload_seq = 4 AND n.fingerprint = t.fingerprint))""",
)
def existing_matches(spark, sf_dir):
    new = stages.normalized_table(spark, sf_dir).where("upload_seq = 4")
    stored = stages.transactions(spark, sf_dir).where("upload_seq < 4")
    commit = commits.Commit(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    match_index.append(commit, stored, PARTS)
    return match_index.matches(new, commit.publish()).select("id")


@query("e_c1_canonical", with_blocks("resolved") + "SELECT id, cast(amount AS varchar) AS amount, direction FROM canonical")
def canonical(spark, sf_dir):
    return stages.canonical(spark, sf_dir).select("id", "amount", "direction")


@query("e_e1_ingestion_counts", with_blocks("resolved") + _COUNTS)
def ingestion_counts(spark, sf_dir):
    return duplicates.ingestion_counts(stages.transactions(spark, sf_dir), "upload_id")


@query(
    "e_e2_duplicate_counts",
    with_blocks("resolved") + """SELECT upload_id,
      count(*) FILTER (match_kind IN ('source_transaction_id', 'normalized_fingerprint') AND canonical_upload = upload_id) AS within_upload,
      count(*) FILTER (match_kind IN ('source_transaction_id', 'normalized_fingerprint') AND canonical_upload <> upload_id) AS across_uploads,
      count(*) FILTER (match_kind = 'conflict') AS source_id_conflicts FROM transactions GROUP BY upload_id""",
)
def duplicate_counts(spark, sf_dir):
    return duplicates.resolution_counts(stages.transactions(spark, sf_dir), "upload_id")


@query(
    "e_e15_g8_value_profile",
    with_blocks("resolved") + """, g AS (SELECT source_transaction_id AS v, count(*) AS n FROM transactions GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (v IS NOT NULL) AS BIGINT) AS present, count(v) AS distinct_values,
      count(*) FILTER (n > 1 AND v IS NOT NULL) AS repeated_values, min(v) AS least, max(v) AS greatest FROM g""",
)
def value_profile(spark, sf_dir):
    return ledger.value_profile(stages.transactions(spark, sf_dir), "source_transaction_id")


@query(
    "e_e20_repeated_keys",
    with_blocks("raw") + """SELECT bank_text, source_id, count(*) AS times FROM raw GROUP BY 1, 2 HAVING count(*) > 1""",
)
def repeated_keys(spark, sf_dir):
    return ledger.repeated(views.raw_bank(spark, sf_dir), "bank_text", "source_id")


@query(
    "e_i12_expectations",
    with_blocks("resolved") + """, a AS (SELECT count(*) AS n, count(*) FILTER (status = 'valid') AS v, sum(amount) FILTER (status = 'valid') AS s FROM transactions)
    SELECT 'rows' AS label, cast(n AS varchar) AS actual, true AS met FROM a UNION ALL SELECT 'valid', cast(v AS varchar), true FROM a
    UNION ALL SELECT 'valid_sum', cast(cast(s AS decimal(28,2)) AS varchar), true FROM a""",
)
def expectations(spark, sf_dir):
    """Measures of the resolved table, against ones taken from the raw rows and a fresh resolution."""
    amount = F.col("amount")
    rows = {"rows": F.count(F.lit(1))}
    valid = {"valid": F.count(F.lit(1)), "valid_sum": F.sum(amount).cast("decimal(28,2)")}
    resolved = stages.transactions(spark, sf_dir)
    actual = checks.measure(resolved, rows).union(checks.measure(duplicates.canonical(resolved), valid))
    fresh = stages.normalized_table(spark, sf_dir).where("status = 'valid'")
    taken = duplicates.resolve(fresh, stages.ARRIVAL).select("id")
    expected = checks.measure(views.raw_bank(spark, sf_dir), rows).union(
        checks.measure(fresh.join(taken, "id", "left_anti"), valid)
    )
    return checks.expectations(actual, expected).select("label", "actual", "met")


# --- E-L: streaming -----------------------------------------------------------------------------


def bank_files(spark: SparkSession, sf_dir: str, folder: str, rows_per_file: int = 20_000) -> None:
    """The bank exports as CSV files of bounded size, written by Spark."""
    raw = views.raw_bank(spark, sf_dir).select(*stages.CONFIG.mapping.headers())
    raw.write.option("maxRecordsPerFile", rows_per_file).csv(
        folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


@query(
    "e_l1_a1_a6_streaming_ingest",
    with_blocks("norm") + """SELECT source_transaction_id, fingerprint, array_to_string(list_sort(string_split(codes, ',')), ',') AS codes, transaction_date::varchar AS transaction_date,
      cast(amount AS varchar) AS amount, direction, count(*) AS rows, 0 AS added_again FROM norm GROUP BY ALL""",
)
def streaming_ingest(spark, sf_dir):
    """Files through the landing stream, then once more from a lost stream checkpoint.

    Files arrive in no given order, so which of two equal rows is the first is left out; what each
    row holds and what is wrong with it is not.
    """
    base = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    bank_files(spark, sf_dir, f"{base}/in")
    seen = []
    for checkpoint in ("first", "second"):
        landing.start(spark, f"{base}/in", f"{base}/out", f"{base}/{checkpoint}", stages.CONFIG).awaitTermination()
        seen.append(commits.latest(spark, f"{base}/out").read("transactions"))
    first, second = (t.count() for t in seen)
    codes = F.transform("validation_issues", lambda i: i["code"])
    own = F.filter(codes, lambda c: ~c.startswith("duplicate_") & (c != "source_transaction_id_conflict"))
    rows = seen[1].withColumn("codes", F.array_join(F.array_sort(own), ","))
    return rows.groupBy(
        "source_transaction_id", "fingerprint", "codes", "transaction_date", "amount", "direction"
    ).agg(F.count(F.lit(1)).alias("rows"), F.lit(second - first).alias("added_again"))
