"""Duplicate resolution against a sequential scan."""

import time
from pathlib import Path

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.operators import duplicates
from tallybook.schemas import ISSUES

LAYOUT = f"id string, upload_id string, seq int, bank_key string, source_id_key string, source_transaction_id string, fingerprint string, status string, duplicate_of string, validation_issues {ISSUES}"


def table(spark, rows):
    """Rows: (id, upload, seq, source id or None, content)."""
    data = [
        (i, up, seq, "bank", s, s, None if f is None else f"{f:064x}", "valid" if f is not None else "invalid", None, [])
        for i, up, seq, s, f in rows
    ]
    return spark.createDataFrame(data, LAYOUT)


def scan(rows, stored=()):
    """Sequential model: id -> (status, canonical id)."""
    sources, contents, out = {}, {}, {}
    for i, _, _, s, f in stored:
        if s is not None:
            sources.setdefault(s, (i, f))
        contents.setdefault(f, i)
    for i, _, _, s, f in sorted(rows, key=lambda r: (r[2], r[0])):
        if f is None:
            out[i] = ("invalid", None)
        elif s is not None and s in sources:
            target, content = sources[s]
            out[i] = ("invalid", None) if content != f else ("duplicate", target)
        elif f in contents:
            out[i] = ("duplicate", contents[f])
        else:
            out[i] = ("valid", None)
            contents[f] = i
            if s is not None:
                sources[s] = (i, f)
    return out


def resolved(spark, rows, stored=None):
    found = duplicates.resolve_duplicates(table(spark, rows).repartition(3), ["seq"], stored)
    return {r["id"]: (r["status"], r["duplicate_of"]) for r in found.collect()}


def test_chain_keeps_third_row(spark):
    rows = [("a", "u1", 1, "s1", 1), ("b", "u1", 2, "s2", 1), ("c", "u1", 3, "s2", 2)]
    assert resolved(spark, rows) == {"a": ("valid", None), "b": ("duplicate", "a"), "c": ("valid", None)}


def test_conflict_and_missing_source(spark):
    rows = [("a", "u1", 1, "s1", 1), ("b", "u2", 2, "s1", 2), ("c", "u2", 3, None, 1), ("d", "u2", 4, None, 3), ("e", "u2", 5, None, None)]
    assert resolved(spark, rows) == scan(rows)


def test_long_chain_takes_many_rounds(spark):
    rows = []
    for k in range(6):  # each link is decided only after the one before
        rows += [(f"a{k}", "u", 2 * k, f"s{k}", k), (f"b{k}", "u", 2 * k + 1, f"s{k + 1}", k)]
    assert resolved(spark, rows) == scan(rows)


def test_counts_and_issue_codes(spark):
    rows = [("a", "u1", 1, "s1", 1), ("b", "u1", 2, "s1", 1), ("c", "u2", 3, "s9", 1), ("d", "u2", 4, "s1", 7)]
    found = duplicates.resolve_duplicates(table(spark, rows), ["seq"])
    counts = {r["upload_id"]: (r["within_upload"], r["across_uploads"], r["source_id_conflicts"])
              for r in duplicates.resolution_counts(found, "upload_id").collect()}
    assert counts == {"u1": (1, 0, 0), "u2": (0, 1, 1)}
    codes = {r["id"]: r["c"] for r in found.select("id", F.transform("validation_issues", lambda i: i["code"]).alias("c")).collect()}
    assert codes == {"a": [], "b": ["duplicate_source_transaction_id"], "c": ["duplicate_normalized_fingerprint"], "d": ["source_transaction_id_conflict"]}


def test_replay_against_stored_rows(spark):
    first = [("a", "u1", 1, "s1", 1), ("b", "u1", 2, "s2", 2)]
    stored = duplicates.resolve_duplicates(table(spark, first), ["seq"]).select(*table(spark, first).columns)
    new = [("a", "u1", 1, "s1", 1), ("x", "u2", 3, "s1", 9), ("y", "u2", 4, "s7", 2), ("z", "u2", 5, "s8", 8)]
    found = resolved(spark, new, stored)
    assert found == {"a": ("valid", None), "x": ("invalid", None), "y": ("duplicate", "b"), "z": ("valid", None)}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([None, "s1", "s2", "s3", "s4", "s5"]), st.integers(1, 6)), min_size=1, max_size=40), st.integers(0, 12))
def test_equal_to_sequential_scan(spark, pairs, split):
    rows = [(f"r{i:03d}", f"u{i % 3}", i, s, f) for i, (s, f) in enumerate(pairs)]
    assert resolved(spark, rows) == scan(rows)
    first, second = rows[:split], rows[split:]
    if first and second:
        done = duplicates.resolve_duplicates(table(spark, first), ["seq"]).select(*table(spark, first).columns)
        states = scan(rows)
        assert resolved(spark, second, done) == {r[0]: states[r[0]] for r in second}


def test_hot_key(spark):
    """A third of the rows share one content, another third one bank id."""
    rows = [(f"r{i:05d}", "u", i, f"s{i}" if i % 3 else "hot", 0 if i % 3 == 1 else i + 1) for i in range(3000)]
    assert resolved(spark, rows) == scan(rows)


def test_rounds_are_hash_aggregates(spark):
    """Minima over the place in order combine before the shuffle, without sorting by key."""
    rows = duplicates._keys(table(spark, [("a", "u", 1, "s1", 1), ("b", "u", 2, None, 1)]), ["seq"])
    plan = duplicates._first_of_both(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_order_of_several_columns(spark):
    """Nulls come first, then the columns one after the other, ids last; equal on any dealing of rows."""
    data = [("d", "u1", 2, "x", "s1", 1), ("c", "u1", 1, "y", "s1", 1), ("b", "u1", 1, "x", "s1", 1), ("a", "u2", 1, "x", "s2", 2),
            ("e", "u2", None, "z", "s2", 2), ("g", "u2", 3, None, None, 3), ("f", "u1", 3, None, None, 3)]
    rows = [(i, up, seq, s, f) for i, up, seq, _, s, f in data]
    named = spark.createDataFrame([(r[0], r[3]) for r in data], "id string, part string")
    for partitions in (1, 7):
        given = table(spark, rows).join(named, "id").repartition(partitions)
        found = duplicates.resolve_duplicates(given, ["seq", "part"])
        kept = {r["id"]: r["duplicate_of"] for r in found.select("id", "duplicate_of").collect()}
        assert kept == {"b": None, "c": "b", "d": "b", "e": None, "a": "e", "f": None, "g": "f"}


def test_empty_table_and_repeated_rows(spark):
    none = table(spark, []).select("*")
    assert duplicates.resolve_duplicates(none, ["seq"]).isEmpty()
    row = ("a", "u", 1, "s1", 1)
    again = duplicates.resolve_duplicates(table(spark, [row, row]), ["seq"]).select("id", "status", "duplicate_of").collect()
    assert [tuple(r) for r in again] == [("a", "valid", None)] * 2


def test_stored_transactions_are_lean_and_whole(spark, monkeypatch):
    """Stored transactions: rounds are removed, columns that follow from others are not stored, rows come back whole."""
    from tallybook.plans import stages
    from tallybook.session import shared_dir

    raw = [
        (1, i, f" S-{i % 40} ", "2026-04-0%d" % (1 + i % 3), f" PAY  {i % 30} " if i % 7 else "", "%d.00" % (i % 25), "usd", "Main")
        for i in range(200)
    ]
    names = "upload_seq long, row_no long, source_id string, date_text string, description_text string, amount_text string, currency_text string, bank_text string"
    monkeypatch.setattr(stages.views, "raw_bank", lambda *_: spark.createDataFrame(raw, names))
    stages.forget()
    given = stages.normalized(spark, "given")
    stored = stages.transactions(spark, "given")
    whole = duplicates.resolve_duplicates(given, stages.ARRIVAL)
    assert stored.columns == whole.columns
    assert sorted(map(str, stored.collect())) == sorted(map(str, whole.select(*stored.columns).collect()))
    assert sorted(map(str, stages.normalized_table(spark, "given").collect())) == sorted(map(str, given.collect()))
    folders = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    assert not any("raw_record_id" in spark.read.parquet(f).columns for f in folders)
    scratch = Path(shared_dir(spark).removeprefix("file:")) / "scratch"
    assert not scratch.exists() or not any(scratch.iterdir())
    stages.forget()


def test_transactions_alone_stay_on_disk(spark, monkeypatch):
    """Neither normalized rows nor links outlast the writing of transactions, which hold no computed digest; repeated rows too."""
    from tallybook.plans import stages
    from tallybook.session import shared_dir

    raw = [(1 + i % 2, i // 2, f"S-{i % 40}", "2026-04-01", f"Pay {i % 30}", "%d.00" % (i % 25), "usd", "Main") for i in range(200)]
    names = "upload_seq long, row_no long, source_id string, date_text string, description_text string, amount_text string, currency_text string, bank_text string"
    monkeypatch.setattr(stages.views, "raw_bank", lambda *_: spark.createDataFrame(raw * 2, names))
    stages.forget()
    folder = Path(shared_dir(spark).removeprefix("file:")) / "tables"
    before = set(folder.iterdir()) if folder.exists() else set()
    stored = stages.transactions(spark, "alone")
    assert [p.name.rsplit("_", 1)[0] for p in set(folder.iterdir()) - before] == ["transactions"]
    held = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in stored.inputFiles()})
    assert not {"raw_record_id", "upload_id", "fingerprint"} & set(held.columns)
    given = stages.normalized(spark, "alone")
    whole = duplicates.resolve_duplicates(given, stages.ARRIVAL)
    assert sorted(map(str, stored.collect())) == sorted(map(str, whole.select(*stored.columns).collect()))
    assert sorted(map(str, stages.normalized_table(spark, "alone").collect())) == sorted(map(str, given.collect()))
    stages.forget()


def test_rows_that_are_placed_already(spark):
    """A stored place in order gives what sorting by the order gives."""
    rows = [(f"r{i:03d}", "u", (i * 37) % 101, f"s{i % 17}" if i % 4 else None, i % 23) for i in range(101)]
    placed = table(spark, rows).withColumn("place", F.col("seq").cast("long") * 10)
    by_place = duplicates.resolve(placed, ["seq"], place="place").collect()
    assert sorted(map(str, by_place)) == sorted(map(str, duplicates.resolve(table(spark, rows), ["seq"]).collect())) and by_place


def test_resolution_in_parts(spark):
    """Parts give what the whole gives, chains and repeated rows too, and no part draws on all canonical rows."""
    rows = [(f"r{i:03d}", "u", (i * 37) % 101, f"s{i % 17}" if i % 4 else None, i % 23) for i in range(101)]
    placed = table(spark, [*rows, rows[7]]).withColumn("seq", F.monotonically_increasing_id())
    placed = placed.withColumns({"place": F.col("seq") * 10, "part": F.col("seq") % 8}).localCheckpoint()
    parts = duplicates.resolve_in_parts(placed, "place", "part")
    found = [r for p in parts for r in p.collect()]
    whole = duplicates.resolve(placed, ["seq"])
    assert sorted(map(str, [r[:4] for r in found])) == sorted(str(tuple(r)) for r in whole.collect()) and found
    kept = dict(placed.select("id", "part").collect())
    assert all(r["part"] == kept[r["id"]] or r["id"] == rows[7][0] for r in found)
    assert len(parts) > 4


def test_transactions_free_what_they_have_read(spark, monkeypatch):
    """Normalized rows and links of a part are removed once it is written, before the next part is."""
    from tallybook.plans import stages

    raw = [(1 + i % 2, i // 2, f"S-{i % 40}", "2026-04-01", f"Pay {i % 30}", "%d.00" % (i % 25), "usd", "Main") for i in range(200)]
    names = "upload_seq long, row_no long, source_id string, date_text string, description_text string, amount_text string, currency_text string, bank_text string"
    monkeypatch.setattr(stages.views, "raw_bank", lambda *_: spark.createDataFrame(raw, names))
    removed = []

    def held(spark, path):
        folder = Path(path.removeprefix("file:"))
        removed.append((folder.name, len([p for p in folder.parent.iterdir() if p.name.startswith("part=")])))
        remove(spark, path)

    remove = stages.remove
    monkeypatch.setattr(stages, "remove", held)
    stages.forget()
    stages.transactions(spark, "freed")
    stages.forget()
    assert [name for name, _ in removed] == [f"part={i}" for i in range(8) for _ in range(2)]
    assert [left for _, left in removed[::2]] == list(range(8, 0, -1))


def test_classifications_are_written_in_parts(spark, monkeypatch):
    """Two parts by id hold each classification once."""
    from tallybook.plans import derived

    rows = [(f"t{i:02d}", i, ["google ads", "adp payroll x", "unknown"][i % 3], "operating checking", "USD", "outflow") for i in range(60)]
    names = "id string, row_no long, description_normalized string, bank_key string, currency string, direction string"
    monkeypatch.setattr(derived.stages, "canonical", lambda *_: spark.createDataFrame(rows, names))
    monkeypatch.setattr(derived.stages, "once", lambda spark, sf_dir, name, build, key=None: build())
    parts = derived.classified(spark, "given")
    assert isinstance(parts, list) and len(parts) == 2
    ids = [[r["id"] for r in part.select("id").collect()] for part in parts]
    assert all(ids) and sorted(sum(ids, [])) == sorted(r[0] for r in rows if r[1] % 3 != 2)


def test_store_leaves_no_shuffle_files(spark):
    from tallybook.session import store

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = {p.name for p in local.rglob("shuffle_*.data")}
    rows = spark.range(50_000).repartition(5)
    kept = store(rows, "kept", lasting=True)
    deadline = time.time() + 20
    while time.time() < deadline and {p.name for p in local.rglob("shuffle_*.data")} - before:
        time.sleep(0.2)
    assert not {p.name for p in local.rglob("shuffle_*.data")} - before
    assert kept.count() == 50_000
