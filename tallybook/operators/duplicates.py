"""Duplicate and conflict resolution.

A row is canonical iff no earlier canonical row shares its source key (bank and bank-given
id) or its fingerprint. That rule is order-dependent, so a plain row_number is wrong: with
A(s1,f1), B(s2,f1), C(s2,f2), B duplicates A, s2 stays free and C is canonical.

Set-based form: a row that comes first in both its source group and its fingerprint group is
canonical; rows sharing either key with a new canonical are decided; repeat on the rest.
Arrival order becomes one number a row, by one sort in ranges, and keys become numbers too, stored once.
Group minima are hash aggregates over them (combined before the shuffle, so a hot key costs one number
per task). Only groups of several rows are looked at further: their later rows, each with the place of
the first, are what the first round leaves to decide, and whether that first row is canonical follows
from the later rows of the other key. Rows that share no key are thus met once per key and never
joined. Against rows stored earlier the rounds run over all rows. What a round leaves is a stored
table. Rows without a source id get a source key made from their fingerprint: it ties them to
no one else and keeps null keys out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.constants import DUPLICATE, ERROR, INVALID, VALID, WARNING
from tallybook.operators.normalize import issue, issue_list
from tallybook.session import PARTS, in_parts, remove, store, store_parts, table_path

BY_SOURCE, BY_CONTENT, CONFLICT = "source_transaction_id", "normalized_fingerprint", "conflict"
_NO_SOURCE = "\x00"
_KEYS = ("id", "upload_id", "source_key", "content_key")


def source_key() -> Column:
    """Bank and bank-given id; null without such an id."""
    return F.concat(F.col("bank_key"), F.lit("\x1f"), F.col("source_id_key"))


def _source_key() -> Column:
    return F.coalesce(source_key(), F.concat(F.lit(_NO_SOURCE), F.col("fingerprint")))


def _content_key() -> Column:
    """Half of the fingerprint's digest, as many bits as an id has."""
    return F.unhex(F.right(F.col("fingerprint"), F.lit(32)))


def _arrived(transactions: DataFrame, order: Sequence[str], place: str | None = None, *also: str) -> DataFrame:
    """Narrow rows for the rounds: place in order as one number, keys, id and upload.

    Rows are sorted in ranges of the order, so the number of a row, its range's and its place there,
    grows with the order, and minima over it are hash aggregates. It is to be stored at once: another run
    of the sort could draw other ranges. Rows of a stored table that has this number are not sorted again,
    and keep the columns `also`.
    """
    valid = transactions.where(F.col("status") == VALID)
    keys = ["id", "upload_id", _source_key().alias("source_key"), _content_key().alias("content_key")]
    if place is not None:
        return valid.select(F.col(place).alias("pos"), *keys, *also)
    rows = valid.select(*[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)], *keys)
    by_arrival = [*[F.col(f"order_{i}") for i in range(len(order))], F.col("id")]
    dealt = rows.repartitionByRange(*by_arrival).sortWithinPartitions(*by_arrival)
    return dealt.select(F.monotonically_increasing_id().alias("pos"), *_KEYS)


def _keys(transactions: DataFrame, order: Sequence[str], place: str | None = None) -> DataFrame:
    """The narrow rows, with the place in order fixed."""
    rows = _arrived(transactions, order, place)
    return rows if place is not None else store(rows, "arrivals")


def _first_of_both(rows: DataFrame) -> DataFrame:
    """Rows that open both their groups; both sides meet on the place in order and bring their key, rows the rest."""
    by_source = rows.groupBy("source_key").agg(F.min("pos").alias("pos"))
    by_content = rows.groupBy("content_key").agg(F.min("pos").alias("pos"))
    named = rows.select("pos", "id", "upload_id")
    return by_source.join(by_content, "pos").join(named, "pos").select("pos", *_KEYS)


def _undecided(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    return rows.join(canonical.select("source_key"), "source_key", "left_anti").join(
        canonical.select("content_key"), "content_key", "left_anti"
    )


def _stored_keys(stored: DataFrame) -> DataFrame:
    """Keys of rows resolved earlier; a null place comes before every new row."""
    return stored.where(is_canonical()).select(
        F.lit(None).cast("long").alias("pos"),
        "id",
        "upload_id",
        _source_key().alias("source_key"),
        _content_key().alias("content_key"),
    )


def _matched(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows with the canonical row of their source key and of their content, if any."""
    source_side = canonical.select(
        "source_key", F.struct("id", "upload_id", "content_key", "pos").alias("by_source")
    )
    content_side = canonical.select("content_key", F.struct("id", "upload_id").alias("by_content"))
    return rows.join(source_side, "source_key", "left").join(
        content_side, "content_key", "left"
    )


def _later_rounds(undecided: DataFrame, canonical: DataFrame) -> DataFrame:
    """Canonical rows after the first round, for chains of shared keys."""
    while not undecided.isEmpty():
        new = store(_first_of_both(undecided), "round_firsts")
        undecided = store(_undecided(undecided, new), "round_rest")
        canonical = canonical.unionByName(new)
    return canonical


def _canonical_rows(fresh: DataFrame, canonical: DataFrame) -> DataFrame:
    """Canonical rows among fresh rows and those known before."""
    first = store(_first_of_both(fresh), "firsts")
    undecided = store_parts(in_parts(_undecided(fresh, first), "id"), "undecided")
    return _later_rounds(undecided, canonical.unionByName(first))


def _taken() -> Column:
    """Whether an earlier canonical row, `by_source`, owns the source key.

    A later canonical row may own the source key of a row already taken by its content.
    """
    earlier = F.col("by_source.pos")
    return (earlier.isNull() | (earlier < F.col("pos"))) & ~F.col("source_key").startswith(_NO_SOURCE)


def _source_kind() -> Column:
    differs = F.col("by_source.content_key") != F.col("content_key")
    return F.when(differs, F.lit(CONFLICT)).otherwise(F.lit(BY_SOURCE))


def resolve(
    transactions: DataFrame,
    order: Sequence[str],
    stored: DataFrame | None = None,
    place: str | None = None,
) -> DataFrame:
    """One row per non-canonical valid row: id, match kind, canonical id, its upload.

    `order` names the columns that give the arrival order (ids break ties). `stored` holds
    transactions resolved earlier; they come before everything new. `place` names the column of a
    stored table that holds a number of its own for each row, growing with the order.
    """
    if stored is None:
        rows = store(_numbered(_arrived(transactions, order, place)), "arrivals")
        return reduce(DataFrame.unionByName, _resolve_afresh(rows, rows.select("pos", "id", "upload_id")))
    canonical = _stored_keys(stored)
    # A row never matches itself: replays of stored rows keep their state.
    transactions = transactions.join(canonical.select("id"), "id", "left_anti")
    rows = _keys(transactions, order, place)
    fresh = _undecided(rows, canonical)

    matched = _matched(rows, _canonical_rows(fresh, canonical))

    taken = F.col("by_source").isNotNull() & _taken()
    kind = F.when(taken, _source_kind()).otherwise(F.lit(BY_CONTENT))
    target = F.when(taken, F.col("by_source.id")).otherwise(F.col("by_content.id"))
    upload = F.when(taken, F.col("by_source.upload_id")).otherwise(F.col("by_content.upload_id"))
    resolved = matched.select(
        "id",
        kind.alias("match_kind"),
        target.alias("canonical_id"),
        upload.alias("canonical_upload"),
    )
    return resolved.where(F.col("canonical_id") != F.col("id"))


def resolve_in_parts(transactions: DataFrame, place: str, part: str) -> list[DataFrame]:
    """As `resolve` for a stored table that holds each row's place, in parts to be written one after the other.

    No row was stored beforehand. The column `part` is kept.
    """
    spark = transactions.sparkSession
    path = table_path(spark, "keys")
    keys = _numbered(_arrived(transactions, (), place, part)).drop("id", "upload_id")
    rows = store_parts([keys], "keys", path=path)
    ids = transactions.select(F.col(place).alias("pos"), "id", "upload_id", part)
    return _resolve_afresh(rows, ids, part, lambda: remove(spark, path))


_SOURCE, _CONTENT = ("source_1", "source_2"), ("content_1", "content_2")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with 128 bits of numbers in place of each key."""
    named = {}
    for names, key in ((_SOURCE, "source_key"), (_CONTENT, "content_key")):
        named |= {names[0]: F.xxhash64(key), names[1]: F.xxhash64(F.lit("other"), key)}
    named["has_source"] = ~F.col("source_key").startswith(_NO_SOURCE)
    return rows.withColumns(named).drop("source_key", "content_key")


def _late(rows: DataFrame, key: Sequence[str], *of_first: str) -> DataFrame:
    """Rows that come after another of their key, with the place of the first and that row's `of_first`."""
    firsts = rows.groupBy(*key).agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("_rows"),
        *[F.min_by(c, "pos").alias(f"first_{c}") for c in of_first],
    )
    return rows.join(firsts.where("_rows > 1").drop("_rows"), list(key)).where("pos > first")


def _parted(parts: int, key: str, *sides: DataFrame) -> list[tuple[DataFrame, ...]]:
    """Tables that are to meet by a key, dealt alike into parts by it."""
    return list(zip(*[in_parts(side, key, parts) for side in sides]))


def _without(rows: DataFrame, others: DataFrame, key: str = "pos") -> DataFrame:
    return rows.join(others.select(F.col("pos").alias(key)), key, "left_anti")


def _resolve_afresh(
    rows: DataFrame, ids: DataFrame, part: str | None = None, keys_read: Callable[[], None] = lambda: None
) -> list[DataFrame]:
    """Links of rows that meet no row stored before, in parts.

    `rows` is a stored table of `_numbered` rows, `ids` has id and upload by place, and both the column `part`, if
    one is named. `keys_read` is called once the rows' keys are no longer needed. Until the end rows are known by place.
    """
    also = [] if part is None else [part]
    parts = 2 if part is None else PARTS
    kind_of = lambda differs: F.when(differs, F.lit(CONFLICT)).otherwise(F.lit(BY_SOURCE)).alias("match_kind")

    differs = reduce(lambda a, b: a | b, [F.col(f"first_{c}") != F.col(c) for c in _CONTENT])
    found = [_late(r.select("pos", *_CONTENT, *also), _CONTENT).select("pos", "first", *also) for r in in_parts(rows, _CONTENT[0], parts)]
    late_content = store_parts(found, "late_content")
    narrow = rows.where("has_source").select("pos", *_SOURCE, *_CONTENT, *also)
    found = [_late(r, _SOURCE, *_CONTENT).select("pos", "first", kind_of(differs), *also) for r in in_parts(narrow, _SOURCE[0], parts)]
    late_source = store_parts(found, "late_source")

    # A row that opens one group is canonical in the first round unless it is a later one in its other group.
    taken = store_parts([_without(late, late_content, "first") for late in in_parts(late_source, "first", parts)], "taken")
    alike = store_parts([_without(late, late_source, "first") for late in in_parts(late_content, "first", parts)], "alike")

    # The others, and rows whose content is owned but whose source key may get an earlier owner in a later round.
    open_parts = []
    for source, content, by_source, by_content, all_rows in _parted(parts, "pos", late_source, late_content, taken, alike, rows):
        places = _without(source, by_source).select("pos").unionByName(_without(_without(content, by_content), source).select("pos"))
        named = places.join(by_content.select("pos", "first"), "pos", "left").join(all_rows, "pos")
        texts = {"source_key": F.concat_ws("|", *_SOURCE), "content_key": F.concat_ws("|", *_CONTENT)}
        open_parts.append(named.withColumns(texts).select("pos", "first", "source_key", "content_key", "has_source", *also))
    asking = store_parts(open_parts, "asking")
    keys_read()

    undecided = asking.where("first is null")
    none = F.lit(None).cast("string")
    rounds = undecided.select("pos", none.alias("id"), none.alias("upload_id"), "source_key", "content_key")
    owners = _later_rounds(rounds, rounds.where(F.lit(False))).select("source_key", "content_key", F.col("pos").alias("owner"))
    met = asking.where("has_source").join(owners.withColumnRenamed("content_key", "owned"), "source_key").where("owner < pos")
    retaken = store(met.select("pos", F.col("owner").alias("first"), kind_of(F.col("owned") != F.col("content_key")), *also), "retaken")
    later = _without(undecided.drop("first").join(owners.drop("source_key"), "content_key").where("owner <> pos"), retaken)
    by_content = later.select("pos", F.col("owner").alias("first"), *also)
    for content, by_source, again in _parted(parts, "pos", alike, taken, retaken):
        by_content = by_content.unionByName(_without(_without(content, by_source), again))
    links = taken.unionByName(retaken).unionByName(by_content.withColumn("match_kind", F.lit(BY_CONTENT)).select(taken.columns))

    firsts = ids.select(F.col("pos").alias("first"), F.col("id").alias("canonical_id"), F.col("upload_id").alias("canonical_upload"))
    named = store_parts([mine.join(owner, "first").drop("first") for mine, owner in _parted(parts, "first", links, firsts)], "named")
    own = ids.select("pos", "id", *also)
    if part is None:
        sides = _parted(parts, "pos", named, own)
    else:
        sides = [(named.where(F.col(part) == i), own.where(F.col(part) == i).drop(part)) for i in range(2 * PARTS)]
    return [
        mine.join(names, "pos").where(F.col("canonical_id") != F.col("id"))
        .select("id", "match_kind", "canonical_id", "canonical_upload", *also)
        for mine, names in sides
    ]


def linked(transactions: DataFrame, resolution: DataFrame) -> DataFrame:
    """Transactions with what the resolution says of them, if anything."""
    return transactions.drop("duplicate_of").join(resolution, "id", "left")


def apply_resolution(transactions: DataFrame, resolution: DataFrame) -> DataFrame:
    """Transactions with final status, link and issue; adds match_kind and canonical_upload."""
    return marked(linked(transactions, resolution))


def marked(joined: DataFrame) -> DataFrame:
    """Final status, link and issue of linked transactions."""
    kind, target = F.col("match_kind"), F.col("canonical_id")
    conflict_raw = F.to_json(
        F.struct(
            F.col("source_transaction_id"), target.alias("canonical_transaction_id")
        )
    )
    found = [
        issue(kind == BY_SOURCE, "duplicate_source_transaction_id", "_record",
              "Repeats an earlier row by its bank id", target, WARNING),
        issue(kind == BY_CONTENT, "duplicate_normalized_fingerprint", "_record",
              "Repeats an earlier row by its content", target, WARNING),
        issue(kind == CONFLICT, "source_transaction_id_conflict", "source_transaction_id",
              "The same bank id carries other content", conflict_raw, ERROR),
    ]
    return joined.withColumns(
        {
            "validation_issues": issue_list(found, F.col("validation_issues")),
            "status": F.when(kind == CONFLICT, F.lit(INVALID))
            .when(kind.isNotNull(), F.lit(DUPLICATE))
            .otherwise(F.col("status")),
            "duplicate_of": F.when(kind.isNotNull() & (kind != CONFLICT), target),
        }
    ).drop("canonical_id")


def resolve_duplicates(
    transactions: DataFrame, order: Sequence[str], stored: DataFrame | None = None
) -> DataFrame:
    return apply_resolution(transactions, resolve(transactions, order, stored))


def is_canonical() -> Column:
    return (F.col("status") == VALID) & F.col("duplicate_of").isNull()


def canonical(transactions: DataFrame) -> DataFrame:
    return transactions.where(is_canonical())


def existing_matches(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored valid rows sharing a source key or fingerprint with any new row.

    Only ids, keys and state of stored rows are read; nothing else is needed of them.
    """
    valid = stored.where(F.col("status") == VALID).select(
        "id", "upload_id", "bank_key", "source_id_key", "fingerprint", "status", "duplicate_of",
        _source_key().alias("_key"),
    )
    wanted = new.select(_source_key().alias("_key"), "fingerprint")
    by_source = valid.where(~F.col("_key").startswith(_NO_SOURCE)).join(wanted.select("_key"), "_key", "left_semi")
    by_content = valid.join(wanted.select("fingerprint"), "fingerprint", "left_semi")
    return by_source.unionByName(by_content).drop("_key").dropDuplicates(["id"])


def resolution_counts(resolved: DataFrame, *keys: str) -> DataFrame:
    """Duplicates within and across uploads, and conflicts, per key."""
    kind, same = F.col("match_kind"), F.col("canonical_upload") == F.col("upload_id")
    duplicate = kind.isin(BY_SOURCE, BY_CONTENT)
    return resolved.groupBy(*keys).agg(
        F.count_if(duplicate & same).alias("within_upload"),
        F.count_if(duplicate & ~same).alias("across_uploads"),
        F.count_if(kind == CONFLICT).alias("source_id_conflicts"),
    )


def ingestion_counts(resolved: DataFrame, *keys: str) -> DataFrame:
    """Physical, valid, invalid and duplicate rows per key, with the upload's final state."""
    counts = resolved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("physical"),
        F.count_if(F.col("status") == VALID).alias("valid"),
        F.count_if(F.col("status") == INVALID).alias("invalid"),
        F.count_if(F.col("status") == DUPLICATE).alias("duplicate"),
    )
    state = F.when(F.col("invalid") > 0, F.lit("completed_with_errors")).otherwise(F.lit("completed"))
    return counts.withColumn("upload_status", state)
