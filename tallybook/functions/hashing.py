"""Stable identities: sha256 over canonical JSON or over lineage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUEST_PREFIX = "je-"

# What JSON text escapes.
_ESCAPED = r'["\\\x00-\x1f]'


def lineage_id(*parts: Column) -> Column:
    """Deterministic 128-bit identity, so a rerun yields the same rows."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 32)


def fingerprint(
    amount: Column, bank_key: Column, currency: Column, description: Column, day: Column
) -> Column:
    """Content identity of a transaction (bank case folded); null while any part is missing."""
    identity = F.struct(
        amount.cast("string").alias("amount"),
        bank_key.alias("bank_account"),
        currency.alias("currency"),
        description.alias("description"),
        day.cast("string").alias("transaction_date"),
    )
    complete = (
        amount.isNotNull()
        & bank_key.isNotNull()
        & currency.isNotNull()
        & description.isNotNull()
        & day.isNotNull()
    )
    # Written out directly where nothing needs escaping, which is the same text.
    special = F.concat(bank_key, description).rlike(_ESCAPED)
    direct = F.concat(
        F.lit('{"amount":"'), amount.cast("string"), F.lit('","bank_account":"'), bank_key,
        F.lit('","currency":"'), currency, F.lit('","description":"'), description,
        F.lit('","transaction_date":"'), day.cast("string"), F.lit('"}'),
    )
    text = F.when(special, F.to_json(identity)).otherwise(direct)
    return F.when(complete, F.sha2(text, 256))


def _quoted(c: Column) -> Column:
    """A text as JSON; written out directly where nothing needs escaping, which is the same text."""
    encoded = F.to_json(F.struct(c.alias("v")))
    written = F.substr(encoded, F.lit(6), F.length(encoded) - 6)
    return F.when(~c.rlike(_ESCAPED), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(written)


def _json_cell(cell: Column) -> Column:
    kind, value = cell["kind"], cell["value"]
    tagged = F.concat(
        F.lit('{"type":"'), kind, F.lit('","value":'), _quoted(value), F.lit("}")
    )
    return (
        F.when(kind.isNull() | value.isNull(), F.lit("null"))
        .when(kind.isin("int", "float", "bool"), value)
        .when(kind == "str", _quoted(value))
        .otherwise(tagged)
    )


def raw_hash(cells: Column) -> Column:
    """sha256 over all cells as JSON with sorted keys; typed values keep their type."""
    members = F.transform(
        F.sort_array(F.map_entries(cells)),
        lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _json_cell(e["value"])),
    )
    return F.sha2(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")), 256)


def request_id(ids: Column) -> Column:
    """Identity of a posting, derived from its source transactions."""
    digest = F.sha2(F.concat_ws("|", F.array_sort(ids)), 256)
    return F.concat(F.lit(REQUEST_PREFIX), F.substring(digest, 1, 40))
