"""Ordered rules: the first active rule by priority whose conditions all hold.

Every rule needs a positive phrase, so a row can only meet rules one of whose phrases occurs in its
description. The index over the rules is inverted: each phrase is listed under one of its
three-character pieces, the rarest in the rule table. A fixed bitmap of those pieces (SLOTS bits)
goes to every task, and of a description only the pieces that may be in it leave the row: most
descriptions give none or one, however long they are. What meets by piece is tested in full, and the
least priority wins by a grouped minimum that combines before the shuffle. Distinct descriptions are
matched, not rows, so a description of many rows is matched once; they are known by two 64-bit
hashes, which is all that rows and matches are joined by. The rule table may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.constants import SOURCE_RULE
from tallybook.operators.accounts import account_problem, with_account
from tallybook.session import store

MATCH = (
    "struct<rule_id:string,priority:int,transaction_type:string,counterparty_name:string,"
    "account_number:string,account_name:string,confidence:decimal(10,9),explanation:string,"
    "source:string,review_required:boolean,problem:string>"
)
KEY = ("description_normalized", "bank_key", "currency", "direction")
SLOTS = 1 << 16
_PIECE = 3


def _pieces(text: Column) -> Column:
    """Three-character pieces; a shorter text is its own piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (_PIECE - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(_PIECE)))


def _slot(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(SLOTS)).cast("int")


def _known_pieces(text: Column, keys: DataFrame) -> Column:
    """Distinct pieces of a text whose bit is set in the bitmap of the rules' pieces; no piece of a rule is lost."""
    words = [0] * (SLOTS // 64)
    for row in keys.select(_slot(F.col("piece")).alias("slot")).distinct().collect():  # at most SLOTS numbers
        words[row["slot"] // 64] |= 1 << row["slot"] % 64
    bitmap = F.lit([w - (1 << 64) if w >> 63 else w for w in words])

    def held(piece: Column) -> Column:
        slot = _slot(piece)
        return F.bit_get(F.get(bitmap, F.shiftright(slot, 6)), slot.bitwiseAND(63)) == 1

    return F.array_distinct(F.filter(_pieces(text), held))


def _hashes() -> dict[str, Column]:
    """128 bits for what a rule looks at; nulls are told from texts."""
    marked = [F.coalesce(F.concat(F.lit("."), F.col(c)), F.lit("")) for c in KEY]
    joined = F.concat_ws("\x1f", *marked)
    return {"_one": F.xxhash64(joined), "_other": F.xxhash64(F.lit("other"), joined)}


def _holds(rule: Column) -> Column:
    """Whether a rule's conditions hold for description_normalized, bank_key, currency and direction."""
    description = F.col("description_normalized")

    def open_or(value: Column, name: str) -> Column:
        return value.isNull() | F.coalesce(value == F.col(name), F.lit(False))

    def empty_or(phrases: Column, found: Column) -> Column:
        return (F.size(phrases) == 0) | found

    return (
        open_or(rule["direction"], "direction")
        & open_or(rule["bank_account"], "bank_key")
        & open_or(rule["currency"], "currency")
        & empty_or(rule["description_exact"], F.array_contains(rule["description_exact"], description))
        & F.forall(rule["description_all"], lambda p: description.contains(p))
        & empty_or(rule["description_any"], F.exists(rule["description_any"], lambda p: description.contains(p)))
        & ~F.exists(rule["description_none"], lambda p: description.contains(p))
    )


def rule_keys(rules: DataFrame) -> DataFrame:
    """(rule id, piece): for each phrase that alone can make a row meet the rule, its rarest piece.

    Of phrases that must all occur one is enough; of phrases of which any may occur each needs its
    own. Pieces are counted over the rule table, so a piece that most rules share is rarely a key.
    """
    needed = (
        F.when(F.size("description_all") > 0, F.slice("description_all", 1, 1))
        .when(F.size("description_exact") > 0, F.col("description_exact"))
        .otherwise(F.col("description_any"))
    )
    phrases = rules.select("id", F.explode(needed).alias("phrase"))
    pieces = phrases.select("id", "phrase", F.explode(F.array_distinct(_pieces(F.col("phrase")))).alias("piece"))
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("shared"))
    rarest = pieces.join(shared, "piece").groupBy("id", "phrase").agg(F.min(F.struct("shared", "piece")).alias("r"))
    return rarest.select("id", "r.piece").distinct()


def match_rules(transactions: DataFrame, rules: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add the struct column `rule`, null where none matches."""
    active = rules.where("active")
    keys = rule_keys(active)
    conditions = F.struct(
        "id", "priority", "description_exact", "description_all", "description_any", "description_none",
        "direction", "bank_account", "currency",
    )
    keys = store(keys, "rule_keys")
    keyed = keys.join(active.select("id", conditions.alias("conditions")), "id").select("piece", "conditions")
    hashed = transactions.withColumns(_hashes())
    different = hashed.select("_one", "_other", *KEY).where("description_normalized is not null").distinct()
    pieces = _known_pieces(F.col("description_normalized"), keys)
    met = different.withColumn("piece", F.explode(pieces)).join(keyed, "piece")
    first = (
        met.where(_holds(F.col("conditions")))
        .groupBy("_one", "_other")
        .agg(F.min(F.struct("conditions.priority", "conditions.id")).alias("first"))
        .select("_one", "_other", F.col("first.id").alias("_id"))
    )
    resolved = with_account(active, accounts)
    outcome = resolved.select(
        F.col("id").alias("_id"),
        F.struct(
            F.col("id").alias("rule_id"), "priority", "transaction_type", "counterparty_name", "account_number",
            "account_name", "confidence",
            F.concat(F.lit("By rule "), F.col("id"), F.lit(": "), F.col("explanation")).alias("explanation"),
            F.lit(SOURCE_RULE).alias("source"), "review_required",
            account_problem(F.col("account"), F.col("account_name")).alias("problem"),
        ).cast(MATCH).alias("rule"),
    )
    ruled = first.join(outcome, "_id").drop("_id")
    return hashed.join(ruled, ["_one", "_other"], "left").select(*transactions.columns, "rule")
