"""Text expressions. Whitespace and case folding follow Unicode, not Java, rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: every character Python's str.split() takes for whitespace.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# The same characters one by one, for trimming without a regular expression.
_WS_CHARACTERS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _beyond_ascii(c: Column) -> Column:
    """Whether anything but printable ASCII occurs; nearly all bank text stays below."""
    return c.rlike("[^ -~]")


def strip(c: Column) -> Column:
    return F.when(_beyond_ascii(c), F.btrim(c, F.lit(_WS_CHARACTERS))).otherwise(F.trim(c))


def collapse(c: Column) -> Column:
    """Strip, and turn inner whitespace runs into one blank."""
    any_kind = F.trim(F.regexp_replace(c, f"{WS}+", " "))
    blanks = F.trim(F.regexp_replace(c, "  +", " "))
    return (
        F.when(_beyond_ascii(c), any_kind)
        .when(c.contains("  "), blanks)
        .otherwise(F.trim(c))
    )


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def optional_text(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def normalized_text(c: Column) -> Column:
    return F.when(strip(c) != "", collapse(c))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


@F.pandas_udf(StringType())
def _fold_compatible(values: pd.Series) -> pd.Series:
    def fold(text: str) -> str:
        return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()

    return values.map(fold, na_action="ignore")


def _folding() -> tuple[str, str, dict[str, str]]:
    """Unicode case folding, by Python's rule: characters that fold to one, and those that fold to several."""
    folds = {chr(i): chr(i).casefold() for i in range(0x110000) if not 0xD800 <= i < 0xE000}
    single = {c: f for c, f in folds.items() if f != c and len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folds.items() if len(f) > 1}


_FROM, _TO, _EXPANDED = _folding()


def casefold(c: Column) -> Column:
    """Case folding inside the JVM: `lower` for ASCII, tables for the rest."""
    folded = F.translate(c, _FROM, _TO)
    table = F.create_map(*[F.lit(x) for pair in _EXPANDED.items() for x in pair])
    expanded = F.array_join(F.transform(F.split(folded, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    rest = F.when(folded.rlike(f"[{''.join(_EXPANDED)}]"), expanded).otherwise(folded)
    return F.when(is_ascii(c), F.lower(c)).otherwise(rest)


def normalize_description(c: Column) -> Column:
    """NFKC, collapsed whitespace, case folded; blank becomes null."""
    plain = F.lower(collapse(c))
    folded = F.when(is_ascii(c), plain).otherwise(_fold_compatible(F.when(~is_ascii(c), c)))
    return F.when(strip(c) != "", folded)


def fold_name(c: Column) -> Column:
    """Comparable form of a name: collapsed and case folded."""
    return collapse(casefold(c))


def first_text(*options: Column) -> Column:
    """First option that is neither null nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def safe_message(c: Column, limit: int = 500) -> Column:
    return F.substring(collapse(c), 1, limit)


def clean_phrases(c: Column) -> Column:
    """Phrase list: collapsed, case folded, distinct in order."""
    return F.array_distinct(F.filter(F.transform(c, fold_name), lambda p: p != ""))


def period_label(start: Column, end: Column) -> Column:
    return F.concat_ws(" through ", start.cast("string"), end.cast("string"))
