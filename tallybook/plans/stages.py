"""Stages of the standard job over the bank-export view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.config.settings import ColumnMapping, IngestionConfig
from tallybook.functions import hashing, text
from tallybook.functions.cells import Cell
from tallybook.operators import duplicates
from tallybook.operators.normalize import normalize_fields
from tallybook.plans import views
from tallybook.session import PARTS, part_of, remove, scratch, spread, store_parts

CONFIG = IngestionConfig(
    ColumnMapping(
        transaction_date="date_text",
        description="description_text",
        amount="amount_text",
        source_transaction_id="source_id",
        currency="currency_text",
        bank_account="bank_text",
    )
)
ARRIVAL = ("upload_seq", "row_no", "source_id", "description_text", "amount_text")


def _normalize(raw: DataFrame) -> DataFrame:
    raw_id = hashing.lineage_id(*[F.col(c) for c in ARRIVAL])
    records = raw.withColumns(
        {
            "id": raw_id,
            "raw_record_id": raw_id,
            "upload_id": F.concat(F.lit("upload-"), F.col("upload_seq").cast("string")),
        }
    )
    fields = {
        name: Cell.of_text(F.col(header))
        for name, header in vars(CONFIG.mapping).items()
        if header is not None
    }
    return normalize_fields(records, fields, CONFIG)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank-export rows, normalized."""
    return _normalize(spread(views.raw_bank(spark, sf_dir)))


_stored: dict[tuple[str, str], DataFrame] = {}


def forget() -> None:
    """Drop remembered tables, so the next use computes them again."""
    _stored.clear()


def _place(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str]:
    return f"{spark.sparkContext.applicationId}/{name}", sf_dir


def once(spark: SparkSession, sf_dir: str, name: str, build, key: str | None = None, **options) -> DataFrame:
    """A stage's table, written once per session and input folder.

    `build` gives the rows, or a list of their parts; further options are those of `store_parts`.
    """
    place = _place(spark, sf_dir, name)
    if place not in _stored:
        built = build()
        _stored[place] = store_parts(built if isinstance(built, list) else [built], name, key, lasting=True, **options)
    return _stored[place]


def lean(rows: DataFrame) -> DataFrame:
    """Rows without the columns that `whole` computes from the others: two thirds of the bytes."""
    return rows.drop(
        "raw_record_id", "upload_id", "fingerprint", "source_transaction_id", "source_id_key", "duplicate_of"
    )


def whole(rows: DataFrame) -> DataFrame:
    """Lean rows with all columns of normalized rows; what a reader does not ask for is not computed.

    An id is computed too where none is stored, for it does not compress.
    """
    if "id" not in rows.columns:
        rows = rows.withColumn("id", hashing.lineage_id(*[F.col(c) for c in ARRIVAL]))
    computed = rows.withColumns(
        {
            "raw_record_id": F.col("id"),
            "upload_id": F.concat(F.lit("upload-"), F.col("upload_seq").cast("string")),
            "source_transaction_id": text.optional_text(F.col("source_id")),
            "fingerprint": hashing.fingerprint(
                F.col("amount"), F.col("bank_key"), F.col("currency"), F.col("description_normalized"),
                F.col("transaction_date"),
            ),
            "duplicate_of": F.lit(None).cast("string"),
        }
    )
    return computed.withColumn("source_id_key", text.casefold(F.col("source_transaction_id")))


_PLACE, _PART = "place", "part"
# The last part of the transactions is shuffled while nearly all of them are written.
_FOLDERS = 2 * PARTS


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lean normalized rows without id in arrival order, each with its place in it as a number.

    Raw rows are sorted in ranges, so that only they are drawn on for the ranges, and normalized
    where they lie; neighbours are alike, which packs them well. `_PART`, by the id's hash, names the
    folder a row is to lie in: a part of the rows is read without the others.
    """
    raw = views.raw_bank(spark, sf_dir)
    dealt = raw.repartitionByRange(*ARRIVAL).sortWithinPartitions(*ARRIVAL)
    rows = lean(_normalize(dealt)).withColumn(_PART, part_of("id", _FOLDERS))
    return rows.drop("id").withColumn(_PLACE, F.monotonically_increasing_id())


def normalized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = once(spark, sf_dir, "normalized", lambda: _placed(spark, sf_dir), by=_PART)
    return whole(table).select(*normalized(spark, sf_dir).columns)


def _with_links(spark: SparkSession, placed: DataFrame, folder: str) -> list[DataFrame]:
    """Parts of the lean rows, each with the link to its canonical row, in arrival order inside a task.

    Ids travel as bytes. What the rounds wrote is removed before rows meet their canonical row.
    """
    rows = whole(placed).withColumn("id", F.unhex("id"))

    with scratch(spark):
        found = duplicates.resolve_in_parts(rows, _PLACE, _PART)
        resolution = store_parts(found, "resolution", path=f"{folder}/resolution", by=_PART)
    narrow = rows.select("id", *[c for c in placed.columns if c != _PLACE])
    sides = [[side.where(F.col(_PART) == i).drop(_PART) for side in (narrow, resolution)] for i in range(_FOLDERS)]
    parts = [duplicates.linked(*both) for both in sides]
    return [part.withColumn("id", F.lower(F.hex("id"))).sortWithinPartitions("upload_seq", "row_no") for part in parts]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored table of normalized rows with duplicates and conflicts marked.

    What was stored on the way is removed, each part as soon as it is written, but for a table of normalized
    rows that others read. The table holds the link; issues and status follow from it on reading.
    """
    columns = normalized(spark, sf_dir).columns

    def read(table: DataFrame) -> DataFrame:
        rows = whole(table).withColumn("canonical_id", F.lower(F.hex("canonical_id")))
        return duplicates.marked(rows).select(
            "id", *[c for c in columns if c not in ("id", "duplicate_of")], "match_kind", "canonical_upload", "duplicate_of"
        )

    with scratch(spark) as folder:

        def build() -> list[DataFrame]:
            placed = _stored.get(_place(spark, sf_dir, "normalized"))
            if placed is None:
                placed = store_parts([_placed(spark, sf_dir)], "normalized", path=f"{folder}/normalized", by=_PART)
            return _with_links(spark, placed, folder)

        def done(part: int) -> None:
            for name in ("normalized", "resolution"):
                remove(spark, f"{folder}/{name}/{_PART}={part}")

        return read(once(spark, sf_dir, "transactions", build, key="id", done=done))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.canonical(transactions(spark, sf_dir))
