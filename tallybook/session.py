"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tallybook", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on for its results."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Lists of keys up to this length reach the Parquet scan as they are, not as a range.
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
    # File contents travel to Python in batches: bound them by size, not only by rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tallybook-checkpoint-")
    sc.setCheckpointDir(shared)


def shared_dir(spark: SparkSession) -> str:
    """Folder reachable by every executor, for written intermediate tables."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the plan's history."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Set to a bucket count to keep the large keyed tables bucketed and sorted by id: joins of
# transactions, classifications and plans by id then need no shuffle on either side.
BUCKETS = "spark.tallybook.buckets"


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Stages stored inside the block lie in a folder of their own, which is removed at its end.

    For jobs that run again and again, such as the batches of a stream: what must outlast the
    block has to be written elsewhere inside it. Gives the folder's path.
    """
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


# Spark's setting that removes a job's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Spark's setting that lets a task write to so many folders at once, instead of sorting rows by folder.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def freed_shuffles(spark: SparkSession):
    """Writes inside the block leave no shuffle files behind.

    What was written is read back, so nobody asks for them again; they would otherwise fill the disk
    until the driver happens to collect garbage.
    """
    return _setting(spark, _CLEANUP, "true")


def table_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A folder of its own for a stored table: in the scratch block around, if any, unless it is `lasting`."""
    folder = None if lasting else _scratch.get()
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    return f"{folder or f'{shared_dir(spark)}/tables'}/{table}"


def store(df: DataFrame, name: str, key: str | None = None, lasting: bool = False) -> DataFrame:
    """Write a stage as a table in the shared folder and read it back.

    Later reads prune columns and push filters down to it, instead of repeating the stage. Ids are
    hex digits, which zstd packs to half. A `lasting` table outlives the scratch block around it.
    """
    return store_parts([df], name, key, lasting)


def store_parts(
    parts: Sequence[DataFrame], name: str, key: str | None = None, lasting: bool = False, path: str | None = None,
    by: str | None = None, done: Callable[[int], None] | None = None,
) -> DataFrame:
    """As `store`, for a table that is written part after part, so that one part's shuffle fills the disk at a time.

    `path` names the folder, else one is made up. `by` names a column of few values, at most 2 * PARTS: rows of
    each lie in a folder of their own, in the order given. `done` is told the number of a part once it is written.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = path or table_path(spark, name, lasting)
    buckets = spark.conf.get(BUCKETS, None)
    with freed_shuffles(spark), _setting(spark, _WRITERS, str(2 * PARTS) if by else spark.conf.get(_WRITERS)):
        if key is not None and buckets:
            table = path.rsplit("/", 1)[-1]
            keyed = reduce(DataFrame.unionByName, parts).repartition(int(buckets), key).write.option("compression", "zstd")
            keyed.bucketBy(int(buckets), key).sortBy(key).option("path", path).saveAsTable(table)
            return spark.table(table)
        for number, part in enumerate(parts):
            part.write.option("compression", "zstd").mode("append").parquet(path, partitionBy=by)
            if done is not None:
                done(number)
    return spark.read.schema(schema).parquet(path)


# Joins of whole tables are written in so many parts by key: the shuffle of one fills the disk at a time.
PARTS = 4


def in_parts(df: DataFrame, key: str, parts: int = PARTS) -> list[DataFrame]:
    """Rows by the hash of a key, for `store_parts`; a null key lies in a part like any other."""
    return [df.where(part_of(key, parts) == i) for i in range(parts)]


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


# Set to a partition count where a few large files cannot be split (say one row group each):
# rows are then spread over that many tasks before the costly parsing. Unset, the default,
# the scan's own partitions are kept and nothing is shuffled.
SPREAD = "spark.tallybook.spreadPartitions"


def spread(df: DataFrame) -> DataFrame:
    partitions = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(partitions)) if partitions else df


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows that each stand for much work, over as many tasks as a shuffle has and cores there are.

    A scan packs many of them into one task, for it goes by bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
