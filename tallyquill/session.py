"""Session helpers: the shared folder, written intermediate tables and size-checked collects."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Tasks that list folders, for each core.
LISTING_PER_CORE = 4


class NotShared(Exception):
    """A cluster has no folder that all of its machines share."""


class TooLarge(Exception):
    """A side that was expected to be small exceeds its bound."""


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``, else a folder
    inside the warehouse. Each application has its own part of it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        named = spark.sparkContext.getConf().contains("spark.sql.warehouse.dir")
        if folder.startswith("file:") and not named and not spark.sparkContext.master.startswith("local"):
            raise NotShared("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{folder.rstrip('/')}/tallyquill-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``fresh_path`` named, or that lie in one of those, once nothing reads them any more."""
    Path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = Path(path)
        where.getFileSystem(conf).delete(where, True)


@contextmanager
def many_folders(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deals the folders it lists to a few tasks per core and not to a task for each of them. A stream of
    files lists them batch by batch, and so as long as it runs."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, min(int(before), LISTING_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def discard_all(spark: SparkSession) -> None:
    """Delete what this application has left in the shared folder."""
    discard(spark, shared_folder(spark))


def written(df: DataFrame, label: str, **options: object) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: lineage is cut, and a lost executor
    loses nothing. Shuffle files of the write are removed when it is done, not when the
    driver happens to collect its garbage. ``options`` are the writer's. Returns the table and its folder."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor loses no result."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded_table(df: DataFrame, limit: int) -> pa.Table:
    """Collect a side only when it has at most ``limit`` rows."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise TooLarge(f"more than {limit} rows")
    return rows
