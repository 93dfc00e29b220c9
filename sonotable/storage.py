"""Tables and paths in whatever store Spark reads: existence is tested, never inferred from an error."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sonotable.session import scratch_path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) matches anything, by the Hadoop file system of the path.

    Errors of the store (permissions, network) rise; only a path that is not there is False.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, by the Hadoop file system of the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@contextmanager
def few_listing_tasks(spark: SparkSession, per_core: int = 8) -> Iterator[None]:
    """Frames made within list their folders by ``per_core`` tasks a core.

    Spark's own bound is 10,000: with a folder per file nearly each has a task of its own,
    which takes many times as long as its listing.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: else they stay on disk until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to a new folder of the shared scratch space and read back."""
    path = scratch_path(df.sparkSession, name)
    with exchanges_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table that may not have been written yet, or may hold no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
