"""Idempotent foreachBatch sink and its latest-row reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonotable.storage import exists


def batch_log_writer(path: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    """foreachBatch function appending each micro-batch to ``path/batch_id=<id>`` (overwritten on replay)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch, batch_id) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "update",
                  transform: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Process everything available now, then stop."""
    q = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(batch_log_writer(path, transform))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def read_batch_log(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def latest_per_key(log: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key across micro-batches (update-mode output folded back to a table)."""
    cols = [c for c in log.columns if c not in keys and c != "batch_id"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def compact_batch_log(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Fold the update log into ``<path>_snapshot/upto=<last batch>`` and return that batch id.

    Readers (``read_latest``) then take the newest snapshot plus only the batches
    after it, so reading state no longer grows with the number of micro-batches.
    The snapshot is written under a new folder name, never over the one readers use.
    """
    log = read_batch_log(spark, path)
    upto = int(log.agg(F.max("batch_id")).first()[0])
    prev = _latest_snapshot(spark, path)
    base = log if prev is None else prev[1].unionByName(log.where(F.col("batch_id") > prev[0]))
    latest_per_key(base.where(F.col("batch_id") <= upto), keys).withColumn("batch_id", F.lit(upto)).write.mode(
        "overwrite").parquet(f"{path}_snapshot/upto={upto}")
    return upto


def _latest_snapshot(spark: SparkSession, path: str):
    if not exists(spark, f"{path}_snapshot"):
        return None
    snaps = spark.read.parquet(f"{path}_snapshot")
    upto = snaps.agg(F.max("upto")).first()[0]
    if upto is None:
        return None
    return int(upto), snaps.where(F.col("upto") == upto).drop("upto")


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest row per key: newest snapshot + batches after it."""
    log = read_batch_log(spark, path)
    snap = _latest_snapshot(spark, path)
    if snap is not None:
        log = snap[1].unionByName(log.where(F.col("batch_id") > snap[0]))
    return latest_per_key(log, keys)
