"""A keyed table that is appended to or updated: copy-on-write of hash buckets.

A run rewrites the buckets its keys fall into, each as a whole, under ``data/run=<n>``, and
then writes its commit: one row per bucket it has rewritten. The current copy of a bucket
is that of the last committed run which rewrote it, so readers list commits (at most one
row per bucket and run) and open one folder per bucket, never the runs before.

A run that is lost midway has no commit and is not seen; its replay overwrites its own
folders. A run that is committed already, or is older than one, changes nothing. One writer
at a time. The number of buckets is fixed by the first run: choose it so that a bucket
suits one task (its rows are written by one), as the table grows by keys and not by runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonotable.storage import read_table

BUCKET = "_bucket"
COMMIT_T = "bucket int, buckets int, schema string"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/_commits", f"{COMMIT_T}, run long")


def _newest(spark: SparkSession, root: str) -> tuple[dict[int, int], int, str | None, int]:
    """Bucket -> run of its current copy (at most one entry per bucket), buckets, schema, last run; -1 before the first."""
    rows = _commits(spark, root)
    # a commit without buckets (a run of no rows) has bucket -1
    found = rows.groupBy("bucket").agg(F.max("run").alias("run"), F.max_by(F.struct("buckets", "schema"), "run").alias("t")).collect()
    if not found:
        return {}, 0, None, -1
    last = max(found, key=lambda r: r["run"])
    return {r["bucket"]: r["run"] for r in found if r["bucket"] >= 0}, last["t"]["buckets"], last["t"]["schema"], last["run"]


def _copies(spark: SparkSession, root: str, at: dict[int, int], schema: str) -> DataFrame:
    paths = [f"{root}/data/run={run}/{BUCKET}={b}" for b, run in sorted(at.items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of every key. An empty frame without columns if nothing was ever written."""
    at, _, schema, _ = _newest(spark, root)
    return _copies(spark, root, at, schema) if schema else spark.createDataFrame([], "")


def upsert(rows: DataFrame, root: str, run: int, key: str, order: list[str], buckets: int = 64) -> bool:
    """Append or update: per ``key`` the row that is last by ``order`` stays, of those held and of ``rows``.

    Returns whether the run was written; false for a run that is not after all committed
    ones. Of rows equal in ``order`` the one with the greatest columns stays; a null key is
    a key like any other. ``rows`` need the same columns in every run.
    """
    spark = rows.sparkSession
    at, fixed, schema, last = _newest(spark, root)
    if run <= last:
        return False
    buckets = fixed or buckets
    cols = rows.columns
    if schema is not None and sorted(spark.createDataFrame([], schema).columns) != sorted(cols):
        raise ValueError(f"columns {sorted(cols)} are not those of the table")
    schema = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
    held = _copies(spark, root, {b: at[b] for b in touched if b in at}, schema)
    every = held.unionByName(rows)
    values = F.struct(*[F.col(c) for c in cols if c != key])
    newest = every.groupBy(key).agg(F.max_by(values, F.struct(*order, values)).alias("_r"))
    whole = newest.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in cols])
    path = f"{root}/data/run={run}"
    whole.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    _commit(spark, root, run, [(b, buckets, schema) for b in touched] or [(-1, buckets, schema)])
    return True


def _commit(spark: SparkSession, root: str, run: int, rows: list[tuple[int, int, str]]) -> None:
    spark.createDataFrame(rows, COMMIT_T).coalesce(1).write.mode("overwrite").parquet(f"{root}/_commits/run={run}")
