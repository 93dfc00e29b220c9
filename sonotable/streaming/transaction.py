"""Tables that one run writes together and readers see all at once.

A run (a micro-batch) writes folders ``run=<number>`` of several tables, in any order, and
then one commit: a one-row table of its own folder. Readers take the runs that have a
commit. A run that is lost midway leaves folders without a commit; its replay overwrites
them under the same number, so nothing is seen twice and nothing half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonotable.storage import exists, read_table

COMMIT_T = "n_files long"


def _place(root: str) -> str:
    return f"{root}/_commits"


def is_committed(spark: SparkSession, root: str, run: int) -> bool:
    return exists(spark, f"{_place(root)}/run={run}/_SUCCESS")


def commit(spark: SparkSession, root: str, run: int, n_files: int) -> None:
    """Make what ``run`` has written visible. A second commit of one run changes nothing."""
    spark.range(1).select(F.lit(n_files).cast("long").alias("n_files")).coalesce(1).write.mode("overwrite").parquet(f"{_place(root)}/run={run}")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed run: run, n_files."""
    return read_table(spark, _place(root), f"{COMMIT_T}, run long").select("run", "n_files")


def visible(table: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of ``table`` (with its ``run`` column) that committed runs have written."""
    return table.join(commits.select("run"), "run", "left_semi")
