"""T2/T3 as streams: as streaming aggregations by the fold expressions of the batch job, and as state machines.

The aggregations keep one buffer per file in the state store and run no Python per event.
The state machines (``keyed.py``) keep one record per file; they can also say what no
aggregate can, such as the time since the previous event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonotable.functions import labels as L
from sonotable.functions import timefmt as TF
from sonotable.operators import state as ST
from sonotable.streaming.common import read_latest, run_available
from sonotable.streaming.keyed import file_states, stage_progress


def stream_file_state(spark: SparkSession, events: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Fold a stream of stage events into per-file state; returns the state table as of now."""
    agg = events.groupBy("file_id").agg(*ST.fold_aggregates(events))
    run_available(agg, out_path, checkpoint, "update")
    return ST.finish_fold(read_latest(spark, out_path, ["file_id"]))


def stream_progress(spark: SparkSession, events: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Newest stage message per file, kept by a streaming aggregation."""
    latest = events.where(F.col("action") == "stage").groupBy("file_id").agg(
        F.max_by(F.struct("stage", "us"), F.col("seq")).alias("_m")
    )
    run_available(latest, out_path, checkpoint, "update")
    t = read_latest(spark, out_path, ["file_id"])
    return t.select(
        "file_id",
        F.col("_m.stage").alias("stage"),
        L.stage_progress(F.col("_m.stage")).alias("progress"),
        TF.clock_text(F.col("_m.us")).alias("clock"),
    )


def stream_state_machine(spark: SparkSession, events: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Per-file state by arbitrary stateful processing: one record per file in the state store, whatever order events come in."""
    run_available(file_states(events), out_path, checkpoint, "update")
    return read_latest(spark, out_path, ["file_id"])


def stream_progress_elapsed(spark: SparkSession, events: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """``stream_progress`` with the time since the file's previous event, also if that came in an earlier micro-batch."""
    run_available(stage_progress(events), out_path, checkpoint, "update")
    return read_latest(spark, out_path, ["file_id"]).select(
        "file_id", "stage", L.stage_progress(F.col("stage")).alias("progress"), TF.clock_text(F.col("us")).alias("clock"), "elapsed_us")
