"""Per-file processing state as a fold over stage events, and what it drives.

Event actions: ``started`` (creates the record the first time; later resets
status to in_progress and clears the error, keeping stage, url and times),
``stage`` (sets the last finished stage, also backwards), ``completed`` (sets
status and completion time), ``failed`` (sets status and error). Events before
a file's first ``started`` are ignored.

The fold is one ``groupBy(file_id)`` of ``min_by``/``max_by`` aggregates, each
ordered only by the events that set its field, so it needs no sort, no window
and no join, and a hot file is combined map-side like any aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonotable import schemas as S
from sonotable.functions import labels as L
from sonotable.functions import timefmt as TF
from sonotable.operators.sequence import previous_values

STATUS_ACTIONS = ["started", "completed", "failed"]


def fold_aggregates(events: DataFrame) -> list:
    a, seq = F.col("action"), F.col("seq")
    when_seq = lambda cond: F.when(cond, seq)
    return [
        F.min(when_seq(a == "started")).alias("_first_start"),
        F.min_by(F.col("us"), when_seq(a == "started")).alias("started_us"),
        F.min_by(F.col("url"), when_seq(a == "started")).alias("url") if "url" in events.columns
        else F.lit(None).cast("string").alias("url"),
        F.max_by(a, when_seq(a.isin(*STATUS_ACTIONS))).alias("_last_status"),
        F.max(when_seq(a == "stage")).alias("_stage_seq"),
        F.max_by(F.col("stage"), when_seq(a == "stage")).alias("_stage"),
        F.max(when_seq(a == "completed")).alias("_done_seq"),
        F.max_by(F.col("us"), when_seq(a == "completed")).alias("_done_us"),
        F.max_by(F.when(a == "failed", F.col("error")), when_seq(a.isin("started", "failed"))).alias("error"),
    ]


def finish_fold(agg: DataFrame) -> DataFrame:
    first = F.col("_first_start")
    status = (
        F.when(F.col("_last_status") == "started", F.lit("in_progress"))
        .otherwise(F.col("_last_status"))
    )
    return agg.where(first.isNotNull()).select(
        "file_id",
        status.alias("status"),
        F.when(F.col("_stage_seq") > first, F.col("_stage")).alias("stage"),
        "url",
        F.col("started_us"),
        F.when(F.col("_done_seq") > first, F.col("_done_us")).alias("completed_us"),
        "error",
    )


def fold_state(events: DataFrame) -> DataFrame:
    """Stage events -> one state row per file (file_id, status, stage, url, started_us, completed_us, error)."""
    return finish_fold(events.groupBy("file_id").agg(*fold_aggregates(events)))


def state_as_records(state: DataFrame) -> DataFrame:
    """State rows with ISO-8601 time text, the exchanged record form."""
    return state.select(
        "file_id", "status", "stage", "url",
        TF.iso_text("started_us").alias("started_at"),
        TF.iso_text("completed_us").alias("completed_at"),
        "error",
    )


def status_counts(state: DataFrame) -> DataFrame:
    """Files per status; ``completed``, ``failed`` and ``in_progress`` are always present."""
    counted = state.groupBy(F.coalesce("status", F.lit("in_progress")).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zeros = state.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in STATUS_ACTIONS[1:] + ["in_progress"]])).alias("status"),
        F.lit(0).cast("long").alias("n"),
    )
    return counted.unionByName(zeros).groupBy("status").agg(F.sum("n").cast("long").alias("n_files"))


def batch_result(inputs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Run outcome over the deduplicated inputs: completed / failed / skipped, and ok = no failure."""
    b = before.select("file_id", F.col("status").alias("_before"))
    a = after.select("file_id", F.col("status").alias("_after"))
    j = inputs.select("file_id").distinct().join(b, "file_id", "left").join(a, "file_id", "left")
    skipped = F.coalesce(F.col("_before") == "completed", F.lit(False))
    done = F.coalesce(F.col("_after") == "completed", F.lit(False))
    res = j.agg(
        F.count_if(skipped).alias("skipped"),
        F.count_if(~skipped & done).alias("completed"),
        F.count_if(~skipped & ~done).alias("failed"),
    )
    return res.withColumn("ok", F.col("failed") == 0)


def remaining_inputs(inputs: DataFrame, state: DataFrame) -> DataFrame:
    """Inputs whose file is not completed yet (completed files are never re-read)."""
    done = state.where(F.col("status") == "completed").select("file_id")
    return inputs.join(done, "file_id", "left_anti")


def pending_stages(inputs: DataFrame, state: DataFrame) -> DataFrame:
    """(file_id, stage) for every stage that still has to run, in stage order.

    No record -> all; completed -> none; no stage yet -> all; else the stages
    after the last finished one (an unknown stage name -> all).
    """
    stages = F.array(*[F.lit(s) for s in S.STAGES])
    st = state.select("file_id", F.col("status").alias("_status"), F.col("stage").alias("_last"))
    j = inputs.select("file_id").distinct().join(st, "file_id", "left")
    last_pos = F.array_position(stages, F.coalesce(F.col("_last"), F.lit("")))
    j = j.select("file_id", "_status", "_last", last_pos.alias("_last_pos"), F.posexplode(stages).alias("_i", "stage"))
    run = (
        F.col("_status").isNull()
        | ((F.col("_status") != "completed") & (F.col("_last").isNull() | (F.col("_last_pos") == 0) | (F.col("_i") + 1 > F.col("_last_pos"))))
    )
    return j.where(run).select("file_id", F.col("_i").cast("long").alias("stage_pos"), "stage")


def _seq_slice() -> F.Column:
    """Slices of the event order of a file."""
    return F.floor(F.col("seq") / 100_000)


def stage_elapsed(events: DataFrame) -> DataFrame:
    """Time since the file's previous event, per event (null for the first)."""
    prev = previous_values(events.select("file_id", "seq", "us", "action", "stage"), "file_id", ["seq"], ["us"], _seq_slice())
    return prev.select("file_id", "seq", "action", "stage", (F.col("us") - F.col("prev_us")).alias("elapsed_us"))


def progress(events: DataFrame) -> DataFrame:
    """Newest stage message per file: stage, progress fraction, clock text."""
    latest = events.where(F.col("action") == "stage").groupBy("file_id").agg(
        F.max_by(F.struct("stage", "us"), F.col("seq")).alias("_m")
    )
    return latest.select(
        "file_id",
        F.col("_m.stage").alias("stage"),
        L.stage_progress(F.col("_m.stage")).alias("progress"),
        TF.clock_text(F.col("_m.us")).alias("clock"),
    )


def progress_elapsed(events: DataFrame) -> DataFrame:
    """``progress`` plus ``elapsed_us``: time from the file's previous event to its newest stage message."""
    prev = previous_values(events.select("file_id", "seq", "us", "action", "stage"), "file_id", ["seq"], ["us"], _seq_slice())
    latest = prev.where(F.col("action") == "stage").groupBy("file_id").agg(
        F.max_by(F.struct("stage", "us", (F.col("us") - F.col("prev_us")).alias("elapsed")), F.col("seq")).alias("_m")
    )
    return latest.select(
        "file_id",
        F.col("_m.stage").alias("stage"),
        L.stage_progress(F.col("_m.stage")).alias("progress"),
        TF.clock_text(F.col("_m.us")).alias("clock"),
        F.col("_m.elapsed").alias("elapsed_us"),
    )


def error_triage(events: DataFrame) -> DataFrame:
    return events.where(F.col("action") == "failed").select(
        "file_id", "seq", "error", L.classify_error("error").alias("category")
    )
