"""Keyed state across micro-batches: first rows, the per-file state machine, time since the previous event.

Each operator keeps one small row per key in the state store, so a micro-batch reads its own
input and the state of its own keys, never earlier output. The functions get the rows of one
key and one micro-batch in Arrow chunks; what a trigger takes (``maxFilesPerTrigger``,
``maxBytesPerTrigger``) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _nullable(x):
    return None if x is None or x is pd.NaT or x != x else x


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key no earlier micro-batch had, one per key: the first by ``order``.

    Null keys are one key. Streaming only; the state is one flag per key.
    """
    columns = rows.columns

    def first(keys, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for pdf in chunks:
            if len(pdf):
                low = pdf.sort_values(order, na_position="first", kind="stable").iloc[:1]
                best = low if best is None else pd.concat([best, low]).sort_values(order, na_position="first", kind="stable").iloc[:1]
        if best is not None:
            state.update((True,))
            yield best[columns]

    return rows.groupBy(key).applyInPandasWithState(first, rows.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


STATE_T = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("started_us", T.LongType()), T.StructField("completed_us", T.LongType()),
    T.StructField("error", T.StringType())])

#: What a file's state is made of: each field beside the number of the event that set it.
RECORD_T = ("start_seq long, started_us long, url string, status_seq long, status string, stage_seq long, stage string, "
            "done_seq long, done_us long, error_seq long, error string")


class Record:
    """State machine of one file. Events may come in any order: of two that set a field the one with the higher number holds.

    The first ``started`` makes the record, and nothing counts that came before it. Later
    ones set the status and clear the error; ``stage`` sets the stage, also backwards;
    ``completed`` the status and the time; ``failed`` the status and the error.
    """

    NAMES = [c.split()[0] for c in RECORD_T.split(", ")]

    def __init__(self, values: tuple | None = None):
        for name, value in zip(self.NAMES, values or [None] * len(self.NAMES)):
            setattr(self, name, value)

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in self.NAMES)

    def _put(self, what: str, seq: int, **fields) -> None:
        at = getattr(self, f"{what}_seq")
        if at is None or seq > at:
            setattr(self, f"{what}_seq", seq)
            for name, value in fields.items():
                setattr(self, name, value)

    def take(self, seq: int, us, action: str, stage, error, url) -> None:
        if action == "started":
            if self.start_seq is None or seq < self.start_seq:
                self.start_seq, self.started_us, self.url = seq, us, url
            self._put("status", seq, status="in_progress")
            self._put("error", seq, error=None)
        elif action == "stage":
            self._put("stage", seq, stage=stage)
        elif action == "completed":
            self._put("status", seq, status="completed")
            self._put("done", seq, done_us=us)
        elif action == "failed":
            self._put("status", seq, status="failed")
            self._put("error", seq, error=error)

    def row(self, file_id) -> tuple | None:
        """The state row, or None while the file has not started."""
        if self.start_seq is None:
            return None
        after = lambda seq: seq is not None and seq > self.start_seq
        return (file_id, self.status, self.stage if after(self.stage_seq) else None, self.url, self.started_us,
                self.done_us if after(self.done_seq) else None, self.error)


def _columns(pdf: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return zip(*[[_nullable(x) for x in pdf[n].tolist()] for n in names])


EVENT = ["seq", "us", "action", "stage", "error", "url"]


def file_states(events: DataFrame) -> DataFrame:
    """Stream of stage events -> update stream of state rows (file_id, status, stage, url, started_us, completed_us, error)."""
    if "url" not in events.columns:
        events = events.withColumn("url", F.lit(None).cast("string"))

    def fold(keys, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record = Record(tuple(map(_nullable, state.get)) if state.exists else None)
        for pdf in chunks:
            for event in _columns(pdf, EVENT):
                record.take(*event)
        state.update(record.values())
        row = record.row(keys[0])
        if row is not None:
            out = pd.DataFrame([row], columns=STATE_T.names)
            yield out.astype({"started_us": "Int64", "completed_us": "Int64"})

    return events.select("file_id", *EVENT).groupBy("file_id").applyInPandasWithState(fold, STATE_T, RECORD_T, "update", GroupStateTimeout.NoTimeout)


PROGRESS_T = "file_id string, stage string, us long, elapsed_us long"
NEWEST_T = "seq long, us long, stage string, stage_us long, elapsed_us long"


def stage_progress(events: DataFrame) -> DataFrame:
    """Stream of stage events -> update stream of every file's newest stage message and the time since its previous event.

    The previous event may have come in an earlier micro-batch: its time is the state. A
    file's events are expected in order over micro-batches; one that is older than the
    newest known is late and changes nothing.
    """

    def newest(keys, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, us, stage, stage_us, elapsed = map(_nullable, state.get) if state.exists else (None,) * 5
        told = False
        parts = [pdf for pdf in chunks if len(pdf)]
        if not parts:
            return
        for s, t, action, name in _columns(pd.concat(parts).sort_values("seq", kind="stable"), ["seq", "us", "action", "stage"]):
            if seq is not None and s <= seq:
                continue
            if action == "stage":
                stage, stage_us, elapsed, told = name, t, None if us is None or t is None else t - us, True
            seq, us = s, t
        state.update((seq, us, stage, stage_us, elapsed))
        if told:
            out = pd.DataFrame([(keys[0], stage, stage_us, elapsed)], columns=["file_id", "stage", "us", "elapsed_us"])
            yield out.astype({"us": "Int64", "elapsed_us": "Int64"})

    return events.select("file_id", "seq", "us", "action", "stage").groupBy("file_id").applyInPandasWithState(
        newest, PROGRESS_T, NEWEST_T, "update", GroupStateTimeout.NoTimeout)
