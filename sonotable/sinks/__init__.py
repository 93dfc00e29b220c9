"""Writers for the exchanged file forms.

The canonical store is one parquet table per stage keyed by ``file_id``; the
per-file folders written here are exports. Rows are range-partitioned on
``(file_id, position)`` so one large file is written by many tasks as ordered
part files (part names sort in range order), and no file is ever collected
into a single row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonotable import schemas as S
from sonotable.functions import rttm as R
from sonotable.functions import timefmt as TF
from sonotable.operators.summary import segment_table


def rttm_lines(segments: DataFrame) -> DataFrame:
    """(file_id, segment_idx, line) in RTTM layout."""
    return segments.select(
        "file_id", "segment_idx", R.format_line("file_id", "start_ms", "end_ms", "speaker").alias("line")
    )


def _ordered_export(df: DataFrame, order: str, path: str, num_partitions: int | None = None, keep_others: bool = False) -> None:
    """Write ordered lines into ``file_id=<id>`` folders.

    ``keep_others``: replace only the folders of the files being written
    (dynamic partition overwrite), leaving other files' exports in place.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = (
        df.repartitionByRange(n, "file_id", order)
        .sortWithinPartitions("file_id", order)
        .select("file_id", "line")
        .write.mode("overwrite")
    )
    if keep_others:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("file_id").text(path)


def write_rttm(segments: DataFrame, path: str, files: DataFrame | None = None, keep_others: bool = False) -> None:
    """One folder per file of RTTM lines in segment order; a file without segments gets an empty line."""
    lines = rttm_lines(segments)
    if files is not None:
        empty = files.select("file_id").distinct().join(segments.select("file_id").distinct(), "file_id", "left_anti")
        lines = lines.unionByName(empty.select("file_id", F.lit(-1).cast("long").alias("segment_idx"), F.lit("").alias("line")))
    _ordered_export(lines, "segment_idx", path, keep_others=keep_others)


def annotation_record(segments: DataFrame) -> "F.Column":
    """JSON text of one annotation record: fixed key order, defaults for absent values."""
    vals = {
        "speaker": F.coalesce("speaker", F.lit(S.UNKNOWN_SPEAKER)),
        "start": F.coalesce(TF.ms_to_seconds("start_ms"), F.lit(0.0)),
        "end": F.coalesce(TF.ms_to_seconds("end_ms"), F.lit(0.0)),
        "emotion": F.coalesce("emotion", F.lit(S.UNKNOWN)),
        "emotion_confidence": F.coalesce("emotion_confidence", F.lit(0.0)),
        "language": F.coalesce("language", F.lit(S.UNKNOWN)),
        "language_confidence": F.coalesce("language_confidence", F.lit(0.0)),
    }
    return F.to_json(F.struct(*[vals[k].alias(k) for k, _ in S.ANNOTATION_DEFAULTS]))


def annotation_lines(segments: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A JSON array per file as ordered lines (file_id, line_idx, line).

    Element ``i`` is ``[`` or ``,`` + record; a closing ``]`` line (line_idx =
    segment count) comes from a per-file count, so no file is gathered into a
    row. Files without segments (``files`` minus segment files) get ``[]``.
    """
    first = F.col("segment_idx") == 0
    elems = segments.select(
        "file_id",
        F.col("segment_idx").alias("line_idx"),
        F.concat(F.when(first, F.lit("[")).otherwise(F.lit(",")), annotation_record(segments)).alias("line"),
    )
    closers = segments.groupBy("file_id").agg(F.count(F.lit(1)).alias("line_idx")).select(
        "file_id", "line_idx", F.lit("]").alias("line")
    )
    out = elems.unionByName(closers)
    if files is not None:
        empty = files.select("file_id").distinct().join(segments.select("file_id").distinct(), "file_id", "left_anti")
        out = out.unionByName(empty.select("file_id", F.lit(-1).cast("long").alias("line_idx"), F.lit("[]").alias("line")))
    return out


def write_annotations(segments: DataFrame, path: str, files: DataFrame | None = None, keep_others: bool = False) -> None:
    """Export one JSON array per file (folder ``file_id=<id>``, parts in order)."""
    _ordered_export(annotation_lines(segments, files), "line_idx", path, keep_others=keep_others)


def append_manifest(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append manifest rows (CSV with header per part); readers take the latest row per file."""
    from sonotable.functions.timefmt import iso_text

    out = rows
    if "processed_us" in rows.columns:
        out = rows.withColumn("processed_at", iso_text("processed_us"))
    out.select(*S.MANIFEST_COLUMNS).write.mode(mode).option("header", True).csv(path)


def write_segment_csv(segments: DataFrame, path: str, num_partitions: int | None = None) -> None:
    """The display table as CSV with the display headers, one folder per file, rows in segment order."""
    t = segment_table(segments)
    cols = ["start_text", "end_text", "speaker", "duration_s", "emotion", "confidence_pct", "language", "lang_confidence_pct"]
    shown = t.select("file_id", "segment_idx", *[F.col(c).alias(h) for c, h in zip(cols, S.DISPLAY_HEADERS)])
    n = num_partitions or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        shown.repartitionByRange(n, "file_id", "segment_idx")
        .sortWithinPartitions("file_id", "segment_idx")
        .drop("segment_idx")
        .write.mode("overwrite").option("header", True).partitionBy("file_id").csv(path)
    )


def write_file_state(state: DataFrame, path: str) -> None:
    """State snapshot as a parquet table (the resumable form)."""
    state.write.mode("overwrite").parquet(path)


def file_state_json(state: DataFrame) -> DataFrame:
    """State as JSON text, one ``{file_id: record}`` object per line (no grouping).

    Concatenating the objects gives the single snapshot object; the reader
    accepts both forms.
    """
    from sonotable.operators.state import state_as_records

    rec = state_as_records(state)
    body = F.struct("status", "stage", "url", "started_at", "completed_at", "error")
    return rec.select(F.to_json(F.create_map(F.col("file_id"), body)).alias("json"))
