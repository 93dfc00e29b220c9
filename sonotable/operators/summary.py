"""Per-file summaries and display tables over a segments table.

All per-file statistics are plain ``groupBy(file_id)`` aggregates: Spark runs
them as partial (map-side) + final hash aggregation, so a file holding a large
share of all segments is combined on many tasks before its single final row.
Distinct-value work (speakers, languages, dominant labels) is bounded by the
label vocabulary per file, never by the segment count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonotable import schemas as S
from sonotable.functions import labels as L
from sonotable.functions import timefmt as TF


def num_speakers_expr(speaker: str = "speaker") -> Column:
    """Distinct speakers where a missing speaker counts as one more value."""
    return (F.count_distinct(F.col(speaker)) + F.max(F.col(speaker).isNull().cast("int"))).cast("long")


def languages_expr(language: str = "language") -> Column:
    """Sorted distinct real languages joined by ``,``; none -> ``unknown``."""
    real = L.is_label(language, drop=(S.TOO_SHORT, S.ERROR, S.UNKNOWN))
    joined = F.array_join(F.array_sort(F.collect_set(F.when(real, F.col(language)))), ",")
    return F.when(joined == "", F.lit(S.UNKNOWN)).otherwise(joined)


def audio_seconds() -> F.Column:
    """n_frames / sample_rate to 2 places, half up, in exact integers."""
    rate = F.col("sample_rate").cast("long")
    return F.floor((F.col("n_frames") * 200 + rate) / (rate * 2)).cast("long").cast("double") / F.lit(100.0)


def file_summary(segments: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """One row per file: num_speakers, num_segments, duration_sec, languages_detected.

    ``durations`` (file_id, n_frames, sample_rate) holds one row per file whose
    audio exists: duration = n_frames / sample_rate to 2 places (half up, exact
    integers); a row with unreadable facts falls back to the largest segment
    end; a file without a row (no audio) gets 0.0. Without ``durations`` every
    file takes the largest-segment-end fallback.
    """
    agg = segments.groupBy("file_id").agg(
        num_speakers_expr().alias("num_speakers"),
        F.count(F.lit(1)).alias("num_segments"),
        F.max("end_ms").alias("_max_end_ms"),
        languages_expr().alias("languages_detected"),
    )
    fallback = TF.round_ms_2(F.col("_max_end_ms"))
    if durations is not None:
        d = durations.select("file_id", "n_frames", "sample_rate", F.lit(True).alias("_has_audio"))
        agg = agg.join(d, "file_id", "left")
        dur = F.when(F.col("_has_audio").isNull(), F.lit(0.0)).when(F.col("sample_rate") > 0, audio_seconds()).otherwise(fallback)
        agg = agg.withColumn("duration_sec", dur)
    else:
        agg = agg.withColumn("duration_sec", fallback)
    return agg.select("file_id", "num_speakers", "num_segments", "duration_sec", "languages_detected")


def dominant_value(segments: DataFrame, col: str, drop=(S.TOO_SHORT, S.ERROR), name: str | None = None) -> DataFrame:
    """Most frequent real value of ``col`` per file; equal counts -> first seen.

    Counts per (file, value) are combined map-side; the pick is a ``max_by``
    over at most one row per distinct value.
    """
    name = name or f"dominant_{col}"
    counts = (
        segments.where(L.is_label(col, drop))
        .groupBy("file_id", col)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("segment_idx").alias("_first"))
    )
    return counts.groupBy("file_id").agg(
        F.max_by(F.col(col), F.struct(F.col("_n"), -F.col("_first"))).alias(name)
    )


def summary_metrics(segments: DataFrame, files: DataFrame | None = None, durations_ms: DataFrame | None = None) -> DataFrame:
    """Four display metrics per file: duration text, speakers, dominant language and emotion.

    ``files`` (file_id) keeps files without segments (``0:00``, 0, ``N/A``, ``N/A``);
    ``durations_ms`` (file_id, duration_ms) is the audio length, <= 0 or absent
    falling back to the largest segment end.
    """
    # one pass: a (kind, value) row per label, counted map-side, then one row per file
    labels = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("speaker", "emotion", "language")])
    rows = segments.select("file_id", "segment_idx", "end_ms", F.inline(labels))
    counts = rows.groupBy("file_id", "kind", "value").agg(
        F.count(F.lit(1)).alias("_n"), F.min("segment_idx").alias("_first"), F.max("end_ms").alias("_end"))

    def dominant(kind: str) -> F.Column:
        real = (F.col("kind") == kind) & L.is_label("value", (S.TOO_SHORT, S.ERROR))
        return F.max_by("value", F.when(real, F.struct(F.col("_n"), -F.col("_first")))).alias(f"dominant_{kind}")

    out = counts.groupBy("file_id").agg(
        F.count_if(F.col("kind") == "speaker").alias("num_speakers"), F.max("_end").alias("_max_end_ms"), dominant("emotion"), dominant("language"))
    if durations_ms is not None:
        out = out.join(durations_ms.select("file_id", "duration_ms"), "file_id", "left")
        dur = F.when(F.coalesce(F.col("duration_ms"), F.lit(0)) > 0, F.col("duration_ms")).otherwise(F.col("_max_end_ms"))
    else:
        dur = F.col("_max_end_ms")
    out = out.select(
        "file_id",
        TF.format_time(dur).alias("duration"),
        F.col("num_speakers"),
        F.coalesce("dominant_language", F.lit("N/A")).alias("dominant_language"),
        F.coalesce("dominant_emotion", F.lit("N/A")).alias("dominant_emotion"),
    )
    if files is not None:
        out = files.select("file_id").distinct().join(out, "file_id", "left").select(
            "file_id",
            F.coalesce("duration", F.lit("0:00")).alias("duration"),
            F.coalesce("num_speakers", F.lit(0).cast("long")).alias("num_speakers"),
            F.coalesce("dominant_language", F.lit("N/A")).alias("dominant_language"),
            F.coalesce("dominant_emotion", F.lit("N/A")).alias("dominant_emotion"),
        )
    return out


def stage_outcomes(segments: DataFrame) -> DataFrame:
    """Per file and enrichment stage: rows ok, skipped (too short) and errors."""
    def counts(col: str):
        return [
            F.count_if(F.col(col) == S.TOO_SHORT).alias(f"{col}_skipped"),
            F.count_if(F.col(col) == S.ERROR).alias(f"{col}_errors"),
        ]

    agg = segments.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n"), *counts("emotion"), *counts("language"))
    rows = F.array(*[
        F.struct(
            F.lit(stage).alias("stage"),
            (F.col("_n") - F.col(f"{col}_skipped") - F.col(f"{col}_errors")).alias("n_ok"),
            F.col(f"{col}_skipped").alias("n_skipped"),
            F.col(f"{col}_errors").alias("n_errors"),
        )
        for stage, col in (("emotion", "emotion"), ("language", "language"))
    ])
    return agg.select("file_id", F.inline(rows))


def diarization_stats(segments: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Segments and speakers per file; files without speech are flagged."""
    agg = segments.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("num_segments"), num_speakers_expr().alias("num_speakers")
    )
    if files is not None:
        agg = files.select("file_id").distinct().join(agg, "file_id", "left").select(
            "file_id",
            F.coalesce("num_segments", F.lit(0).cast("long")).alias("num_segments"),
            F.coalesce("num_speakers", F.lit(0).cast("long")).alias("num_speakers"),
        )
    return agg.withColumn("no_speech", F.col("num_segments") == 0)


def timeline_ticks(segments: DataFrame) -> DataFrame:
    """Axis ticks per file: n = min(floor(max_end/10 s) + 1, 20); n+1 ticks at i*max_end/n.

    ``tick_ms`` is floored to whole ms; ``label`` is whole seconds, ties to even.
    """
    last = segments.groupBy("file_id").agg(F.max("end_ms").alias("max_end_ms"))
    n = F.least(F.floor(F.col("max_end_ms") / 10000).cast("long") + 1, F.lit(20).cast("long"))
    t = last.select("file_id", "max_end_ms", n.alias("n")).select(
        "file_id", "max_end_ms", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("tick", "_i")
    )
    num = F.col("tick") * F.col("max_end_ms")
    return t.select(
        "file_id",
        F.col("tick").cast("long").alias("tick"),
        F.floor(num / F.col("n")).cast("long").alias("tick_ms"),
        F.concat(TF.half_even_div(num, F.col("n") * 1000).cast("string"), F.lit("s")).alias("label"),
    )


def segment_table(segments: DataFrame) -> DataFrame:
    """The 8 display columns of the segment table (plus keys)."""
    return segments.select(
        "file_id",
        "segment_idx",
        TF.format_time(F.coalesce("start_ms", F.lit(0))).alias("start_text"),
        TF.format_time(F.coalesce("end_ms", F.lit(0))).alias("end_text"),
        F.coalesce("speaker", F.lit(S.UNKNOWN_SPEAKER)).alias("speaker"),
        TF.round_ms_2(F.coalesce("end_ms", F.lit(0)) - F.coalesce("start_ms", F.lit(0))).alias("duration_s"),
        F.coalesce("emotion", F.lit(S.UNKNOWN)).alias("emotion"),
        TF.format_confidence(F.coalesce("emotion_confidence", F.lit(0.0))).alias("confidence_pct"),
        F.coalesce("language", F.lit(S.UNKNOWN)).alias("language"),
        TF.format_confidence(F.coalesce("language_confidence", F.lit(0.0))).alias("lang_confidence_pct"),
    )


def timeline_rows(segments: DataFrame) -> DataFrame:
    """Speaker timeline rows coloured by emotion."""
    start, end = F.coalesce("start_ms", F.lit(0)), F.coalesce("end_ms", F.lit(0))
    emotion = F.coalesce("emotion", F.lit(S.UNKNOWN))
    return segments.select(
        "file_id",
        "segment_idx",
        F.coalesce("speaker", F.lit(S.UNKNOWN_SPEAKER)).alias("speaker"),
        TF.ms_to_seconds(start).alias("start"),
        TF.ms_to_seconds(end).alias("end"),
        TF.ms_to_seconds(end - start).alias("duration"),
        emotion.alias("emotion"),
        F.coalesce("language", F.lit("?")).alias("language"),
        TF.format_confidence(F.coalesce("emotion_confidence", F.lit(0.0))).alias("emotion_conf"),
        TF.format_confidence(F.coalesce("language_confidence", F.lit(0.0))).alias("lang_conf"),
        L.emotion_color(emotion).alias("color"),
    )
