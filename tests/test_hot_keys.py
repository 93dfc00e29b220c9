"""One file holding a third of all rows: results stay exact and the work is split."""

from __future__ import annotations

import json
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonotable import sinks as K
from sonotable.operators import sequence as SQ
from sonotable.operators import state as ST
from sonotable.operators import summary as SM

N = 30000


def _segments(spark):
    # file "hot" has every third row; 2000 other files share the rest
    base = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("f%05d", F.col("id") % 2000)).alias("file_id"),
        F.col("id"),
    )
    segs = SQ.positional_index(base, "file_id", ["id"], F.floor(F.col("id") / 5000), "segment_idx")
    return segs.select(
        "file_id", "segment_idx",
        F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("speaker"),
        (F.col("segment_idx") * 1000).alias("start_ms"),
        (F.col("segment_idx") * 1000 + 700).alias("end_ms"),
        F.element_at(F.array(*[F.lit(x) for x in ["neutral", "happy", "too_short", "sad"]]), (F.col("id") % 4 + 1).cast("int")).alias("emotion"),
        F.lit(0.5).alias("emotion_confidence"),
        F.element_at(F.array(*[F.lit(x) for x in ["en", "hi", "unknown", "ta", "error"]]), (F.col("id") % 5 + 1).cast("int")).alias("language"),
        F.lit(0.5).alias("language_confidence"),
        "id",
    )


def test_hot_file_is_cut_into_slices(spark):
    base = spark.range(N).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("x")).alias("k"), "id")
    plan = SQ.positional_index(base, "k", ["id"], F.floor(F.col("id") / 5000))._jdf.queryExecution().executedPlan().toString()
    # rows are dealt by key and slice, and only the one-row-per-slice counts by key alone
    assert "hashpartitioning(k" in plan and "_slice" in plan.split("hashpartitioning(k", 1)[1].split("\n")[0]
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan


def test_hot_file_index_and_summaries_exact(spark):
    segs = _segments(spark)
    ref = segs.withColumn("ref", F.row_number().over(Window.partitionBy("file_id").orderBy("id")) - 1)
    assert ref.where("segment_idx <> ref").count() == 0
    pdf = segs.where("file_id = 'hot'").toPandas().sort_values("segment_idx")
    s = SM.file_summary(segs).where("file_id = 'hot'").first()
    assert s.num_segments == N // 3 and s.num_speakers == pdf["speaker"].nunique()
    assert s.languages_detected == ",".join(sorted(set(pdf["language"]) - {"unknown", "error", "too_short"}))
    real = pdf[~pdf["emotion"].isin(["too_short", "error"])]
    counts = real.groupby("emotion").agg(n=("segment_idx", "size"), first=("segment_idx", "min")).reset_index()
    best = counts.sort_values(["n", "first"], ascending=[False, True]).iloc[0]["emotion"]
    assert SM.dominant_value(segs, "emotion").where("file_id = 'hot'").first().dominant_emotion == best


def test_hot_file_fold_and_lag(spark):
    ev = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("f%04d", F.col("id") % 500)).alias("file_id"),
        F.col("id").alias("seq"), (F.col("id") * 10).alias("us"),
        F.element_at(F.array(*[F.lit(a) for a in ["started", "stage", "stage", "failed", "completed", "stage"]]),
                     ((F.col("id") / 3).cast("long") % 6 + 1).cast("int")).alias("action"),
        F.when((F.col("id") / 3).cast("long") % 6 == 1, F.lit("diarize"))
        .when((F.col("id") / 3).cast("long") % 6 == 2, F.lit("emotion"))
        .when((F.col("id") / 3).cast("long") % 6 == 5, F.lit("language")).alias("stage"),
        F.when((F.col("id") / 3).cast("long") % 6 == 3, F.format_string("e%d", F.col("id"))).alias("error"),
    )
    hot = ST.fold_state(ev).where("file_id = 'hot'").first()
    rows = sorted((r.asDict() for r in ev.where("file_id = 'hot'").collect()), key=lambda r: r["seq"])
    last_status = [r for r in rows if r["action"] in ("started", "completed", "failed")][-1]["action"]
    assert hot.status == {"started": "in_progress"}.get(last_status, last_status)
    assert hot.stage == [r for r in rows if r["action"] == "stage"][-1]["stage"]
    lag = SQ.previous_values(ev, "file_id", ["seq"], ["us"], F.floor(F.col("seq") / 5000))
    ref = ev.withColumn("ref", F.lag("us").over(Window.partitionBy("file_id").orderBy("seq")))
    bad = lag.join(ref.select("seq", "ref"), "seq").where("NOT (prev_us <=> ref)")
    assert bad.count() == 0


def test_hot_file_json_export_is_split_and_valid(spark, tmpdir_new):
    segs = _segments(spark).drop("id")
    out = os.path.join(tmpdir_new, "ann")
    K._ordered_export(K.annotation_lines(segs), "line_idx", out, num_partitions=12)
    folder = os.path.join(out, "file_id=hot")
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    assert len(parts) > 1  # the hot file was written by several tasks
    arr = json.loads("".join(open(os.path.join(folder, f)).read() for f in parts))
    assert len(arr) == N // 3 and arr[0]["start"] == 0.0 and arr[-1]["start"] == float(N // 3 - 1)


def test_long_recording_normalised_across_tasks(spark):
    import math
    import tempfile
    import wave

    import numpy as np

    from sonotable.operators import audio as AU

    d = tempfile.mkdtemp(prefix="sonotable-long-")
    for name, secs in (("long", 300), ("a", 20), ("b", 25)):
        t = np.arange(int(8000 * secs)) / 8000
        x = (np.sin(2 * math.pi * 180 * t) * 9000).astype("<i2")
        with wave.open(os.path.join(d, f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(x.tobytes())
    files = AU.read_audio(spark, d).select("file_id", "path")
    frames, _ = AU.normalise_wav_files(files, target_rate=16000, chunk_s=20)
    tagged = AU.normalised_parts(files, target_rate=16000, chunk_s=20).withColumn("task", F.spark_partition_id())
    tasks = tagged.where("file_id = 'long'").select("task").distinct().count()
    assert tasks >= 4  # the long file's chunks are decoded by several tasks
    whole, _ = AU.normalise_pcm(AU.read_audio(spark, d, with_content=True), target_rate=16000)
    a = {(r.file_id, r.frame_idx): bytes(r.pcm) for r in whole.collect()}
    b = {(r.file_id, r.frame_idx): bytes(r.pcm) for r in frames.collect()}
    assert a == b and sum(1 for k in b if k[0] == "long") == 300
