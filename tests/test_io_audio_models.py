"""Interchange files, WAV handling, inference operators and streams, on files made in fresh temp folders."""

from __future__ import annotations

import json
import math
import os
import tempfile
import wave

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001, SF01
from sonotable import sinks as K
from sonotable.operators import audio as AU
from sonotable.operators import infer as IF
from sonotable.operators import segments as SG
from sonotable.plans import fixtures as FX
from sonotable.plans import stubs
from sonotable.sources import interchange as IO


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_read_inputs_file(spark, tmpdir_new):
    p = os.path.join(tmpdir_new, "urls.txt")
    _write(p, "# header\nhttps://www.youtube.com/watch?v=sZ3g5gLj5GE\n\n  \n/data/x.wav\n#https://youtu.be/zzz\n")
    rows = IO.read_inputs(spark, p).orderBy("line_no").collect()
    assert [(r.line_no, r.file_id, r.is_url) for r in rows] == [(1, "sZ3g5gLj5GE", True), (4, "x", False)]


def test_rttm_write_read_roundtrip(spark, tmpdir_new):
    segs = FX.segments(spark, SF001)
    out = os.path.join(tmpdir_new, "rttm")
    K.write_rttm(segs, out)
    folders = [f for f in os.listdir(out) if f.startswith("file_id=")]
    assert len(folders) == segs.select("file_id").distinct().count()
    back, rejects = IO.read_rttm(spark, out + "/*/*.txt")
    assert rejects.count() == 0
    a = back.select("file_id", "start_ms", "end_ms").exceptAll(segs.select("file_id", "start_ms", "end_ms"))
    assert back.count() == segs.count() and a.count() == 0


def test_rttm_bad_lines_are_rejects(spark, tmpdir_new):
    p = os.path.join(tmpdir_new, "a.rttm")
    _write(p, "SPEAKER a 1 0.5 1.0 <NA> <NA> S0 <NA> <NA>\nSPEAKER a 1 1.5d 1.0 <NA> <NA> S0 <NA> <NA>\n"
              "SPEAKER a 1 2.0 1.0 <NA> <NA>\nSPEAKER a 1 3.0 0.25 <NA> <NA> S1 <NA> <NA>\n")
    good, bad = IO.read_rttm(spark, p)
    assert [(r.start_ms, r.end_ms, r.speaker) for r in good.orderBy("segment_idx").collect()] == [(500, 1500, "S0"), (3000, 3250, "S1")]
    assert bad.count() == 1


def test_annotation_json_write_is_valid_json(spark, tmpdir_new):
    segs = FX.segments(spark, SF001)
    files = segs.select("file_id").distinct().unionByName(spark.createDataFrame([("nospeech",)], "file_id string"))
    out = os.path.join(tmpdir_new, "ann")
    K.write_annotations(segs, out, files)
    folder = os.path.join(out, "file_id=f000001")
    text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    arr = json.loads(text)
    n = segs.where("file_id = 'f000001'").count()
    assert len(arr) == n and list(arr[0]) == ["speaker", "start", "end", "emotion", "emotion_confidence", "language", "language_confidence"]
    empty = os.path.join(out, "file_id=nospeech")
    assert json.loads("".join(open(os.path.join(empty, f)).read() for f in os.listdir(empty) if f.startswith("part-"))) == []


def test_read_annotations_guards(spark, tmpdir_new):
    _write(os.path.join(tmpdir_new, "ok.json"), json.dumps([{"speaker": "S", "start": 0.5, "end": 1.25}, {"start": 2.0, "end": 3.0}], indent=2))
    _write(os.path.join(tmpdir_new, "empty.json"), "[]")
    _write(os.path.join(tmpdir_new, "obj.json"), json.dumps({"speaker": "S"}))
    _write(os.path.join(tmpdir_new, "trunc.json"), '[{"speaker": "S", ')
    segs, rejects = IO.read_annotations(spark, tmpdir_new + "/*.json")
    rows = segs.orderBy("segment_idx").collect()
    assert [(r.file_id, r.start_ms, r.end_ms, r.speaker) for r in rows] == [("ok", 500, 1250, "S"), ("ok", 2000, 3000, None)]
    assert sorted(r.file_id for r in rejects.collect()) == ["obj", "trunc"]
    norm = SG.normalise(segs).orderBy("segment_idx").collect()
    assert norm[1].speaker == "UNKNOWN" and norm[1].emotion == "unknown" and norm[1].language_confidence == 0.0


def test_manifest_append_and_read(spark, tmpdir_new):
    from sonotable.operators import manifest as MF

    rows = spark.createDataFrame(
        [("a", "u", "failed", 0, 0, 0.0, "unknown", 1704067200000000, 1), ("a", "u", "completed", 2, 5, 12.5, "en", 1704067300000000, 2)],
        "file_id string, url string, status string, num_speakers long, num_segments long, duration_sec double, "
        "languages_detected string, processed_us long, append_seq long",
    )
    out = os.path.join(tmpdir_new, "manifest")
    K.append_manifest(rows.limit(1), out)
    K.append_manifest(rows, out)
    back = IO.read_manifest(spark, out)
    assert back.count() == 3 and back.where("processed_at IS NULL").count() == 0
    latest = MF.latest_manifest(rows).first()
    assert latest.status == "completed"


def test_state_json_roundtrip(spark, tmpdir_new):
    from sonotable.operators import state as ST

    st = ST.fold_state(FX.stage_log(spark, SF001))
    js = K.file_state_json(st)
    out = os.path.join(tmpdir_new, "state")
    js.select("json").write.text(out)
    back = IO.read_file_state(spark, out)
    assert back.count() == st.count()
    _write(os.path.join(tmpdir_new, "corrupt.json"), "{not json")
    assert IO.read_file_state(spark, os.path.join(tmpdir_new, "corrupt.json")).count() == 0


def _wav(path, rate, channels, seconds, freq=220.0):
    n = int(rate * seconds)
    t = np.arange(n) / rate
    x = (np.sin(2 * math.pi * freq * t) * 8000).astype("<i2")
    data = np.repeat(x[:, None], channels, axis=1).reshape(-1)
    with wave.open(path, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(data.tobytes())


def _wav_folder():
    d = tempfile.mkdtemp(prefix="sonotable-wav-")
    _wav(os.path.join(d, "good.wav"), 16000, 1, 2.0)
    _wav(os.path.join(d, "stereo44.wav"), 44100, 2, 1.5)
    _wav(os.path.join(d, "rate8k.wav"), 8000, 1, 2.0)
    _wav(os.path.join(d, "short.wav"), 16000, 1, 0.5)
    _wav(os.path.join(d, "long.wav"), 16000, 1, 31.0)
    with open(os.path.join(d, "junk.wav"), "wb") as fh:
        fh.write(b"\x00\x01\x02\x03")
    return d


def test_headers_validation_and_normalise(spark):
    d = _wav_folder()
    files = AU.read_audio(spark, d)
    v = {r.file_id: r for r in AU.validate_audio(AU.audio_headers(files)).collect()}
    assert v["good"].valid and v["good"].warnings == ["short_audio"]
    assert v["long"].valid and v["long"].warnings == []
    assert v["rate8k"].problems == ["sample_rate"]
    assert set(v["stereo44"].problems) == {"sample_rate", "channels"}
    assert v["short"].problems == ["too_short"]
    assert v["junk"].problems == ["unreadable"] and v["junk"].sample_rate is None
    content = AU.read_audio(spark, d, with_content=True)
    frames, rejects = AU.normalise_pcm(content, target_rate=16000)
    per = {r.file_id: r for r in frames.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.length("pcm") / 2).cast("long").alias("s")).collect()}
    assert per["stereo44"].s == int(1.5 * 44100) * 16000 // 44100 and per["stereo44"].n == 2
    assert per["good"].s == 32000 and per["long"].n == 31
    assert [r.file_id for r in rejects.collect()] == ["junk"]
    todo = AU.todo_audio(spark.createDataFrame([("good",), ("rate8k",), ("new",)], "file_id string"),
                         AU.validate_audio(AU.audio_headers(files)))
    assert sorted(r.file_id for r in todo.collect()) == ["new", "rate8k"]


def test_slice_segments_equals_python(spark):
    import numpy as np

    frames = spark.createDataFrame(
        [("a", i, np.arange(i * 100, i * 100 + 100, dtype="<i2").tobytes()) for i in range(5)],
        "file_id string, frame_idx long, pcm binary",
    )
    segs = spark.createDataFrame([("a", 0, 250, 1999), ("a", 1, 990, 1010), ("a", 2, 4000, 4600)], "file_id string, segment_idx long, start_ms long, end_ms long")
    got = {r.segment_idx: AU.place_parts(r.samples, r.offsets).tolist() for r in AU.gather_segments(AU.slice_segments(segs, frames, rate=100)).collect()}
    allv = list(range(500))
    exp = {i: [allv[g] for g in range(500) if s <= g * 10 < e] for i, s, e in [(0, 250, 1999), (1, 990, 1010), (2, 4000, 4600)]}
    assert got == exp
    capped = {r.segment_idx: len(AU.place_parts(r.samples, r.offsets)) for r in AU.gather_segments(AU.slice_segments(segs, frames, 100, max_ms=300)).collect()}
    assert capped[0] == 30
    # a missing frame inside a segment is silence at its place, not a shift
    holes = frames.where("frame_idx <> 1")
    long_seg = spark.createDataFrame([("a", 9, 250, 2999)], "file_id string, segment_idx long, start_ms long, end_ms long")
    r = AU.gather_segments(AU.slice_segments(long_seg, holes, rate=100)).first()
    placed = AU.place_parts(r.samples, r.offsets).tolist()
    assert placed == [0 if 100 <= g < 200 else g for g in range(25, 300)]


def test_inference_error_isolation_and_gate(spark):
    frames = FX.frames(spark, SF001)
    segs = FX.segments(spark, SF001).select("file_id", "segment_idx", "speaker", "start_ms", "end_ms")
    out = IF.classify_emotion(segs, frames, stubs.failing_scores, rate=FX.FRAME_SAMPLES, batch_size=8)
    rows = out.collect()
    assert len(rows) == segs.count()
    by = {}
    for r in rows:
        by.setdefault(r.emotion, 0)
        by[r.emotion] += 1
    assert by.get("error", 0) > 0 and by.get("too_short", 0) > 0 and sum(by.values()) == len(rows)
    short = {(r.file_id, r.segment_idx) for r in segs.where("end_ms - start_ms < 500").collect()}
    assert all(r.emotion == "too_short" and r.emotion_confidence == 0.0 for r in rows if (r.file_id, r.segment_idx) in short)
    lang = IF.detect_language(segs, frames, stubs.energy_probs, rate=FX.FRAME_SAMPLES)
    assert lang.where("language NOT IN ('en','hi','ta','fr','too_short')").count() == 0


def test_diarize_windows(spark):
    frames = FX.frames(spark, SF001)
    segs, errors = IF.diarize(frames, stubs.fixed_turns, rate=FX.FRAME_SAMPLES, window_s=60)
    assert errors.count() == 0
    r = segs.where("file_id = 'f000001'").orderBy("segment_idx").collect()
    assert r[0].start_ms == 0 and all(a.end_ms <= b.start_ms for a, b in zip(r, r[1:]))
    assert [x.segment_idx for x in r] == list(range(len(r)))


def test_streams_rerun_process_nothing(spark, tmpdir_new):
    from sonotable.streaming.intake import stream_audio, stream_inputs
    from sonotable.streaming.state import stream_file_state
    from sonotable.operators import state as ST

    out, ck = os.path.join(tmpdir_new, "t"), os.path.join(tmpdir_new, "ck")
    first = stream_inputs(spark, FX.lines_of(FX.stream_table(spark, SF01, "pages")), out, ck).count()
    again = stream_inputs(spark, FX.lines_of(FX.stream_table(spark, SF01, "pages")), out, ck).count()
    assert first == again == 183
    d = _wav_folder()
    a_out, a_ck = os.path.join(tmpdir_new, "a"), os.path.join(tmpdir_new, "ack")
    n1 = stream_audio(spark, d, a_out, a_ck).count()
    _wav(os.path.join(d, "late.wav"), 16000, 1, 1.0)
    t = stream_audio(spark, d, a_out, a_ck)
    assert n1 == 6 and t.count() == 7 and t.where("file_id = 'late'").first().batch_id == 1
    s_out, s_ck = os.path.join(tmpdir_new, "s"), os.path.join(tmpdir_new, "sck")
    st = stream_file_state(spark, FX.stage_log_of(FX.stream_table(spark, SF01, "events")), s_out, s_ck)
    assert st.exceptAll(ST.fold_state(FX.stage_log(spark, SF01))).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["file_id", "num_speakers", "num_segments", "duration_sec", "languages_detected"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_segment_csv_and_listing(spark, tmpdir_new):
    import csv
    import glob

    segs = FX.segments(spark, SF001)
    out = os.path.join(tmpdir_new, "csv")
    K.write_segment_csv(segs, out)
    rows = []
    for p in glob.glob(out + "/file_id=*/part-*.csv"):
        with open(p) as fh:
            rows += list(csv.DictReader(fh))
    assert len(rows) == segs.count() and rows[0]["Confidence%"].endswith("%")
    d = _wav_folder()
    listing = AU.read_audio(spark, d)
    assert "content" not in listing.columns and listing.count() == 6
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_annotation_job_resumes(spark, tmpdir_new):
    from sonotable.plans import annotate_job

    segs = FX.segments(spark, SF001)
    frames = FX.frames(spark, SF001, segs)
    files = segs.select("file_id").distinct()
    inputs = files.select("file_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("in/"), "file_id").alias("source"))
    extra = spark.createDataFrame([("ghost", 1, "in/ghost")], "file_id string, line_no long, source string")
    root = os.path.join(tmpdir_new, "job")
    a = annotate_job.run(spark, inputs.unionByName(extra), root, stubs.fixed_turns, stubs.energy_scores, stubs.energy_probs,
                         audio_frames=frames, rate=FX.FRAME_SAMPLES, window_s=60, run_us=1_000_000)
    st = {r.file_id: r for r in a["state"].collect()}
    assert st["ghost"].status == "failed" and "Download failed" in st["ghost"].error
    assert sum(1 for r in st.values() if r.status == "completed") == files.count()
    n_ann = a["annotations"].count()
    m = {r.file_id: r for r in a["manifest"].collect()}
    assert m["ghost"].status == "failed" and m["ghost"].num_segments == 0
    # second run: completed files are skipped; the ghost file is retried and fails again
    b = annotate_job.run(spark, inputs.unionByName(extra), root, stubs.fixed_turns, stubs.energy_scores, stubs.energy_probs,
                         audio_frames=frames, rate=FX.FRAME_SAMPLES, window_s=60, run_us=2_000_000)
    assert b["annotations"].count() == n_ann
    ev = spark.read.parquet(os.path.join(root, "events"))
    assert ev.where("us >= 2000000 AND file_id <> 'ghost'").count() == 0
    assert b["annotations"].where("emotion IS NULL OR language IS NULL").count() == 0


def test_chunked_normalisation_equals_whole_file(spark):
    d = _wav_folder()
    _wav(os.path.join(d, "odd.wav"), 22050, 2, 13.3, freq=97.0)
    whole, wr = AU.normalise_pcm(AU.read_audio(spark, d, with_content=True), target_rate=16000)
    files = AU.read_audio(spark, d).select("file_id", "path")
    chunked, cr = AU.normalise_wav_files(files, target_rate=16000, chunk_s=7)
    a = {(r.file_id, r.frame_idx): bytes(r.pcm) for r in whole.collect()}
    b = {(r.file_id, r.frame_idx): bytes(r.pcm) for r in chunked.collect()}
    assert a == b
    assert [r.file_id for r in cr.collect()] == ["junk"]


def test_annotation_job_from_wav_files(spark, tmpdir_new):
    from sonotable.plans import annotate_job

    d = _wav_folder()
    files = AU.read_audio(spark, d).select("file_id", "path")
    inputs = files.select("file_id", F.lit(0).cast("long").alias("line_no"), F.col("path").alias("source"))
    out = annotate_job.run(spark, inputs, os.path.join(tmpdir_new, "job"), stubs.fixed_turns, stubs.energy_scores,
                           stubs.energy_probs, landed_files=files, rate=16000, window_s=600, run_us=5)
    st = {r.file_id: r.status for r in out["state"].collect()}
    assert st == {"good": "completed", "stereo44": "completed", "rate8k": "completed", "long": "completed",
                  "short": "failed", "junk": "failed"}
    m = {r.file_id: r for r in out["manifest"].collect()}
    assert m["long"].num_segments == 11 and m["long"].duration_sec == 31.0
    # a longer recording in place of the short one is landed and completed; of valid ones nothing is decoded again
    again = os.path.join(tmpdir_new, "again")
    os.makedirs(again)
    _wav(os.path.join(again, "short.wav"), 16000, 1, 3.0)
    longer = spark.createDataFrame([("short", os.path.join(again, "short.wav"))], "file_id string, path string")
    job = os.path.join(tmpdir_new, "job")
    out = annotate_job.run(spark, inputs, job, stubs.fixed_turns, stubs.energy_scores, stubs.energy_probs,
                           landed_files=files.where("file_id <> 'short'").unionByName(longer), rate=16000, window_s=600, run_us=6)
    st = {r.file_id: r.status for r in out["state"].collect()}
    assert st.pop("junk") == "failed" and set(st.values()) == {"completed"}
    assert {r.file_id: r.duration_sec for r in out["manifest"].collect()}["short"] == 3.0
    assert {r.file_id for r in spark.read.parquet(os.path.join(job, "audio", "run=6")).select("file_id").distinct().collect()} == {"short", "junk"}


def test_line_readers_keep_order_across_splits(spark, tmpdir_new):
    p = os.path.join(tmpdir_new, "big.rttm")
    lines = [f"SPEAKER big 1 {i}.5 1.25 <NA> <NA> S{i % 3} <NA> <NA>" for i in range(3000)]
    lines.insert(10, "SPEAKER big 1 x 1 <NA> <NA> S <NA> <NA>")       # reject, not counted
    lines.insert(20, "LEXEME big 1 0 1 <NA> <NA> S <NA> <NA>")        # skipped
    _write(p, "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert IO.raw_lines(spark, p).rdd.getNumPartitions() > 10
        segs, rejects = IO.read_rttm(spark, p)
        got = [(r.segment_idx, r.start_ms) for r in segs.orderBy("segment_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, i * 1000 + 500) for i in range(3000)] and rejects.count() == 1


def test_stream_fold_out_of_order_batches(spark, tmpdir_new):
    from sonotable.operators import state as ST
    from sonotable.streaming.state import stream_file_state

    log = FX.stage_log(spark, SF001)
    src = os.path.join(tmpdir_new, "src")
    # later half of the log lands first, so micro-batch 0 holds the newer events
    log.where("seq >= 500").write.parquet(os.path.join(src, "a"))
    log.where("seq < 500").write.parquet(os.path.join(src, "b"))
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    got = stream_file_state(spark, stream, os.path.join(tmpdir_new, "t"), os.path.join(tmpdir_new, "ck"))
    batches = spark.read.parquet(os.path.join(tmpdir_new, "t")).select("batch_id").distinct().count()
    assert batches >= 2
    assert got.exceptAll(ST.fold_state(log)).count() == 0 and ST.fold_state(log).exceptAll(got).count() == 0


def test_annotation_job_exports(spark, tmpdir_new):
    import glob

    from sonotable.plans import annotate_job

    segs = FX.segments(spark, SF001)
    frames = FX.frames(spark, SF001, segs)
    files = segs.select("file_id").distinct()
    inputs = files.select("file_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("in/"), "file_id").alias("source"))
    root = os.path.join(tmpdir_new, "job")
    first = inputs.where("file_id < 'f000008'")
    annotate_job.run(spark, first, root, stubs.fixed_turns, stubs.energy_scores, stubs.energy_probs,
                     audio_frames=frames, rate=FX.FRAME_SAMPLES, window_s=60, run_us=10, exports=True)
    annotate_job.run(spark, inputs, root, stubs.fixed_turns, stubs.energy_scores, stubs.energy_probs,
                     audio_frames=frames, rate=FX.FRAME_SAMPLES, window_s=60, run_us=20, exports=True)
    n_files = files.count()
    jdirs = glob.glob(os.path.join(root, "exports/json/file_id=*"))
    assert len(jdirs) == n_files  # the second run kept the first run's folders
    for d in jdirs[:3]:
        arr = json.loads("".join(open(f).read() for f in sorted(glob.glob(d + "/part-*"))))
        assert isinstance(arr, list) and all("speaker" in r for r in arr)
    rttm, rej = IO.read_rttm(spark, os.path.join(root, "exports/rttm/*/*.txt"))
    turns = spark.read.parquet(os.path.join(root, "turns"))
    assert rttm.count() == turns.count() and rej.count() == 0
    assert IO.read_manifest(spark, os.path.join(root, "exports/manifest_csv/run=*")).count() == n_files
    st = IO.read_file_state(spark, os.path.join(root, "exports/state_json/run=*"))
    assert st.where("status = 'completed'").count() == n_files


def test_stream_log_compaction(spark, tmpdir_new):
    from sonotable.operators import state as ST
    from sonotable.streaming.common import compact_batch_log, read_latest
    from sonotable.streaming.state import stream_file_state

    log = FX.stage_log(spark, SF001)
    src = os.path.join(tmpdir_new, "src")
    for i, cond in enumerate(["seq < 300", "seq >= 300 AND seq < 700", "seq >= 700"]):
        log.where(cond).write.parquet(os.path.join(src, f"p{i}"))
    out, ck = os.path.join(tmpdir_new, "t"), os.path.join(tmpdir_new, "ck")
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    before = stream_file_state(spark, stream, out, ck)
    upto = compact_batch_log(spark, out, ["file_id"])
    after = ST.finish_fold(read_latest(spark, out, ["file_id"]))
    assert upto >= 2
    assert after.exceptAll(before).count() == 0 and before.exceptAll(after).count() == 0
    assert after.exceptAll(ST.fold_state(log)).count() == 0


def test_diarize_keeps_times_across_missing_frames(spark):
    import numpy as np

    full = [("g", i, np.full(100, 1000 if i >= 5 else 0, dtype="<i2").tobytes()) for i in range(12)]
    gappy = [r for r in full if r[1] not in (0, 1, 7)]
    class_ = "file_id string, frame_idx long, pcm binary"
    a, _ = IF.diarize(spark.createDataFrame(full, class_), stubs.fixed_turns, rate=100, window_s=60)
    b, _ = IF.diarize(spark.createDataFrame(gappy, class_), stubs.fixed_turns, rate=100, window_s=60)
    ta = [(r.start_ms, r.end_ms) for r in a.orderBy("segment_idx").collect()]
    tb = [(r.start_ms, r.end_ms) for r in b.orderBy("segment_idx").collect()]
    assert ta == tb == [(0, 3000), (3000, 6000), (6000, 9000), (9000, 12000)]


def test_speakers_and_turns_do_not_depend_on_windows(spark):
    import random

    import numpy as np

    rng = random.Random(7)
    levels = []
    while len(levels) < 400:  # runs of up to 70 s of four speakers, with pauses
        levels += [rng.choice([0, 1, 2, 3, 4])] * rng.randrange(1, 70)
    frames = [("g", i, np.full(10, x, dtype="<i2").tobytes()) for i, x in enumerate(levels)]
    df = spark.createDataFrame(frames, "file_id string, frame_idx long, pcm binary")
    want, k = [], 0
    while k < len(levels):
        end = k
        while end < len(levels) and levels[end] == levels[k]:
            end += 1
        if levels[k]:
            want.append((k * 1000, end * 1000, levels[k]))
        k = end
    for window_s in (20, 60, 1000):
        segs, errors = IF.diarize(df, stubs.voiced_turns, rate=10, window_s=window_s, overlap_s=10)
        got = [(r.start_ms, r.end_ms, r.speaker) for r in segs.orderBy("segment_idx").collect()]
        assert errors.count() == 0 and [g[:2] for g in got] == [w[:2] for w in want], window_s
        names = {}
        for g, w in zip(got, want):
            assert names.setdefault(w[2], g[2]) == g[2]
        assert len(set(names.values())) == len(names)


def test_header_after_large_metadata_chunk(spark, tmpdir_new):
    import numpy as np

    x = (np.arange(32000) % 200 - 100).astype("<i2").tobytes()
    meta = b"LIST" + (200_000).to_bytes(4, "little") + b"\x00" * 200_000
    fmt = b"fmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") \
        + (16000).to_bytes(4, "little") + (32000).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little")
    data = b"data" + len(x).to_bytes(4, "little") + x
    body = b"WAVE" + meta + fmt + data
    with open(os.path.join(tmpdir_new, "meta.wav"), "wb") as fh:
        fh.write(b"RIFF" + len(body).to_bytes(4, "little") + body)
    files = AU.read_audio(spark, tmpdir_new)
    v = AU.validate_audio(AU.audio_headers(files)).first()
    assert (v.sample_rate, v.channels, v.n_frames, v.valid) == (16000, 1, 32000, True)
    frames, rejects = AU.normalise_wav_files(files.select("file_id", "path"), target_rate=16000, chunk_s=1)
    assert rejects.count() == 0 and bytes(frames.where("frame_idx = 0").first().pcm) == x[:32000]


def test_read_inputs_crlf(spark, tmpdir_new):
    p = os.path.join(tmpdir_new, "win.txt")
    with open(p, "wb") as fh:
        fh.write(b"# list\r\nhttps://youtu.be/abcdefghijk\r\n\r\n/data/a b.wav\r\n")
    rows = IO.read_inputs(spark, p).orderBy("line_no").collect()
    assert [(r.line_no, r.source, r.file_id) for r in rows] == [(1, "https://youtu.be/abcdefghijk", "abcdefghijk"), (3, "/data/a b.wav", "a b")]


def test_literal_interchange_edge_cases(spark, tmpdir_new):
    # an empty RTTM file (what a file without speech exports) has no segments and no rejects
    p = os.path.join(tmpdir_new, "empty.rttm")
    _write(p, "\n")
    segs, rejects = IO.read_rttm(spark, p)
    assert segs.count() == 0 and rejects.count() == 0
    # a JSON array of numbers is not an annotation array: a reject, no segments
    d = os.path.join(tmpdir_new, "json")
    os.makedirs(d)
    _write(os.path.join(d, "nums.json"), "[1, 2]")
    _write(os.path.join(d, "fine.json"), json.dumps([{"speaker": "S", "start": 1.0, "end": 2.0}]))
    s2, r2 = IO.read_annotations(spark, d + "/*.json")
    assert [r.file_id for r in s2.collect()] == ["fine"] and [r.file_id for r in r2.collect()] == ["nums"]
