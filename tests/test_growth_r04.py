"""Round 4: the whole annotation job, and audio that is moved no more than it has to be."""

from __future__ import annotations

import datetime
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from sonotable.plans import catalog
from sonotable.plans import fixtures as FX
from sonotable.session import checkpoint_dir


def events(spark, folder: str, users: int = 3, each: int = 12) -> str:
    """A folder with an events table of its own: ``each`` events a user, one of them twice."""
    start = datetime.datetime(2024, 1, 5)
    rows = [(u * 100 + i, start + datetime.timedelta(hours=i), u, ["view", "click", "purchase"][i % 3], 1.0, json.dumps({"k": 20 + i})) for u in range(users) for i in range(each)]
    spark.createDataFrame([*rows, rows[0]], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def folders(spark, name: str) -> set[str]:
    return set(glob.glob(os.path.join(checkpoint_dir(spark).removeprefix("file://"), f"{name}-*")))


def test_annotation_run_writes_the_exchanged_files_of_every_recording(spark, tmpdir_new):
    sf, before = events(spark, tmpdir_new), folders(spark, "annotation_run")
    manifest = {r.file_id: r.num_segments for r in catalog.REGISTRY["annotation_run"](spark, sf).collect()}
    [root] = folders(spark, "annotation_run") - before
    for file_id, n in manifest.items():
        text = "".join(open(f).read() for f in sorted(glob.glob(f"{root}/exports/json/file_id={file_id}/part-*")))
        assert len(json.loads(text)) == n
        assert sum(len(open(f).read().splitlines()) for f in glob.glob(f"{root}/exports/rttm/file_id={file_id}/part-*")) == n
    assert len(manifest) == 3 and glob.glob(f"{root}/exports/manifest_csv/run=*/part-*") and glob.glob(f"{root}/exports/state_json/run=*/part-*")


@pytest.mark.parametrize("query", ["wav_source", "normalise_wav_files", "stream_audio_intake"])
def test_landed_files_are_written_where_their_frames_are_made(spark, tmpdir_new, query, monkeypatch):
    plans = []
    land = catalog.WF.land_wav_clips

    def seen(*args, **kwargs):
        out = land(*args, **kwargs)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(catalog.WF, "land_wav_clips", seen)
    sf, before = events(spark, tmpdir_new), folders(spark, "decoded")
    out = catalog.REGISTRY[query](spark, sf)
    last = FX.frames(spark, sf).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    want = last.count() if query == "stream_audio_intake" else last.agg(F.sum("n")).first()[0]
    assert out.count() == want
    # a plan is told from its end: samples are made in ArrowEvalPython, and nothing is dealt behind it
    assert "ArrowEvalPython" in plans[0] and "Exchange" not in plans[0].split("ArrowEvalPython")[0].replace("AdaptiveSparkPlan", "")
    assert folders(spark, "decoded") == before  # what is read once is not written first


def test_frames_by_spans_are_the_same_frames_in_order(spark, tmpdir_new):
    sf = events(spark, tmpdir_new, users=4, each=30)
    rows = lambda df: sorted((r.file_id, r.frame_idx, bytes(r.pcm)) for r in df.collect())
    spans = FX.frames(spark, sf, num_partitions=3, span_s=50)
    assert rows(spans) == rows(FX.frames(spark, sf))
    parts = {}
    for r in spans.select("file_id", "frame_idx", F.spark_partition_id().alias("p")).collect():
        parts.setdefault((r.file_id, r.frame_idx // 50), []).append((r.p, r.frame_idx))
    assert all(len({p for p, _ in x}) == 1 and x == sorted(x) for x in parts.values())


def test_packed_frames_come_back_as_they_were(spark):
    from sonotable.operators.grouped import packed, unpacked

    rows = [("a", i, bytes([i % 256, 1]) * (i % 7 * 90)) for i in range(130)] + [("a", 5, b"again"), ("a", 6, None), (None, 3, b"xy"), ("b", -1, b"neg"), ("b", 40, b"z" * 9000), ("b", None, b"")]
    df = spark.createDataFrame(rows, "file_id string, frame_idx long, pcm binary").coalesce(1)
    got = packed(df, 40, 10).collect()
    back = [(r.file_id, r.block, i, pcm) for r in got for i, pcm in unpacked(r.frame_idx, bytes(r.pcm))]
    want = [(f, b, i, pcm) for f, i, pcm in rows if i is not None for b in {i // 40, i // 40 - (i % 40 < 10 and i // 40 > 0)}]
    key = lambda x: (x[0] or "", x[1], x[2], x[3] or b"")
    assert sorted(back, key=key) == sorted(want, key=key)
    assert len(got) < len(want) / 4


def test_diarization_deals_the_overlap_of_a_block_and_not_of_a_window(spark, tmpdir_new, monkeypatch):
    from sonotable.operators import infer as IF
    from sonotable.operators.grouped import unpacked
    from sonotable.plans import stubs

    dealt = []
    by_key = IF.by_key

    def seen(rows, keys, order):
        if "pcm" in rows.columns:
            dealt.append(rows)
        return by_key(rows, keys, order)

    monkeypatch.setattr(IF, "by_key", seen)
    frames = FX.frames(spark, events(spark, tmpdir_new, users=2, each=200))
    turns, errors = IF.diarize(frames, stubs.fixed_turns, rate=FX.FRAME_SAMPLES, window_s=60, overlap_s=30)
    n = sum(1 for r in dealt[0].collect() for _ in unpacked(r.frame_idx, bytes(r.pcm)))
    assert n <= 1.06 * frames.count()  # 1.5 times with an overlap for every window
    only, _ = IF.diarize(frames, stubs.fixed_turns, rate=FX.FRAME_SAMPLES, window_s=60, overlap_s=30, files=spark.createDataFrame([("f000001",)], "file_id string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(only) == rows(turns.where("file_id = 'f000001'")) and errors.count() == 0 and only.count() > 400


def test_what_is_written_in_between_leaves_no_shuffle_files(spark):
    from sonotable.storage import written

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: set(local.getAllBlocks().mkString("\n").split("\n"))
    before = {x for x in names() if x.startswith("shuffle")}
    back = written(spark.range(1000).repartition(5, "id"), "between")
    assert {x for x in names() if x.startswith("shuffle")} <= before and back.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_the_job_joins_no_pcm_and_logs_every_event_once(spark, tmpdir_new, monkeypatch):
    from sonotable.operators import infer as IF
    from sonotable.plans import annotate_job, stubs

    plans = []
    for name in ("diarize", "classify_emotion", "detect_language"):
        def seen(*args, fn=getattr(IF, name), at=0 if name == "diarize" else 1, **kwargs):
            plans.append(args[at]._jdf.queryExecution().optimizedPlan().toString())
            return fn(*args, **kwargs)
        monkeypatch.setattr(IF, name, seen)
    sf = events(spark, tmpdir_new)
    segs = FX.segments(spark, sf)
    out = annotate_job.run(spark, catalog._job_inputs(spark, sf, segs), f"{tmpdir_new}/job", stubs.fixed_turns, stubs.energy_scores, stubs.energy_probs,
                           audio_frames=FX.frames(spark, sf, segs), rate=FX.FRAME_SAMPLES, window_s=60, run_us=7)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    log = spark.read.parquet(f"{tmpdir_new}/job/events").groupBy("file_id").agg(F.sort_array(F.collect_list("seq")).alias("x")).collect()
    assert len(log) == 3 and all(r.x == [70, 71, 72, 73, 74, 75, 76] for r in log)
    assert {r.status for r in out["state"].collect()} == {"completed"}


def test_results_of_segments_are_never_broadcast(spark, tmpdir_new):
    """A table of labels is a few bytes on disk for many rows: its size there says nothing of what a broadcast takes."""
    from sonotable.operators.segments import attach_stage

    segs = spark.range(30_000).select(F.format_string("f%06d", F.floor(F.col("id") / 150)).alias("file_id"), (F.col("id") % 150).alias("segment_idx"))
    for name, df in (("turns", segs), ("emotion", segs.withColumn("emotion", F.lit("happy")))):
        df.sortWithinPartitions("file_id", "segment_idx").write.parquet(f"{tmpdir_new}/{name}")
    out = attach_stage(spark.read.parquet(f"{tmpdir_new}/turns"), spark.read.parquet(f"{tmpdir_new}/emotion"), ["emotion"])
    assert out.where("emotion = 'happy'").count() == 30_000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
