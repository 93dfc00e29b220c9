"""Keyed state over micro-batches and the commit of a micro-batch's tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sonotable.operators import state as ST
from sonotable.streaming import transaction as TX
from sonotable.streaming.common import run_available
from sonotable.streaming.intake import stream_inputs
from sonotable.streaming.keyed import Record, first_seen
from sonotable.streaming.state import stream_progress_elapsed, stream_state_machine

EVENTS = "file_id string, seq long, us long, action string, stage string, error string, url string"


def fed(spark, parts, schema, folder, run):
    """Land each part and run the stream over it, from the checkpoint of the part before."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        out = run(spark.readStream.schema(schema).parquet(folder))
    return out


def events_of(seed, n=240, files=7):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        action = rng.choice(["started", "stage", "stage", "completed", "failed"])
        rows.append((f"f{rng.randrange(files)}", seq, 10 * seq + rng.randrange(5), action, rng.choice(["download", "emotion"]) if action == "stage" else None,
                     f"e{seq}" if action == "failed" else None, f"u{seq}" if action == "started" else None))
    return rows


def test_state_machine_equals_the_fold_in_any_order(spark, tmpdir_new):
    rows = events_of(1)
    random.Random(2).shuffle(rows)  # events of a file are spread over the batches in no order
    got = fed(spark, [rows[k::4] for k in range(4)], EVENTS, f"{tmpdir_new}/in", lambda s: stream_state_machine(spark, s, f"{tmpdir_new}/out", f"{tmpdir_new}/ck"))
    want = ST.fold_state(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    batches = spark.read.parquet(f"{tmpdir_new}/out").select("batch_id").distinct().count()
    assert batches == 4


def test_events_before_the_first_start_are_ignored():
    r = Record()
    for e in [(1, 10, "stage", "download", None, None), (2, 20, "completed", None, None, None), (3, 30, "failed", None, "x", None)]:
        r.take(*e)
    assert r.row("f") is None
    r.take(5, 50, "started", None, None, "u")
    assert r.row("f") == ("f", "in_progress", None, "u", 50, None, None)
    r.take(7, 70, "failed", None, "bad", None)
    r.take(6, 60, "stage", "emotion", None, None)
    assert r.row("f") == ("f", "failed", "emotion", "u", 50, None, "bad")
    r.take(9, 90, "started", None, None, "other")
    assert Record(r.values()).row("f") == ("f", "in_progress", "emotion", "u", 50, None, None)


def test_elapsed_counts_from_earlier_batches_and_late_events_change_nothing(spark, tmpdir_new):
    rows = events_of(3)
    late = [("f1", 2, 999_999, "stage", "language", None, None)]
    parts = [rows[:80], rows[80:160], rows[160:], late]
    got = fed(spark, parts, EVENTS, f"{tmpdir_new}/in", lambda s: stream_progress_elapsed(spark, s, f"{tmpdir_new}/out", f"{tmpdir_new}/ck"))
    want = ST.progress_elapsed(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_seen_over_batches_and_within_one(spark, tmpdir_new):
    parts = [[("a", 3), ("a", 1), (None, 5)], [("a", 0), ("b", 9), ("b", 8), (None, 1)], [("c", 2), ("b", 1)]]
    schema = "file_id string, line_no long"

    def run(stream):
        run_available(first_seen(stream, "file_id", ["line_no"]), f"{tmpdir_new}/out", f"{tmpdir_new}/ck", "append")
        return spark.read.parquet(f"{tmpdir_new}/out")

    got = fed(spark, parts, schema, f"{tmpdir_new}/in", run)
    assert sorted(((r.file_id or "", r.line_no, r.batch_id) for r in got.collect())) == [("", 5, 0), ("a", 1, 0), ("b", 8, 1), ("c", 2, 2)]


def test_intake_reads_no_earlier_output(spark, tmpdir_new):
    """Earlier output may be gone: what is known is in the state."""
    schema = "line_no long, line string"
    outs = iter(range(9))

    def run(stream):
        return stream_inputs(spark, stream, f"{tmpdir_new}/out{next(outs)}", f"{tmpdir_new}/ck").select("line_no", "source")

    got = [fed(spark, [part], schema, f"{tmpdir_new}/in", run).collect() for part in
           ([(1, "/data/a.wav"), (2, "# no"), (3, "/data/b.wav"), (4, "/other/a.wav")], [(5, "/data/a.wav"), (6, "/data/c.wav")])]
    assert [sorted(r.line_no for r in rows) for rows in got] == [[1, 3], [6]]


def test_only_committed_runs_are_visible(spark, tmpdir_new):
    root = f"{tmpdir_new}/root"
    for run in (0, 1):
        for name in ("turns", "events"):
            spark.range(3).withColumn("v", F.lit(run)).write.parquet(f"{root}/{name}/run={run}")
    TX.commit(spark, root, 0, 3)
    table = spark.read.parquet(f"{root}/turns")
    assert TX.is_committed(spark, root, 0) and not TX.is_committed(spark, root, 1)
    assert TX.visible(table, TX.committed(spark, root)).agg(F.collect_set("v")).first()[0] == [0]
    spark.range(5).withColumn("v", F.lit(1)).write.mode("overwrite").parquet(f"{root}/turns/run=1")  # the replay
    TX.commit(spark, root, 1, 5)
    TX.commit(spark, root, 1, 5)
    assert TX.visible(spark.read.parquet(f"{root}/turns"), TX.committed(spark, root)).count() == 8


def test_nothing_is_visible_before_the_first_commit(spark, tmpdir_new):
    assert TX.committed(spark, f"{tmpdir_new}/none").count() == 0


@pytest.mark.parametrize("table", ["events", "turns", "manifest"])
def test_a_batch_killed_after_any_table_is_replayed_whole(spark, tmpdir_new, table):
    from sonotable.plans import stubs
    from sonotable.streaming.annotate import annotate_stream, committed_tables

    root, schema = f"{tmpdir_new}/root", "file_id string, line_no long, source string"
    tone = F.unhex(F.repeat(F.lit("0a00"), 100))

    def audio(files):
        return files.crossJoin(spark.range(4)).select("file_id", F.col("id").alias("frame_idx"), tone.alias("pcm"))

    def killed(run, name):
        if run == 1 and name == table:
            raise RuntimeError("killed")

    def run(stream, on_write=None):
        return annotate_stream(spark, stream, root, f"{tmpdir_new}/ck", stubs.fixed_turns, stubs.energy_scores, stubs.energy_probs,
                               audio_of=audio, rate=100, window_s=60, on_write=on_write)

    fed(spark, [[("a", 1, "in/a"), ("b", 2, "in/b")]], schema, f"{tmpdir_new}/in", run)
    with pytest.raises(Exception, match="killed"):
        fed(spark, [[("b", 3, "in/b"), ("c", 4, "in/c")]], schema, f"{tmpdir_new}/in", lambda s: run(s, killed))
    assert sorted(r.file_id for r in committed_tables(spark, root)["manifest"].collect()) == ["a", "b"]  # nothing half is seen
    out = run(spark.readStream.schema(schema).parquet(f"{tmpdir_new}/in"))
    assert sorted((r.file_id, r.url, r.status) for r in out["manifest"].collect()) == [("a", "in/a", "completed"), ("b", "in/b", "completed"), ("c", "in/c", "completed")]
    assert sorted((r.file_id, r.status) for r in out["state"].collect()) == [("a", "completed"), ("b", "completed"), ("c", "completed")]
    per_file = {r.file_id: r.n for r in out["annotations"].groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(set(per_file.values())) == 1 and set(per_file) == {"a", "b", "c"}
