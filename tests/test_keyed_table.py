"""Append or update of a keyed table by copy-on-write of hash buckets."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sonotable.sinks import keyed as KT

T = "k string, at long, seq long, v string"


def rows_of(df):
    return sorted(((r.k, r.at, r.seq, r.v) for r in df.collect()), key=repr)


def put(spark, root, run, rows, **kw):
    return KT.upsert(spark.createDataFrame(rows, T), root, run, "k", ["at", "seq"], **kw)


def test_appends_updates_late_rows_and_replays(spark, tmpdir_new):
    root = f"{tmpdir_new}/t"
    assert KT.current(spark, root).count() == 0
    first = [(f"k{i}", 10, 0, "a") for i in range(50)] + [("k3", 10, 1, "later"), (None, 5, 0, "none")]
    assert put(spark, root, 0, first, buckets=8)
    want = {k: (k, at, s, v) for k, at, s, v in sorted(first, key=lambda r: (r[1], r[2]))}
    assert rows_of(KT.current(spark, root)) == sorted(want.values(), key=repr)
    second = [("k3", 9, 9, "too late"), ("k4", 11, 0, "b"), ("new", 1, 0, "c"), (None, 6, 0, None)]
    for _ in range(2):  # the second is a replay
        put(spark, root, 1, second)
        want.update({"k4": second[1], "new": second[2], None: second[3]})
        assert rows_of(KT.current(spark, root)) == sorted(want.values(), key=repr)
    assert not put(spark, root, 0, [("k4", 99, 0, "an older run")])
    assert put(spark, root, 2, [])
    assert rows_of(KT.current(spark, root)) == sorted(want.values(), key=repr)


def test_only_touched_buckets_are_written_and_read(spark, tmpdir_new):
    root = f"{tmpdir_new}/t"
    put(spark, root, 0, [(f"k{i}", 1, i, "a") for i in range(400)], buckets=16)
    put(spark, root, 1, [("k7", 2, 0, "b")])
    made = [d for d in os.listdir(f"{root}/data/run=1") if d.startswith(KT.BUCKET)]
    assert len(made) == 1
    read = {os.path.dirname(f).split("/data/")[1] for f in KT.current(spark, root).inputFiles()}
    assert len(read) == 16 and f"run=1/{made[0]}" in read and f"run=0/{made[0]}" not in read


def test_a_run_lost_before_its_commit_is_not_seen_and_can_be_replayed(spark, tmpdir_new, monkeypatch):
    root = f"{tmpdir_new}/t"
    put(spark, root, 0, [("a", 1, 0, "old"), ("b", 1, 0, "old")], buckets=4)

    def lost(*_):
        raise RuntimeError("writer lost")

    with monkeypatch.context() as m:
        m.setattr(KT, "_commit", lost)
        with pytest.raises(RuntimeError):
            put(spark, root, 1, [("a", 2, 0, "half"), ("b", 2, 0, "half")])
    assert os.path.isdir(f"{root}/data/run=1")
    assert rows_of(KT.current(spark, root)) == [("a", 1, 0, "old"), ("b", 1, 0, "old")]
    put(spark, root, 1, [("a", 2, 0, "new"), ("c", 2, 0, "new")])
    assert rows_of(KT.current(spark, root)) == [("a", 2, 0, "new"), ("b", 1, 0, "old"), ("c", 2, 0, "new")]


def test_other_columns_are_refused(spark, tmpdir_new):
    root = f"{tmpdir_new}/t"
    put(spark, root, 0, [("a", 1, 0, "x")], buckets=4)
    with pytest.raises(ValueError):
        KT.upsert(spark.createDataFrame([("a", 1, 0, "x")], T).withColumn("more", F.lit(1)), root, 1, "k", ["at", "seq"])
