"""The WAV data source against the chunk operators it shares its decoding with."""

from __future__ import annotations

import os

import numpy as np
import pytest

from sonotable.operators import audio as AU
from sonotable.plans.wav_fixtures import pack_wav_bytes
from sonotable.sources import wav as W


def land(folder, name, rate, channels, samples):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as fh:
        fh.write(pack_wav_bytes(rate, channels, samples))


@pytest.fixture()
def folder(tmpdir_new):
    rng = np.random.default_rng(1)
    land(tmpdir_new, "long.wav", 100, 1, rng.integers(-9000, 9000, 100_050).astype("<i2"))  # most of all bytes
    land(tmpdir_new, "sub/high.WAV", 220, 1, rng.integers(-9000, 9000, 4_321).astype("<i2"))
    land(tmpdir_new, "sub/low.wav", 40, 1, rng.integers(-9000, 9000, 999).astype("<i2"))
    land(tmpdir_new, "none.wav", 100, 1, np.zeros(0, dtype="<i2"))
    for name, data in (("empty.wav", b""), ("junk.wav", b"x" * 30_000), ("notes.txt", b"not audio")):
        with open(f"{tmpdir_new}/{name}", "wb") as fh:
            fh.write(data)
    return tmpdir_new


def test_frames_equal_the_operator_at_every_range_size(spark, folder):
    files = AU.read_audio(spark, folder, ("wav", "WAV")).select("file_id", "path")
    want = sorted((r.file_id, r.frame_idx, r.pcm and bytes(r.pcm)) for r in AU.normalised_parts(files, 100, 3).collect())
    # Spark's own listing leaves out files of no bytes
    want = sorted(want + [("empty", -1, None)]) if not any(w[0] == "empty" for w in want) else want
    for size in (700, 40_000, 1 << 20):
        df = W.wav_frames(spark, folder, target_rate=100, chunk_s=3, partition_bytes=size)
        rows = df.collect()
        key = lambda r: (r[0], r[1])
        got = [(r.file_id, r.frame_idx, r.pcm and bytes(r.pcm)) for r in rows]
        assert [(a, b, c or b"") for a, b, c in sorted(got, key=key)] == [(a, b, c or b"") for a, b, c in sorted(want, key=key)], size
        assert {r.file_id for r in rows if r.error} == {"empty", "junk"}
    assert W.wav_frames(spark, folder, partition_bytes=40_000).rdd.getNumPartitions() >= 6  # the long file has several


def test_ranges_follow_bytes():
    files = [("a/big.wav", 250), ("b/one.wav", 40), ("b/two.wav", 30), ("c/none.wav", 0)]
    parts = [p.parts for p in W.packed(files, 100)]
    assert [sum(e - s for _, _, s, e in p) for p in parts] == [100, 100, 90, 30]
    assert [(f, s, e) for p in parts for _, f, s, e in p][:4] == [("big", 0, 100), ("big", 100, 200), ("big", 200, 250), ("one", 0, 40)]
    assert list(W.packed([], 100)) == []


def test_filters_prune_the_listing(spark, folder):
    conf = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(conf, "false")
    spark.conf.set(conf, "true")
    try:
        df = W.wav_frames(spark, folder, target_rate=100, partition_bytes=1000)
        one = df.where("file_id = 'low' and frame_idx >= 3")
        assert one.rdd.getNumPartitions() == 3 and {r.file_id for r in one.collect()} == {"low"}
        assert df.where("file_id in ('none', 'junk')").select("file_id").distinct().count() == 2
        assert df.where("file_id = 'nobody'").count() == 0
    finally:
        spark.conf.set(conf, before)


def test_a_missing_folder_is_an_error(spark, tmpdir_new):
    with pytest.raises(Exception, match="nowhere"):
        W.wav_frames(spark, f"{tmpdir_new}/nowhere").collect()
