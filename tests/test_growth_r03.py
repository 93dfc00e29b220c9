"""Steps whose time or exchange grew too fast: what they do now, against the plain way."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sonotable.operators import audio as AU
from sonotable.operators import infer as IF
from sonotable.operators.grouped import in_batches, sorted_groups
from sonotable.plans import fixtures as FX
from sonotable.plans import stubs
from sonotable.plans.wav_fixtures import land_wav_clips
from sonotable.sources import wav as W


def test_groups_go_on_over_batches():
    schema = pa.schema([("k", pa.string()), ("n", pa.int64()), ("v", pa.binary())])
    rows = [(None, 1, b"a"), (None, 1, b"b"), ("x", 1, b"c"), ("x", 2, None), ("x", 2, b"d"), ("y", 2, b"e")]
    for size in (1, 2, 4, 100):
        got = [(k, g["v"]) for k, g in sorted_groups(in_batches(iter(rows), schema, size), ["k", "n"])]
        assert got == [((None, 1), [b"a", b"b"]), (("x", 1), [b"c"]), (("x", 2), [None, b"d"]), (("y", 2), [b"e"])]


@pytest.mark.parametrize("kind", ["file", "folder"])
def test_a_table_is_streamed_as_a_file_or_a_folder(spark, tmpdir_new, kind):  # F4
    table = spark.range(50).selectExpr("id AS page_id", "concat('http://h/', id) AS url")
    path = f"{tmpdir_new}/pages.parquet"
    if kind == "folder":
        table.repartition(3).write.parquet(path)
    else:
        table.toPandas().to_parquet(path)
    from sonotable.streaming.intake import stream_inputs

    out = stream_inputs(spark, FX.lines_of(FX.stream_table(spark, tmpdir_new, "pages")), f"{tmpdir_new}/out", f"{tmpdir_new}/ck")
    want = {r.line_no for r in FX.lines_of(table).collect() if r.line.strip() and not r.line.startswith("#")}
    assert {r.line_no for r in out.collect()} == want


def plain_resample(x, n_in, rate, target):
    cut, half = target / rate, int(np.ceil(AU.SINC_ZEROS * rate / target))
    out = []
    for n in range(n_in * target // rate):
        t = n * rate / target
        at = np.arange(int(np.floor(t)) - half + 1, int(np.floor(t)) + half + 1)
        at = at[(at >= 0) & (at < n_in)]
        w = np.sinc((t - at) * cut) * (0.5 + 0.5 * np.cos(np.pi * np.clip((t - at) / half, -1, 1)))
        out.append((w * x[at]).sum() / w.sum())
    return np.array(out)


def test_sinc_weights_are_made_once_a_phase(monkeypatch):  # F11
    rng, made = np.random.default_rng(0), []
    sinc = np.sinc
    monkeypatch.setattr(np, "sinc", lambda u: made.append(np.size(u)) or sinc(u))
    for rate, target, n_in in ((441, 160, 1500), (220, 100, 997), (300, 100, 40), (101, 100, 700)):
        x = rng.integers(-30000, 30000, n_in).astype(np.float64)
        n_out = n_in * target // rate
        made.clear()
        cuts = list(range(0, n_out, 50)) + [n_out]
        got = []
        for lo, hi in zip(cuts, cuts[1:]):
            a, z = AU._input_range(lo, hi, n_in, rate, target)
            got.append(AU.resample(x[a:z], a, n_in, lo, hi, rate, target))
        assert len(made) <= 1
        assert np.abs(np.concatenate(got) - plain_resample(x, n_in, rate, target)).max() < 1e-6


def test_tasks_of_many_small_ranges_are_bounded(spark, tmpdir_new):  # F6
    ranges = [W.Ranges([(f"p{k}", "p", 0, 10)]) for k in range(1001)]
    dealt = list(W.dealt(ranges, 16))
    assert len(dealt) == 16 and [p for r in dealt for p in r.parts] == [p for r in ranges for p in r.parts]
    assert max(len(r.parts) for r in dealt) - min(len(r.parts) for r in dealt) <= 1
    frames = spark.range(1500).selectExpr("concat('f', id % 30) AS file_id", "id div 30 AS frame_idx", "unhex(repeat('0102', 10)) AS pcm")
    land_wav_clips(frames, tmpdir_new, 10, 20).collect()
    read = W.wav_frames(spark, tmpdir_new, target_rate=10, partition_bytes=100, max_tasks=7)
    assert read.rdd.getNumPartitions() == 7
    assert read.where("error is null").count() == 1500


def test_voices_are_linked_without_a_call_per_group(spark):  # F5
    rng = np.random.default_rng(3)
    rows = []
    for f in ("a", "b", None):
        for w in range(0, 300, 3):
            for s in range(int(rng.integers(1, 4))):
                rows.append((f, w << IF.WINDOW_BITS | s, rng.normal(size=3).tolist()))
    nodes = spark.createDataFrame(rows, "file_id string, node long, voice array<double>")
    got = {(r.file_id, r.node): r.root for r in IF.link_speakers(nodes.where("file_id is not null")).collect()}
    for f in ("a", "b"):
        own = pd.DataFrame([(f, n, v) for g, n, v in rows if g == f], columns=["file_id", "node", "voice"])
        root = {n: n for n in own["node"]}
        shift = IF.WINDOW_BITS
        for _ in range(2):
            linked = pd.concat([IF.link_block(g, shift) for _, g in own.groupby(own["node"].to_numpy() >> shift + IF.FAN_IN)])
            into = dict(zip(linked["node"], linked["into"]))
            root = {n: into[r] for n, r in root.items()}
            own = linked[[v is not None for v in linked["voice"]]][["file_id", "node", "voice"]]
            shift += IF.FAN_IN
        assert {n: got[f, n] for n in root} == root


def test_segments_over_blocks_and_repeated_ones_as_gathered(spark):  # F12, F13
    rng = np.random.default_rng(5)
    rate = 100
    frames = [("a", i, rng.integers(-900, 900, rate).astype("<i2").tobytes()) for i in range(150) if i not in (7, 61)]
    frames += [("a", 20, rng.integers(-900, 900, rate).astype("<i2").tobytes()), (None, 3, frames[0][2]), ("b", 0, b"\x01"), ("b", 1, None)]
    frames = spark.createDataFrame(frames, "file_id string, frame_idx long, pcm binary")
    segs = [("a", i, "S", s, e) for i, (s, e) in enumerate([(100, 5000), (6500, 9000), (19_000, 22_000), (58_500, 63_000), (1000, 149_900), (7000, 7900), (119_000, 119_999), (200_000, 201_000)])]
    segs += [("a", 2, "T", 30_000, 31_000), ("a", 2, "T", 90_000, 91_000), ("b", 0, "S", 0, 2000), (None, 0, "S", 3000, 4000)]
    segs = spark.createDataFrame(segs, "file_id string, segment_idx long, speaker string, start_ms long, end_ms long")
    for fn, kind, model, most in ((IF.classify_emotion, "scores", stubs.energy_scores, None), (IF.detect_language, "probs", stubs.energy_probs, 30_000)):
        plain = IF.run_model(AU.gather_segments(AU.slice_segments(segs, frames, rate, most)), model, rate, kind)
        want = {(r.file_id, r.segment_idx): r for r in plain.collect()}
        got = fn(segs, frames, model, rate).collect()
        assert len(got) == segs.count()
        for r in got:
            w = want.get((r.file_id, r.segment_idx))
            label, conf = r[-2:]
            if w is None or w.outcome != "ok":
                assert (label, conf) == ("too_short", 0.0)
                continue
            best = max((x.score for x in w.payload) if kind == "scores" else w.payload.values())
            assert conf == round(best, 3), (r, w)


def test_contexts_of_a_bucket_are_met_without_an_object_each():  # op3_suffix_array_dedup
    import tracemalloc

    from sonotable.llm import suffix_dedup as SD

    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 1500, dtype=np.uint8).tobytes().decode() for _ in range(300)]
    texts = [t for t in texts for _ in range(3)]
    live = [[SD.blob(SD.anchor_hashes(t))] for t in texts]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "live": live})
    # each third of the documents in a flush of its own: equal contexts meet in the bucket only
    dealt = pd.concat([row for k in range(3) for row in SD._deal_contexts(1)(iter([docs[k::3]]))])
    contexts = sum(len(k) // 8 for k in dealt["keys"])
    tracemalloc.start()
    replies = SD._match_contexts(dealt)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    strings = 0
    for r in replies.itertuples(index=False):
        strings += int(np.frombuffer(r.counts, dtype=np.int32).sum())
    assert strings == 600 * (1500 - SD.LENGTH + 1)
    assert contexts > 30_000 and peak < 200 * contexts  # a few integers each; text, tuple and list of each took over 500 bytes


@pytest.mark.parametrize("kind", ["rttm", "annotations"])
def test_exported_folders_are_listed_by_few_tasks_and_read_once(spark, tmpdir_new, kind):  # F14, F15
    from sonotable import sinks as K
    from sonotable.sources import interchange as IO

    rows = [(f"f{f:03}", k, "S", k * 1000, k * 1000 + 500, "happy", 0.5, "en", 0.25) for f in range(300) for k in range(3)]
    segs = spark.createDataFrame(rows, "file_id string, segment_idx long, speaker string, start_ms long, end_ms long, emotion string, "
                                       "emotion_confidence double, language string, language_confidence double")
    path = os.path.join(tmpdir_new, "out")
    write, read = {"rttm": (K.write_rttm, IO.read_rttm), "annotations": (K.write_annotations, IO.read_annotation_export)}[kind]
    write(segs, path)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"read {kind}", "")
    try:
        back, rejects = read(spark, path)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"read {kind}") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) <= 8 * spark.sparkContext.defaultParallelism < 300
    assert spark.conf.get(key) == before
    assert not any(f.startswith(f"file:{path}") for f in back.unionByName(rejects.select("line" if kind == "rttm" else "file_id"), allowMissingColumns=True).inputFiles())
    columns = back.columns
    assert sorted(back.collect()) == sorted(segs.select(*columns).collect()) and rejects.count() == 0


def test_anchors_are_spread_over_the_buckets():  # op3_suffix_array_dedup
    from sonotable.llm import suffix_dedup as SD

    text = np.random.default_rng(6).integers(97, 123, 200_000, dtype=np.uint8).tobytes().decode()
    h = SD.anchor_hashes(text)
    dealt = np.bincount(SD.bucket_of(h, 32), minlength=32)
    assert len(h) > 3200 and dealt.max() < 2 * len(h) / 32  # smallest hashes as they are: nine of ten in the first bucket


def test_transform_takes_no_table_of_letters_times_suffixes():  # op3_suffix_array_dedup
    import tracemalloc

    from sonotable.llm.bwt import string_classes

    rng = np.random.default_rng(8)
    text = rng.integers(1, 250, 30_000, dtype=np.uint16)
    symbols = np.concatenate([text, [0], text, [0]]).astype(np.uint16)
    tracemalloc.start()
    classes = string_classes(symbols, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = len(text) - 99
    assert np.array_equal(classes[:own], classes[len(text) + 1:][:own]) and len(np.unique(classes[:own])) == own
    assert peak < 150 * len(symbols)  # 4 bytes a letter of the alphabet and suffix: over 1,000 a suffix


def test_repeats_of_a_transform_are_replied_as_runs():  # op3_suffix_array_dedup
    from sonotable.llm import suffix_dedup as SD

    rng = np.random.default_rng(9)
    base = rng.integers(97, 123, 2000, dtype=np.uint8)
    texts = []
    for k in range(3):  # copies that differ in a letter every 300
        t = base.copy()
        t[50 + 40 * k::300] = ord("A") + k
        texts.append(t.tobytes())
    live = [[SD.blob(SD.anchor_hashes(t.decode()))] for t in texts]
    docs = pd.DataFrame({"doc_id": range(3), "text": [t.decode() for t in texts], "live": live})
    found, given = set(), 0
    for r in SD._match_contexts(pd.concat(list(SD._deal_contexts(1)(iter([docs]))))).itertuples(index=False):
        ids = np.frombuffer(r.docs, dtype=np.int64).reshape(-1, 2)[:, 0]
        for owner, start, count in zip(*[np.frombuffer(x, dtype=np.int32).tolist() for x in (r.owners, r.starts, r.counts)]):
            found |= {(int(ids[owner]), p) for p in range(start, start + count)}
            given += 1
    seen, want = set(), set()
    for k, t in enumerate(texts):
        for p in range(len(t) - SD.LENGTH + 1):
            want |= {(k, p)} if t[p:p + SD.LENGTH] in seen else set()
            seen.add(t[p:p + SD.LENGTH])
    assert found == want and given < len(want) / 8  # a reply for each string before
