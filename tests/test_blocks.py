"""Slices out of bucketed blocks: equal to the shuffled route, no exchange of PCM, hot recordings spread."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonotable.operators import audio as AU
from sonotable.operators import blocks as BL
from sonotable.operators import infer as IF
from sonotable.plans import stubs

RATE = 100


@pytest.fixture(scope="module")
def rows(spark):
    """One recording with most of the frames, a short one with a missing frame, one whose last frame is cut."""
    rng = np.random.default_rng(4)
    pcm = lambda n=RATE: rng.integers(-900, 900, n).astype("<i2").tobytes()
    frames = [("hot", k, pcm()) for k in range(700)] + [("gap", k, pcm()) for k in range(20) if k not in (5, 19)] + [("cut", 0, pcm()), ("cut", 1, pcm(37))]
    spans = [("hot", k, 1000 * k + 130, 1000 * k + 130 + 700 * (k % 40)) for k in range(0, 690, 3)]  # up to 27 s, over the borders of blocks
    spans += [("hot", 900, 5_000, 330_000), ("gap", 0, 4_200, 7_100), ("gap", 1, 5_000, 5_900), ("gap", 2, 18_500, 20_000), ("gap", 3, 40_000, 41_000),
              ("cut", 0, 500, 9_000), ("cut", 1, 1_370, 2_000), ("none", 0, 0, 5_000)]
    return (spark.createDataFrame(frames, "file_id string, frame_idx long, pcm binary").repartition(4),
            spark.createDataFrame(spans, "file_id string, segment_idx long, start_ms long, end_ms long"))


@pytest.mark.parametrize("block_s, overlap_s", [(60, 30), (10, 10), (7, 0)])
def test_both_models_equal_the_shuffled_route(rows, block_s, overlap_s):
    frames, segments = rows
    blocks = BL.write_blocks(frames, RATE, block_s, overlap_s)
    got = BL.emotion_and_language(segments, blocks, stubs.energy_scores, stubs.energy_probs)
    want = IF.detect_language(IF.classify_emotion(segments, frames, stubs.energy_scores, RATE), frames, stubs.energy_probs, RATE)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_slice_figures_equal_the_shuffled_route(rows):
    frames, segments = rows
    segments = segments.where("file_id <> 'gap'")
    got = BL.slice_stats(segments, BL.write_blocks(frames, RATE, 20, 5))
    want = AU.slice_stats(AU.slice_segments(segments, frames, RATE))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_exchange_between_the_scan_of_pcm_and_the_models(spark, rows):
    frames, segments = rows
    blocks = BL.write_blocks(frames, RATE)
    plan = BL.slice_stats(segments, blocks)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if blocks.table in x)
    group = next(i for i, x in enumerate(lines) if "CoGroups" in x)
    above = [x for x in lines[group:scan] if "Exchange" in x]
    assert "Bucketed: true" in plan and sum(blocks.table in x for x in lines) == 1
    assert len(above) == 1 and "pcm" not in above[0]  # the narrow segment rows' own


def test_a_hot_recording_is_many_groups(spark, rows):
    blocks = BL.write_blocks(rows[0], RATE, 20, 5, buckets=16)
    files = blocks.read(spark).where("file_id = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 8


def test_no_segments_and_no_frames(rows):
    frames, segments = rows
    for f, s in ((frames, segments.where("false")), (frames.where("false"), segments)):
        got = BL.emotion_and_language(s, BL.write_blocks(f, RATE), stubs.energy_scores, stubs.energy_probs).collect()
        assert len(got) == s.count() and {r.emotion for r in got} <= {"too_short"}


def test_overlap_beyond_a_block_is_refused(rows):
    with pytest.raises(ValueError, match="overlap"):
        BL.write_blocks(rows[0], RATE, 10, 20)
