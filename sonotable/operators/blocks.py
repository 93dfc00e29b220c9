"""Frame tables in buckets, and operators that slice segments out of them where they lie.

A block is ``block_s`` seconds of a recording and the ``overlap_s`` behind them. The frame
table is bucketed by (file_id, block): a frame lies in its own block and, near its start, in
the one before, so a segment that starts in a block is there whole unless it goes on for
longer than the overlap. The narrow segment rows are shuffled to the buckets; the PCM is
dealt once, when the table is written, and never again: the plan has no exchange above its
scan. All models that need slices get them from one reading.

A long recording is many blocks, spread over the buckets; a task's group is one block.
Of a segment beyond the overlap every block gives its piece, and only those are gathered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonotable import schemas as S
from sonotable.functions import labels as L
from sonotable.operators import audio as AU
from sonotable.operators import infer as IF
from sonotable.operators.grouped import in_batches
from sonotable.operators.segments import attach_stage, gate_short
from sonotable.session import scratch_path


@dataclass(frozen=True)
class Blocks:
    """A bucketed frame table (file_id, block, frame_idx, pcm) and how it is cut."""

    table: str
    rate: int
    block_s: int
    overlap_s: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)


def write_blocks(frames: DataFrame, rate: int, block_s: int = 120, overlap_s: int = 30, buckets: int | None = None,
                 table: str | None = None, path: str | None = None) -> Blocks:
    """``frames`` (file_id, frame_idx, pcm; frames of one second) as a bucketed table.

    ``buckets`` should not be below the session's shuffle partitions (the default), else
    Spark may deal the table again for more tasks. Without ``path`` the files go to the
    shared scratch folder.
    """
    if overlap_s > block_s:
        raise ValueError("the overlap may not be longer than a block")
    spark = frames.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.floor(F.col("frame_idx") / block_s).cast("long")
    before = F.when((F.col("frame_idx") % block_s < overlap_s) & (own > 0), own - 1)
    rows = frames.select("file_id", F.explode(F.array_compact(F.array(own, before))).alias("block"), "frame_idx", "pcm")
    name = table or f"frame_blocks_{uuid.uuid4().hex[:12]}"
    # the hash of the buckets, so that every task writes one file
    rows.repartition(buckets, "file_id", "block").write.bucketBy(buckets, "file_id", "block").sortBy("file_id", "block").option(
        "path", path or scratch_path(spark, "frame-blocks")).saveAsTable(name)
    return Blocks(name, rate, block_s, overlap_s)


def wanted_slices(segments: DataFrame, blocks: Blocks) -> DataFrame:
    """What each block has to give: (file_id, block, segment_idx, offset, piece, _g0, _g1).

    A segment that ends within the overlap behind its first block is one row; a longer one
    is a piece of every block that it goes through, ``offset`` samples from its start.
    """
    size, over = blocks.rate * blocks.block_s, blocks.rate * blocks.overlap_s
    g0, g1 = AU.slice_bounds(F.col("start_ms"), F.col("end_ms"), blocks.rate)
    rows = segments.select("file_id", "segment_idx", g0.alias("_s0"), g1.alias("_s1")).where("_s1 > _s0")
    first, last = (F.floor(x / size).cast("long") for x in (F.col("_s0"), F.col("_s1") - 1))
    piece = F.col("_s1") > (first + 1) * size + over
    rows = rows.withColumn("piece", piece).withColumn("block", F.explode(F.when(piece, F.sequence(first, last)).otherwise(F.array(first))))
    lo = F.when(F.col("piece"), F.greatest(F.col("_s0"), F.col("block") * size)).otherwise(F.col("_s0"))
    hi = F.when(F.col("piece"), F.least(F.col("_s1"), (F.col("block") + 1) * size)).otherwise(F.col("_s1"))
    return rows.select("file_id", "block", "segment_idx", (lo - F.col("_s0")).alias("offset"), "piece", lo.alias("_g0"), hi.alias("_g1"))


def slices_of(starts: np.ndarray, pcm: list, wanted: list[tuple[int, int]]) -> list[np.ndarray | None]:
    """int16 samples of each wanted range (_g0, _g1), in order; None where there is no audio.

    ``starts``: the first sample of each frame. A missing frame is silence, unless nothing
    follows it: then the slice ends before it.
    """
    parts = [AU.pcm_array(p) for p in pcm]
    order = np.argsort(starts, kind="stable")
    starts, parts = starts[order], [parts[i] for i in order]
    ends = starts + np.array([len(p) for p in parts], dtype=np.int64)
    base = int(starts[0]) if len(starts) else 0
    buf = np.zeros(int(ends.max()) - base if len(ends) else 0, dtype=np.int16)
    for s, p in zip(starts.tolist(), parts):
        buf[s - base:s - base + len(p)] = p
    out = []
    for g0, g1 in wanted:
        last = int(np.searchsorted(starts, g1)) - 1  # the last frame that starts before the end
        end = min(int(ends[last]), g1) if last >= 0 else g0
        if end <= g0:
            out.append(None)
            continue
        lead = max(0, base - g0)  # missing frames before the first
        x = buf[max(0, g0 - base):end - base]
        out.append(np.concatenate([np.zeros(lead, dtype=np.int16), x]) if lead else x)
    return out


def apply_to_slices(segments: DataFrame, blocks: Blocks, fn: Callable[[str, list[dict], list[np.ndarray]], list[tuple]], schema: pa.Schema, ddl) -> DataFrame:
    """``fn(file_id, rows, int16 slices)`` per block, for those of ``wanted_slices`` that have audio there; gives rows of ``schema``."""
    rate = blocks.rate

    def run(key, wanted: pa.Table, block: pa.Table) -> pa.Table:
        rows: list[dict] = []
        found: list[np.ndarray] = []
        if wanted.num_rows and block.num_rows:
            asked = wanted.to_pylist()
            starts = block["frame_idx"].to_numpy().astype(np.int64) * rate
            given = slices_of(starts, block["pcm"].to_pylist(), [(r["_g0"], r["_g1"]) for r in asked])
            rows, found = [r for r, x in zip(asked, given) if x is not None], [x for x in given if x is not None]
        out = fn(key[0].as_py(), rows, found) if rows else []
        return pa.Table.from_batches(in_batches(iter(out), schema), schema)

    frames = blocks.read(segments.sparkSession).select("file_id", "block", "frame_idx", "pcm")
    return wanted_slices(segments, blocks).groupBy("file_id", "block").cogroup(frames.groupBy("file_id", "block")).applyInArrow(run, ddl)


def slice_stats(segments: DataFrame, blocks: Blocks) -> DataFrame:
    """Sample count and sum of squares per segment; a missing frame between others counts as silence."""
    def stats(file_id, rows, slices):
        wide = [x.astype(np.int64) for x in slices]
        return [(file_id, r["segment_idx"], len(x), int((x * x).sum())) for r, x in zip(rows, wide)]

    schema = pa.schema([("file_id", pa.string()), ("segment_idx", pa.int64()), ("n", pa.int64()), ("s", pa.int64())])
    parts = apply_to_slices(segments, blocks, stats, schema, "file_id string, segment_idx long, n long, s long")
    return parts.groupBy("file_id", "segment_idx").agg(F.sum("n").alias("n_samples"), F.sum("s").alias("sum_sq"))


OUTCOMES_T = [T.StructField("emotion_outcome", T.StringType()), T.StructField("scores", IF.SCORES_T),
              T.StructField("language_outcome", T.StringType()), T.StructField("probs", IF.PROBS_T)]
KEYS_T = [T.StructField("file_id", T.StringType()), T.StructField("segment_idx", T.LongType())]
WHOLE_T = T.StructType(KEYS_T + OUTCOMES_T)
BLOCK_T = T.StructType(KEYS_T + OUTCOMES_T + [T.StructField("offset", T.LongType()), T.StructField("samples", T.BinaryType())])
BLOCK_A = pa.schema([("file_id", pa.string()), ("segment_idx", pa.int64()), ("emotion_outcome", pa.string()), ("scores", IF.payload_arrow("scores")),
                     ("language_outcome", pa.string()), ("probs", IF.payload_arrow("probs")), ("offset", pa.int64()), ("samples", pa.binary())])


def _both(emotion_model: Callable, language_model: Callable, rate: int, batch_size: int):
    """(file ids, segment numbers, int16 slices) -> rows of WHOLE_T; the second model hears the first 30 s."""
    least = rate * S.MIN_SEGMENT_MS // 1000
    scores = IF._outcomes(emotion_model, rate, batch_size, "scores", least)
    probs = IF._outcomes(language_model, rate, batch_size, "probs", least)
    cap = rate * S.LANGUAGE_WINDOW_MS // 1000

    def run(file_ids, idx, slices) -> list[tuple]:
        def through(model, arrays) -> dict[tuple, tuple]:
            rows = zip(file_ids, idx, [x.astype("<i2").tobytes() for x in arrays], [None] * len(arrays))
            return {(f, i): (o, p) for f, i, o, p, _ in model(rows)}

        if not len(idx):
            return []
        e, lang = through(scores, slices), through(probs, [x[:cap] for x in slices])
        return [(f, i, *e[f, i], *lang[f, i]) for f, i in zip(file_ids, idx)]
    return run


def emotion_and_language(segments: DataFrame, blocks: Blocks, emotion_model: Callable, language_model: Callable, batch_size: int = 16) -> DataFrame:
    """Segments with emotion and language of both models, the PCM read once and not shuffled.

    Equals ``infer.classify_emotion`` and ``infer.detect_language`` one after the other.
    Of segments longer than the overlap the pieces go on, to be joined; nothing else does.
    """
    rate, spark = blocks.rate, segments.sparkSession
    short, to_model = gate_short(segments)
    both = _both(emotion_model, language_model, rate, batch_size)

    def in_block(file_id, rows, slices) -> list[tuple]:
        whole = [(r["segment_idx"], x) for r, x in zip(rows, slices) if not r["piece"]]
        heard = both([file_id] * len(whole), [i for i, _ in whole], [x for _, x in whole])
        out = [(*r[:5], IF.payload_cell(r[5]), None, None) for r in heard]
        return out + [(file_id, r["segment_idx"], None, None, None, None, r["offset"], x.astype("<i2").tobytes()) for r, x in zip(rows, slices) if r["piece"]]

    def joined(batches):
        for pdf in batches:
            slices = [AU.place_parts(x, at) for x, at in zip(pdf["samples"], pdf["offsets"])]
            yield pd.DataFrame(both(pdf["file_id"].tolist(), pdf["segment_idx"].tolist(), slices), columns=WHOLE_T.names)

    # written once: what the models say is read for whole segments and for pieces
    path = scratch_path(spark, "block-outcomes")
    apply_to_slices(to_model, blocks, in_block, BLOCK_A, BLOCK_T).write.parquet(path)
    found = spark.read.schema(BLOCK_T).parquet(path)
    pieces = found.where("samples is not null").select("file_id", "segment_idx", F.col("offset").alias("frame_idx"), "offset", "samples")
    long = AU.gather_segments(pieces).mapInPandas(joined, WHOLE_T)
    rows = found.where("samples is null").select(*WHOLE_T.names).unionByName(long)

    names = ["emotion", "emotion_confidence", "language", "language_confidence"]
    e, lang = F.col("emotion_outcome") == "ok", F.col("language_outcome") == "ok"
    top, best = L.top_label(F.col("scores")), L.argmax_map(F.col("probs"))
    labelled = rows.select(
        "file_id", "segment_idx", F.when(e, top["label"]).otherwise(F.col("emotion_outcome")).alias("emotion"),
        F.when(e, F.round(top["score"], 3)).otherwise(F.lit(0.0)).alias("emotion_confidence"),
        F.when(lang, best["label"]).otherwise(F.col("language_outcome")).alias("language"),
        F.when(lang, F.round(best["score"], 3)).otherwise(F.lit(0.0)).alias("language_confidence"))
    none = {"emotion": F.lit(S.TOO_SHORT), "emotion_confidence": F.lit(0.0), "language": F.lit(S.TOO_SHORT), "language_confidence": F.lit(0.0)}
    gated = short.select("file_id", "segment_idx", *[v.alias(c) for c, v in none.items()])
    out = attach_stage(segments, labelled.unionByName(gated), names)
    return out.withColumns({c: F.coalesce(c, none[c]) for c in names})  # a segment without any audio is too short
