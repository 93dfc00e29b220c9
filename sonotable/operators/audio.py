"""Audio tables: landing scan facts, validation, normalisation into frames, and
cutting segments out of frames.

Audio lives in ``audio_frames(file_id, frame_idx, pcm BINARY)``: one row per
second of 16-bit little-endian mono PCM (2 bytes a sample: compact in parquet
and handed to numpy without copies through Arrow). A segment's samples are found with an *equi*
join on (file_id, frame_idx) after exploding each segment into the frame
numbers it overlaps, so no theta/range join is needed and a long recording is
spread over its frame numbers instead of one key.
"""

from __future__ import annotations

import functools
import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonotable import schemas as S
from sonotable.session import scratch_path

# ---------------------------------------------------------------------------
# J4: segment x frames
# ---------------------------------------------------------------------------


def slice_bounds(start_ms: Column, end_ms: Column, rate: int, max_ms: int | None = None) -> tuple[Column, Column]:
    """First and past-the-end global sample numbers of [start_ms, end_ms) at ``rate``.

    Sample g sits at g*1000/rate ms; it belongs to the segment when
    start_ms <= g*1000/rate < end_ms. ``max_ms`` keeps only the first part.
    """
    end = F.least(end_ms, start_ms + F.lit(max_ms)) if max_ms else end_ms
    g0 = F.floor((start_ms * F.lit(rate) + F.lit(999)) / F.lit(1000)).cast("long")
    g1 = F.floor((end * F.lit(rate) + F.lit(999)) / F.lit(1000)).cast("long")
    return g0, g1


def segment_frames(segments: DataFrame, rate: int, max_ms: int | None = None) -> DataFrame:
    """Explode each segment into the frame numbers holding its samples (g0, g1 carried along)."""
    g0, g1 = slice_bounds(F.col("start_ms"), F.col("end_ms"), rate, max_ms)
    s = segments.select("file_id", "segment_idx", g0.alias("_g0"), g1.alias("_g1")).where(F.col("_g1") > F.col("_g0"))
    return s.select(
        "*", F.explode(F.sequence(F.floor(F.col("_g0") / rate).cast("long"), F.floor((F.col("_g1") - 1) / rate).cast("long"))).alias("frame_idx")
    )


def slice_segments(segments: DataFrame, frames: DataFrame, rate: int, max_ms: int | None = None) -> DataFrame:
    """(file_id, segment_idx, frame_idx, samples): the part of each frame inside each segment."""
    sf = segment_frames(segments, rate, max_ms)
    # frames grow with the data and must never be broadcast: shuffle both sides on
    # (file_id, frame_idx) and hash the narrow segment-frame rows, streaming the PCM
    j = sf.hint("shuffle_hash").join(frames.select("file_id", "frame_idx", "pcm"), ["file_id", "frame_idx"])
    base = F.col("frame_idx") * rate
    lo = F.greatest(F.col("_g0") - base, F.lit(0))
    hi = F.least(F.col("_g1") - base, (F.length("pcm") / 2).cast("long"))
    return j.where(hi > lo).select(
        "file_id", "segment_idx", "frame_idx",
        (base + lo - F.col("_g0")).alias("offset"),  # first sample of this part, counted from the segment start
        F.col("pcm").substr((lo * 2 + 1).cast("int"), ((hi - lo) * 2).cast("int")).alias("samples"),
    )


PCM_STATS = T.StructType([
    T.StructField("n_samples", T.LongType()),
    T.StructField("sample_sum", T.LongType()),
    T.StructField("sum_sq", T.LongType()),
])


def place_parts(parts, offsets) -> np.ndarray:
    """Join PCM parts at their sample offsets; a gap between parts (missing frame) is silence."""
    arrs = [pcm_array(p) for p in parts]
    if offsets is None:
        return np.concatenate(arrs) if arrs else np.zeros(0, dtype=np.int16)
    offs = [int(o) for o in offsets]
    buf = np.zeros(max((o + len(a) for o, a in zip(offs, arrs)), default=0), dtype=np.int16)
    for o, a in zip(offs, arrs):
        buf[o : o + len(a)] = a
    return buf


def pcm_array(x) -> np.ndarray:
    """int16 samples of a PCM cell: bytes, a list of byte parts, or a list of ints."""
    if x is None:
        return np.zeros(0, dtype=np.int16)
    if isinstance(x, (bytes, bytearray, memoryview)):
        return np.frombuffer(x, dtype="<i2")
    if len(x) and isinstance(x[0], (bytes, bytearray, memoryview)):
        return np.frombuffer(b"".join(bytes(p) for p in x), dtype="<i2")
    return np.asarray(x, dtype=np.int16)


@F.pandas_udf(PCM_STATS)
def pcm_stats(pcm: pd.Series) -> pd.DataFrame:
    """Sample count, sum and sum of squares of int16 PCM bytes (numpy per Arrow batch)."""
    n, s1, s2 = [], [], []
    for b in pcm:
        a = pcm_array(b).astype(np.int64)
        n.append(len(a)), s1.append(int(a.sum())), s2.append(int((a * a).sum()))
    return pd.DataFrame({"n_samples": n, "sample_sum": s1, "sum_sq": s2})


def slice_stats(slices: DataFrame) -> DataFrame:
    """Sample count and integer sum of squares per segment (partial sums per frame, combined map-side)."""
    per = slices.select("file_id", "segment_idx", pcm_stats("samples").alias("_s"))
    return per.groupBy("file_id", "segment_idx").agg(
        F.sum("_s.n_samples").cast("long").alias("n_samples"), F.sum("_s.sum_sq").cast("long").alias("sum_sq")
    )


def gather_segments(slices: DataFrame) -> DataFrame:
    """(file_id, segment_idx, samples ARRAY<BINARY>): a segment's PCM parts in time order.

    The group is one segment: bounded by the segment's own length (and by
    ``max_ms`` when the slicing was capped), never by the file. The parts are
    joined only inside the Python worker that feeds the model.
    """
    g = slices.groupBy("file_id", "segment_idx").agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", "offset", "samples"))).alias("_parts")
    )
    return g.select(
        "file_id", "segment_idx",
        F.transform("_parts", lambda p: p["samples"]).alias("samples"),
        F.transform("_parts", lambda p: p["offset"]).alias("offsets"),
    )


# ---------------------------------------------------------------------------
# M5: WAV header facts
# ---------------------------------------------------------------------------


def parse_wav_header(blob: bytes | None) -> tuple | None:
    """(sample_rate, channels, n_frames, sample_width) of a WAV header prefix, or None."""
    if blob is None:
        return None
    try:
        with wave.open(io.BytesIO(bytes(blob)), "rb") as w:
            return (w.getframerate(), w.getnchannels(), w.getnframes(), w.getsampwidth())
    except Exception:  # noqa: BLE001 - unreadable is a value here
        return None


@F.pandas_udf(S.WAV_FACTS)
def wav_header(content: pd.Series) -> pd.DataFrame:
    """Arrow-batched header read; null facts when unreadable. Only the header bytes are used."""
    rows = [parse_wav_header(b) for b in content]
    return pd.DataFrame(
        {
            "sample_rate": pd.array([r[0] if r else None for r in rows], dtype="Int32"),
            "channels": pd.array([r[1] if r else None for r in rows], dtype="Int32"),
            "n_frames": pd.array([r[2] if r else None for r in rows], dtype="Int64"),
            "sample_width": pd.array([r[3] if r else None for r in rows], dtype="Int32"),
        }
    )


def _local_path(uri: str) -> str:
    if uri.startswith("file:"):
        rest = uri[5:]
        while rest.startswith("//"):
            rest = rest[1:]
        return rest
    return uri


def fs_and_path(uri: str):
    """pyarrow file system and path for a Spark path (local, file:, s3a/s3n as s3, other schemes as given)."""
    import pyarrow.fs as pafs

    if uri.startswith("file:") or uri.startswith("/"):
        return pafs.LocalFileSystem(), _local_path(uri)
    for hadoop_scheme in ("s3a://", "s3n://"):
        if uri.startswith(hadoop_scheme):
            uri = "s3://" + uri[len(hadoop_scheme):]
    return pafs.FileSystem.from_uri(uri)


def read_audio(spark, root: str, formats=S.AUDIO_FORMATS, with_content: bool = False) -> DataFrame:
    """Landed audio files under ``root`` -> (path, file_id, ext, length, modificationTime[, content]).

    Without ``content`` Spark lists files and never opens them.
    """
    from sonotable.functions import ids as I

    glob = "*.{" + ",".join(formats) + "}"
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    cols = [
        "path",
        I.path_stem(F.col("path")).alias("file_id"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"),
        "length",
        "modificationTime",
    ]
    if with_content:
        cols.append("content")
    return df.select(*cols)


def audio_headers(files: DataFrame) -> DataFrame:
    """Header facts per landed file (sample_rate, channels, n_frames, sample_width; null when
    unreadable), from a chunk walk that reads only chunk headers, never the audio."""
    w = wav_layout_of_path(F.col("path"))
    return files.withColumn("h", w).select(
        "*", F.col("h.sample_rate").alias("sample_rate"), F.col("h.channels").alias("channels"),
        F.col("h.n_frames").alias("n_frames"), F.col("h.sample_width").alias("sample_width"),
    ).drop("h")


# ---------------------------------------------------------------------------
# P5: validation
# ---------------------------------------------------------------------------


def validate_audio(headers: DataFrame) -> DataFrame:
    """Add ``problems`` and ``warnings`` arrays and ``valid`` (= no problem).

    Problems: unreadable, rate != 16000, channels != 1, duration < 1 s.
    Warning: duration < 30 s (still valid).
    """
    rate, ch, n = F.col("sample_rate"), F.col("channels"), F.col("n_frames")
    readable = rate.isNotNull() & (rate > 0)
    dur_ms = F.when(readable, F.floor(n * 1000 / rate))
    probs = F.array(
        F.when(~readable | rate.isNull(), F.lit("unreadable")),
        F.when(readable & (rate != S.SAMPLE_RATE), F.lit("sample_rate")),
        F.when(readable & (ch != S.MONO_CHANNELS), F.lit("channels")),
        F.when(readable & (n * 1000 < rate * S.MIN_AUDIO_MS), F.lit("too_short")),
    )
    warns = F.array(F.when(readable & (n * 1000 < rate * S.SHORT_AUDIO_MS), F.lit("short_audio")))
    problems = F.filter(probs, lambda x: x.isNotNull())
    return headers.select(
        "*",
        dur_ms.cast("long").alias("duration_ms"),
        problems.alias("problems"),
        F.filter(warns, lambda x: x.isNotNull()).alias("warnings"),
        (F.size(problems) == 0).alias("valid"),
    )


def todo_audio(inputs: DataFrame, valid_audio: DataFrame) -> DataFrame:
    """Inputs without a valid normalised WAV yet (a valid one is reused)."""
    ok = valid_audio.where(F.col("valid")).select("file_id").distinct()
    return inputs.join(ok, "file_id", "left_anti")


# ---------------------------------------------------------------------------
# M4: normalise WAV audio into 1 s mono frames at the target rate
# ---------------------------------------------------------------------------

FRAMES_OUT = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("pcm", T.BinaryType()),
    T.StructField("error", T.StringType()),
])

WAV_LAYOUT = T.StructType([
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("sample_width", T.IntegerType()),
    T.StructField("sample_format", T.StringType()),
    T.StructField("data_offset", T.LongType()),
    T.StructField("n_frames", T.LongType()),
])

# Format tags of a RIFF ``fmt `` chunk.
TAG_INT, TAG_FLOAT, TAG_EXTENSIBLE = 1, 3, 0xFFFE
CHUNK_S = 60
TASK_BYTES = 128 << 20   # read and written by one task
CHUNK_BYTES = 128 << 10  # what opening a file for a chunk is counted as
SINC_ZEROS = 16  # zero crossings of the low-pass kernel on each side


class _Bytes:
    """A WAV held in memory, with the two calls that a random-access file has."""

    def __init__(self, data: bytes):
        self.data = bytes(data)

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, offset: int) -> bytes:
        return self.data[offset:offset + n]


def _open(path: str):
    fs, name = fs_and_path(path)
    return fs.open_input_file(name)


def riff_layout(fh) -> tuple | None:
    """(rate, channels, sample_width, sample_format, data_offset, n_frames) of an uncompressed WAV.

    Only chunk headers and the ``fmt `` body are read; other chunks are skipped by
    seeking, however large. The extensible form names its real format in a subformat.
    """
    import struct

    size = fh.size()
    head = fh.read_at(12, 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    pos, fmt = 12, None
    while pos + 8 <= size:
        ch = fh.read_at(8, pos)
        cid, csize = ch[:4], int.from_bytes(ch[4:8], "little")
        body = pos + 8
        if cid == b"fmt ":
            raw = fh.read_at(min(csize, 40), body)
            tag, chans, rate, _br, align, _bits = struct.unpack("<HHIIHH", raw[:16])
            if tag == TAG_EXTENSIBLE:
                tag = int.from_bytes(raw[24:26], "little") if len(raw) >= 26 else 0
            if tag not in (TAG_INT, TAG_FLOAT) or chans == 0 or align == 0 or rate == 0:
                return None
            width, kind = align // chans, "float" if tag == TAG_FLOAT else "int"
            if width not in ((4, 8) if kind == "float" else (1, 2, 3, 4)):
                return None
            fmt = (rate, chans, width, kind)
        elif cid == b"data":
            if fmt is None:
                return None
            avail = min(csize, size - body)  # a truncated data chunk holds what is there
            return (*fmt, body, avail // (fmt[1] * fmt[2]))
        pos = body + csize + (csize & 1)
    return None


def riff_walk(path: str) -> tuple | None:
    try:
        with _open(path) as fh:
            return riff_layout(fh)
    except Exception:  # noqa: BLE001 - unreadable is a value here
        return None


@F.pandas_udf(WAV_LAYOUT)
def wav_layout_of_path(path: pd.Series) -> pd.DataFrame:
    """Layout of each WAV file by walking its chunks on the executor (reads overlap per batch)."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=16) as pool:
        rows = list(pool.map(riff_walk, list(path)))
    dtypes = {"sample_rate": "Int32", "channels": "Int32", "sample_width": "Int32", "sample_format": "object", "data_offset": "Int64", "n_frames": "Int64"}
    return pd.DataFrame({c: pd.array([r[i] if r else None for r in rows], dtype=d) for i, (c, d) in enumerate(dtypes.items())})


def decode_samples(raw: bytes, channels: int, width: int, kind: str = "int") -> np.ndarray:
    """Mono samples on the 16-bit scale (float64), channels averaged."""
    if kind == "float":
        x = np.frombuffer(raw, dtype="<f4" if width == 4 else "<f8").astype(np.float64) * 32768.0
    elif width == 1:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128.0) * 256.0
    elif width == 3:
        b = np.frombuffer(raw[:len(raw) // 3 * 3], dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64) / 256.0
    else:
        x = np.frombuffer(raw, dtype="<i2" if width == 2 else "<i4").astype(np.float64) / (1.0 if width == 2 else 65536.0)
    return x[: (len(x) // channels) * channels].reshape(-1, channels).mean(axis=1)


def resample(x: np.ndarray, first: int, n_in: int, lo: int, hi: int, rate: int, target: int) -> np.ndarray:
    """Output samples ``lo`` to ``hi`` from the input samples ``x``, which start at ``first`` of ``n_in``.

    Positions count from the start of the recording, so chunks join without a seam. A
    lower rate goes through a Hann-windowed sinc that cuts above half the target rate
    (its weights sum to one at the ends of the recording, too); a higher one is
    interpolated linearly.
    """
    if rate < target:
        t = np.arange(lo, hi, dtype=np.float64) * (rate / target)
        return np.interp(t, np.arange(first, first + len(x), dtype=np.float64), x)
    base, weights, sums = _sinc_weights(rate, target)
    phases, taps = weights.shape
    n = np.arange(lo, hi, dtype=np.int64)
    if not len(n):
        return np.zeros(0)
    phase = n % phases
    at = n // phases * (rate // math.gcd(rate, target)) + base[phase] - taps // 2 + 1  # first input sample of each output
    x = np.pad(x[max(0, at[0] - first):], (max(0, first - at[0]), max(0, at[-1] + taps - first - len(x))))
    heard = np.lib.stride_tricks.sliding_window_view(x, taps)
    at0 = at - at[0]
    total = np.empty(len(n))
    if len(n) >= 16 * phases:  # outputs of one phase share their weights
        for k in range(phases):
            total[k::phases] = heard[at0[k::phases]] @ weights[phase[k]]
    else:
        step = max(1, (1 << 20) // taps)
        for k in range(0, len(n), step):
            total[k:k + step] = np.einsum("ij,ij->i", heard[at0[k:k + step]], weights[phase[k:k + step]])
    weight = sums[phase]
    for k in np.flatnonzero((at < 0) | (at + taps > n_in)).tolist():  # at the ends of the recording
        weight[k] = weights[phase[k], max(0, -at[k]):n_in - at[k]].sum()
    return total / weight


@functools.lru_cache(maxsize=8)
def _sinc_weights(rate: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every phase of the output: the whole input place, the weights of the input samples around it, and their sum.

    Output n sits at input n * rate / target: places repeat after target / gcd outputs.
    """
    phases = target // math.gcd(rate, target)
    cut = target / rate
    half = int(np.ceil(SINC_ZEROS / cut))
    place = np.arange(phases, dtype=np.int64) * rate
    base = place // target
    u = ((place - base * target) / target)[:, None] - np.arange(-half + 1, half + 1)
    weights = np.sinc(u * cut) * (0.5 + 0.5 * np.cos(np.pi * np.clip(u / half, -1, 1)))
    return base, weights, weights.sum(axis=1)


def _input_range(lo: int, hi: int, n_in: int, rate: int, target: int) -> tuple[int, int]:
    """Input samples that output samples ``lo`` to ``hi`` need."""
    if rate == target:
        return lo, hi
    reach = 2 if rate < target else int(np.ceil(SINC_ZEROS * rate / target)) + 1
    return max(0, lo * rate // target - reach), min(n_in, -(-hi * rate // target) + reach)


def chunk_frames(fh, layout: tuple, chunk: int, target: int, chunk_s: int) -> Iterator[tuple[int, bytes]]:
    """(frame_idx, pcm) of one chunk of a recording, reading only the bytes it needs."""
    rate, channels, width, kind, offset, n_in = layout
    n_out = n_in * target // rate
    lo, hi = chunk * target * chunk_s, min((chunk + 1) * target * chunk_s, n_out)
    y = np.zeros(0, dtype=np.int16)
    if hi > lo:
        a, z = _input_range(lo, hi, n_in, rate, target)
        align = channels * width
        x = decode_samples(fh.read_at((z - a) * align, offset + a * align), channels, width, kind)
        x = x if rate == target else resample(x, a, n_in, lo, hi, rate, target)
        y = np.clip(np.rint(x), -32768, 32767).astype("<i2")
    for k in range(0, max(len(y), 1), target):
        yield chunk * chunk_s + k // target, y[k:k + target].tobytes()


def _rows_of(parts) -> pd.DataFrame:
    """parts: (file_id, thunk yielding (frame_idx, pcm)); a part that raises is one row with its error."""
    out: list[tuple] = []
    for fid, frames in parts:
        try:
            out += [(fid, i, pcm, None) for i, pcm in frames()]
        except Exception as exc:  # noqa: BLE001 - a bad part is a row, not a failed task
            out.append((fid, -1, None, f"{type(exc).__name__}: {exc}"))
    return pd.DataFrame(out, columns=["file_id", "frame_idx", "pcm", "error"])


def _split(out: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
    """(frames, rejects) of decoded parts; with ``keep`` written once to the shared folder so that neither decodes again."""
    if keep:
        path = scratch_path(out.sparkSession, "decoded")
        out.write.parquet(path)
        out = out.sparkSession.read.schema(FRAMES_OUT).parquet(path)
    return out.where(F.col("error").isNull()).drop("error"), out.where(F.col("error").isNotNull()).select("file_id", "error")


def normalise_pcm(audio: DataFrame, target_rate: int = S.SAMPLE_RATE, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(file_id, content) WAV rows -> (audio_frames, rejects): for clips that are already columns.

    Decoded chunk by chunk like files are, so what is expanded at a time is one chunk.
    ``keep`` as in ``normalise_wav_files``.
    """
    def parts(content):
        def frames():
            fh = _Bytes(content)
            layout = riff_layout(fh)
            if layout is None:
                raise ValueError("not an uncompressed WAV")
            n_out = layout[5] * target_rate // layout[0]
            for chunk in range(max(1, -(-n_out // (target_rate * CHUNK_S)))):
                yield from chunk_frames(fh, layout, chunk, target_rate, CHUNK_S)
        return frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _rows_of((fid, parts(content)) for fid, content in zip(pdf["file_id"], pdf["content"]))

    return _split(audio.select("file_id", "content").mapInPandas(run, FRAMES_OUT), keep)


def normalised_parts(files: DataFrame, target_rate: int = S.SAMPLE_RATE, chunk_s: int = CHUNK_S) -> DataFrame:
    """(file_id, path) of WAV files -> (file_id, frame_idx, pcm, error), never holding a whole file.

    Only each file's header is read to plan it; the output is cut into chunks of
    ``chunk_s`` seconds, one narrow row per chunk, range-partitioned by (file_id, chunk) so
    that a long recording is spread over tasks and frames come out in file order. Each task
    reads just the bytes its chunk needs. What cannot be decoded is a row with an error.
    """
    lay = files.select("file_id", "path", wav_layout_of_path(F.col("path")).alias("w")).select("file_id", "path", "w.*")
    path = scratch_path(files.sparkSession, "wav-layout")  # headers are read once; range bounds come from narrow rows
    lay.write.parquet(path)
    lay = files.sparkSession.read.schema(lay.schema).parquet(path)
    bad = lay.where(F.col("sample_rate").isNull()).select(
        "file_id", F.lit(-1).cast("long").alias("frame_idx"), F.lit(None).cast("binary").alias("pcm"), F.lit("not an uncompressed WAV file").alias("error"))
    ok = lay.where(F.col("sample_rate").isNotNull()).withColumn(
        "n_out", F.floor(F.col("n_frames") * F.lit(target_rate) / F.col("sample_rate")).cast("long"))
    last_chunk = F.greatest(F.ceil(F.col("n_out") / F.lit(target_rate * chunk_s)).cast("long") - 1, F.lit(0).cast("long"))
    # a narrow row stands for a minute of audio: the number of tasks follows the bytes that chunks read and give, not those of their rows
    moved = F.col("n_frames") * F.col("channels") * F.col("sample_width") + F.col("n_out") * 2 + (last_chunk + 1) * CHUNK_BYTES
    n_chunks, n_bytes = ok.agg(F.coalesce(F.sum(last_chunk + 1), F.lit(1)), F.coalesce(F.sum(moved), F.lit(0))).first()
    tasks = max(min(n_chunks, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n_bytes // TASK_BYTES))
    chunks = ok.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("chunk")).repartitionByRange(tasks, "file_id", "chunk")

    def part(r):
        def frames():
            with _open(r.path) as fh:
                layout = (int(r.sample_rate), int(r.channels), int(r.sample_width), r.sample_format, int(r.data_offset), int(r.n_frames))
                yield from chunk_frames(fh, layout, int(r.chunk), target_rate, chunk_s)
        return frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _rows_of((r.file_id, part(r)) for r in pdf.itertuples(index=False))

    return chunks.mapInPandas(run, FRAMES_OUT).unionByName(bad)


def normalise_wav_files(files: DataFrame, target_rate: int = S.SAMPLE_RATE, chunk_s: int = CHUNK_S,
                        keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(file_id, path) of WAV files -> (audio_frames, rejects); see ``normalised_parts``.

    ``keep`` writes what is decoded to the shared folder, for callers that read it more than
    once. Without it nothing is written, and every reading of frames or rejects decodes.
    """
    return _split(normalised_parts(files, target_rate, chunk_s), keep)
