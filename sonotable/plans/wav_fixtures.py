"""WAV bytes and files for fixtures and tests: written by Spark expressions or by the tasks that hold the frames."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonotable.operators.audio import fs_and_path, pcm_array
from sonotable.operators.grouped import by_key, in_batches, sorted_groups


def pack_wav_bytes(rate: int, channels: int, mono: np.ndarray) -> bytes:
    """A 16-bit PCM WAV of ``mono`` samples repeated on every channel."""
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(int(channels))
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes(np.repeat(mono.astype("<i2")[:, None], int(channels), axis=1).tobytes())
    return buf.getvalue()


@F.pandas_udf(T.BinaryType())
def wav_from_pcm(rate: pd.Series, channels: pd.Series, pcm: pd.Series) -> pd.Series:
    """WAV bytes from int16 PCM bytes (mono samples copied to each channel)."""
    return pd.Series([pack_wav_bytes(r, c, pcm_array(p)) for r, c, p in zip(rate, channels, pcm)], dtype=object)


def _le(x: Column, nbytes: int) -> Column:
    h = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << (8 * nbytes)))), 2 * nbytes, "0")
    return F.concat(*[F.substring(h, 2 * nbytes - 2 * k - 1, 2) for k in range(nbytes)])


def wav_bytes(rate: Column, channels: Column, n_frames: Column, samples: Column | None = None) -> Column:
    """A 16-bit PCM WAV as BINARY: 44-byte header declaring ``n_frames``, then ``samples`` (interleaved) if given."""
    data_len = n_frames * channels * 2
    header_hex = F.concat(
        F.hex(F.lit("RIFF")), _le(data_len + 36, 4), F.hex(F.lit("WAVEfmt ")), _le(F.lit(16), 4),
        _le(F.lit(1), 2), _le(channels, 2), _le(rate, 4), _le(rate * channels * 2, 4), _le(channels * 2, 2),
        _le(F.lit(16), 2), F.hex(F.lit("data")), _le(data_len, 4),
    )
    if samples is None:
        return F.unhex(header_hex)
    body = F.array_join(F.transform(samples, lambda s: _le(s, 2)), "")
    return F.unhex(F.concat(header_hex, body))


def _write_bytes(path: str, data: bytes) -> None:
    fs, name = fs_and_path(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(data)


def land_wav_clips(frames: DataFrame, folder: str, rate: int, clip_s: int = 60, in_order: bool = False) -> DataFrame:
    """Write audio_frames as mono 16-bit WAV files of ``clip_s`` seconds under ``folder``.

    One group is one clip (at most ``clip_s`` frames), assembled and written by
    the task that holds it, one clip after the other; a retried task rewrites the same bytes to the
    same path. ``in_order`` says that the frames of a clip already come next to each other
    and in order, in one task: they are written where they are made, and no PCM is dealt.
    Returns (file_id, clip, path).
    """
    out = pa.schema([("file_id", pa.string()), ("clip", pa.int64()), ("path", pa.string())])

    def write_clips(batches):
        for (fid, clip), g in sorted_groups(batches, ["file_id", "clip"]):
            path = f"{folder}/{fid}/{clip:06d}.wav"
            _write_bytes(path, pack_wav_bytes(rate, 1, np.concatenate([pcm_array(p) for p in g["pcm"]])))
            yield fid, clip, path

    c = frames.select("file_id", "frame_idx", "pcm", (F.col("frame_idx") / F.lit(clip_s)).cast("long").alias("clip"))
    rows = c if in_order else by_key(c, ["file_id", "clip"], ["frame_idx"])
    return rows.mapInArrow(lambda batches: in_batches(write_clips(batches), out), "file_id string, clip long, path string")


# (sample width, format tag, subformat if extensible, rate, channels) of the constant signals
FORMATS = [(1, 1, 0, 8000, 1), (2, 1, 0, 44100, 2), (3, 1, 0, 44100, 1), (4, 1, 0, 8000, 2), (4, 3, 0, 44100, 1), (8, 3, 0, 16000, 2),
           (4, 0xFFFE, 3, 48000, 1), (3, 0xFFFE, 1, 16000, 1)]


def constant_wav(value: int, width: int, tag: int, sub: int, rate: int, channels: int, seconds: int = 2) -> bytes:
    """A WAV whose samples are all ``value`` on the 16-bit scale."""
    kind = sub if tag == 0xFFFE else tag
    if kind == 3:
        one = np.array([value / 32768.0], dtype="<f4" if width == 4 else "<f8").tobytes()
    elif width == 1:
        one = bytes([value // 256 + 128])
    else:
        one = int(value * 256 ** (width - 2)).to_bytes(width, "little", signed=True)
    data = one * (channels * rate * seconds)
    fmt = b"".join(int(x).to_bytes(n, "little") for x, n in (
        (tag, 2), (channels, 2), (rate, 4), (rate * channels * width, 4), (channels * width, 2), (8 * width, 2)))
    if tag == 0xFFFE:
        fmt += b"".join(int(x).to_bytes(n, "little") for x, n in ((22, 2), (8 * width, 2), (0, 4), (sub, 2))) + bytes(14)
    body = b"WAVE" + b"fmt " + len(fmt).to_bytes(4, "little") + fmt + b"data" + len(data).to_bytes(4, "little") + data
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def land_constant_wavs(users: DataFrame, folder: str) -> DataFrame:
    """One file per user, of a format and a constant by ``user_id``; every ninth is no WAV. Returns (file_id, path)."""
    def write(batches):
        for pdf in batches:
            paths = []
            for user, fid in zip(pdf["user_id"], pdf["file_id"]):
                path = f"{folder}/{fid}.wav"
                value = (user * 37 % 201 - 100) * 256
                _write_bytes(path, b"no audio" if user % 9 == 8 else constant_wav(int(value), *FORMATS[user % 9]))
                paths.append(path)
            yield pd.DataFrame({"file_id": pdf["file_id"], "path": paths})

    return users.mapInPandas(write, "file_id string, path string")


def land_texts(texts: DataFrame, folder: str, suffix: str) -> None:
    """``texts`` (file_id, text) as one file each in ``folder`` (shared storage)."""
    def write(batches):
        for pdf in batches:
            for file_id, text in zip(pdf["file_id"], pdf["text"]):
                _write_bytes(f"{folder}/{file_id}{suffix}", text.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    texts.select("file_id", "text").mapInPandas(write, "n long").agg(F.sum("n")).collect()
