"""WAV files as a data source: ``spark.read.format("wav_frames").load(folder)``.

Columns ``path, file_id, frame_idx, pcm, error``: one-second mono frames at ``target_rate``,
as ``operators.audio.normalised_parts`` gives them, one row with an error per file that is
no uncompressed WAV, and one per range that could not be read. Planning lists the folder and opens no file: files are cut into byte
ranges of ``partition_bytes`` and small ones put together up to that size, so tasks follow
bytes and a long recording is read by many; of more than ``max_tasks`` of these a task takes
several, one after the other. A task walks the header of each file it has a
range of and decodes the chunks (``chunk_s`` seconds) whose first input byte lies in its
range, reading only what they need; it holds one chunk and one batch of frames at a time.

Equality and IN filters on ``file_id`` and ``path`` are applied to the listing, where the
session allows filters to be pushed into Python sources (``wav_frames`` sets the option by
it). The folder has to be one that every executor reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sonotable import schemas as S
from sonotable.operators import audio as AU
from sonotable.operators.grouped import in_batches

NAME = "wav_frames"
SCHEMA = "path string, file_id string, frame_idx bigint, pcm binary, error string"
ARROW = pa.schema([("path", pa.string()), ("file_id", pa.string()), ("frame_idx", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())])
PARTITION_BYTES = 64 << 20
MAX_TASKS = 512
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096  # what is given to Spark at a time
ENDINGS = (".wav", ".wave")


@dataclass
class Ranges(InputPartition):
    """(path, file_id, first byte, byte behind the last) of what one task reads."""

    parts: list[tuple[str, str, int, int]]


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def packed(files: list[tuple[str, int]], partition_bytes: int) -> Iterator[Ranges]:
    """Ranges of at most ``partition_bytes``; a part holds one range of a large file or several small files."""
    parts, held = [], 0
    for path, size in files:
        for start in range(0, max(size, 1), partition_bytes):
            end = min(start + partition_bytes, size)
            if parts and held + end - start > partition_bytes:
                yield Ranges(parts)
                parts, held = [], 0
            parts.append((path, stem(path), start, end))
            held += end - start
    if parts:
        yield Ranges(parts)


def dealt(ranges: list[Ranges], max_tasks: int) -> Iterator[Ranges]:
    """The same parts in at most ``max_tasks`` tasks: where there are more, each takes as many neighbours as the others."""
    n = min(len(ranges), max_tasks)
    for k in range(n):
        yield Ranges([part for r in ranges[k * len(ranges) // n:(k + 1) * len(ranges) // n] for part in r.parts])


def first_bytes(layout: tuple, target: int, chunk_s: int) -> Iterator[tuple[int, int]]:
    """(chunk, place of its first input byte in the file) of a recording, at least chunk 0."""
    rate, channels, width, _, offset, n_in = layout
    chunks = max(1, -(-(n_in * target // rate) // (target * chunk_s)))
    for chunk in range(chunks):
        yield chunk, offset + chunk * chunk_s * rate * channels * width


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.target = int(options.get("target_rate", S.SAMPLE_RATE))
        self.chunk_s = int(options.get("chunk_s", AU.CHUNK_S))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.max_tasks = int(options.get("max_tasks", MAX_TASKS))
        if min(self.target, self.chunk_s, self.partition_bytes, self.max_tasks) < 1:
            raise ValueError("target_rate, chunk_s, partition_bytes and max_tasks must be positive")
        self.only: list[tuple[str, set]] = []

    def _files(self) -> list[tuple[str, int]]:
        import pyarrow.fs as pafs

        fs, name = AU.fs_and_path(self.root)
        prefix = self.root[: len(self.root) - len(name)] if self.root.endswith(name) else ""
        info = fs.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(name, recursive=True))
        found = [(prefix + f.path, f.size) for f in infos if f.type == pafs.FileType.File and f.path.lower().endswith(ENDINGS)]
        value = {"path": lambda p: p, "file_id": stem}
        return sorted((p, n) for p, n in found if all(value[c](p) in allowed for c, allowed in self.only))

    def partitions(self) -> list[Ranges]:
        return list(dealt(list(packed(self._files(), self.partition_bytes)), self.max_tasks)) or [Ranges([])]

    def _frames(self, path: str, start: int, end: int) -> Iterator[list[tuple[int, bytes | None, str | None]]]:
        try:
            with AU._open(path) as fh:
                layout = AU.riff_layout(fh)
                if layout is None:
                    if start == 0:  # told once a file
                        yield [(-1, None, "not an uncompressed WAV file")]
                    return
                for chunk, at in first_bytes(layout, self.target, self.chunk_s):
                    # the first chunk lies in the range that has the header
                    if start == 0 if chunk == 0 else start <= at < end:
                        yield [(i, pcm, None) for i, pcm in AU.chunk_frames(fh, layout, chunk, self.target, self.chunk_s)]
        except Exception as exc:  # noqa: BLE001 - a range that cannot be read is a row, not a failed task
            yield [(-1, None, f"{type(exc).__name__}: {exc}")]

    def _rows(self, partition: Ranges) -> Iterator[tuple]:
        for path, file_id, start, end in partition.parts:
            for rows in self._frames(path, start, end):
                for index, pcm, error in rows:
                    yield path, file_id, index, pcm, error

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        part, held = [], 0
        for row in self._rows(partition):
            part.append(row)
            held += len(row[3] or b"")
            if held >= BATCH_BYTES or len(part) >= BATCH_ROWS:
                yield from in_batches(iter(part), ARROW, BATCH_ROWS)
                part, held = [], 0
        yield from in_batches(iter(part), ARROW, BATCH_ROWS)


class PruningWavReader(WavReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("file_id",), ("path",)):
                self.only.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return (PruningWavReader if self.options.get("prune") == "true" else WavReader)(dict(self.options))


def wav_frames(spark: SparkSession, root: str, **options) -> DataFrame:
    """Frames and rejects of the WAV files under ``root``; options ``target_rate``, ``chunk_s``, ``partition_bytes``, ``max_tasks``."""
    spark.dataSource.register(WavSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(prune=prune, **options).load(root)
