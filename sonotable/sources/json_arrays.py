"""Foreign JSON array files, read by byte ranges.

A file is one array, laid out in any way (one line, indented, any white space). It is cut
into ranges of ``chunk_bytes``; each range is read by a task of its own:

1. every range says how it would end (outside a string, inside, behind a backslash) and how
   deep, for each of the three ways it may begin;
2. over one such row per range, the true beginnings follow from range to range;
3. every range then takes the elements whose separator (``[`` or ``,`` of the outer array)
   lies in it, reading on behind its end for the last one, up to ``max_element_bytes``.

A file is taken as a whole or rejected as a whole: it must be an array of objects, closed,
with nothing behind it. Files of no bytes at all are not listed by Spark and are not seen.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonotable.operators.audio import fs_and_path
from sonotable.session import scratch_path

OUTSIDE, INSIDE, ESCAPED = range(3)
_LEAD = {OUTSIDE: b"", INSIDE: b'"', ESCAPED: b'"\\'}
_STRING = rb'"[^"\\]*(?:\\.[^"\\]*)*"'
_STRINGS = re.compile(_STRING, re.DOTALL)
_TOKENS = re.compile(_STRING + rb'|"|[\[\]{},]', re.DOTALL)
_SPACE = " \t\r\n"
RANGE_T = "path string, chunk long, at long, size long, length long"
SUMMARY_T = "path string, chunk long, end0 int, deeper0 long, end1 int, deeper1 long, end2 int, deeper2 long"
ELEMENT_T = "path string, chunk long, place long, element string, error string"
READ_ON = 1 << 16


def summary(data: bytes, state: int) -> tuple[int, int]:
    """State behind ``data`` and the levels it goes deeper, if it begins in ``state``."""
    text = _LEAD[state] + data
    rest = _STRINGS.sub(b"", text)
    cut = rest.find(b'"')
    if cut >= 0:
        state = ESCAPED if (len(text) - len(text.rstrip(b"\\"))) % 2 else INSIDE
        rest = rest[:cut]
    else:
        state = OUTSIDE
    return state, rest.count(b"{") + rest.count(b"[") - rest.count(b"}") - rest.count(b"]")


def first_separator(data: bytes, state: int, depth: int) -> int | None:
    """Bytes up to and with the first comma of the outer array in ``data``."""
    lead = len(_LEAD[state])
    for m in _TOKENS.finditer(_LEAD[state] + data):
        t = m.group()
        if t in (b"{", b"["):
            depth += 1
        elif t in (b"}", b"]"):
            depth -= 1
        elif t == b"," and depth == 1:
            return m.end() - lead
        elif t == b'"':  # a string that goes on behind the range
            return None
    return None


class _Range:
    """A range of a file that can be read on behind its end."""

    def __init__(self, path: str, at: int, size: int, length: int, most: int):
        fs, name = fs_and_path(path)
        self.file, self.at, self.length, self.most = fs.open_input_file(name), at, length, most
        self.file.seek(at)
        self.data = self.file.read(size)
        self.size = len(self.data)

    def more(self) -> bool:
        """Read on; False at the end of the file."""
        if self.at + len(self.data) >= self.length:
            return False
        if len(self.data) - self.size > self.most:
            raise ValueError(f"an element of more than {self.most} bytes")
        self.data += self.file.read(max(READ_ON, len(self.data) - self.size))
        return True

    def text_from(self, start: int) -> str:
        return self.data[start:].decode("utf-8", "surrogateescape")


def elements(r: _Range, state: int, depth: int) -> Iterator[str]:
    """JSON texts of the elements whose separator lies in the range; raises if the file is no closed array of objects."""
    if r.at == 0:
        lead = len(r.data) - len(r.data.lstrip(b"\xef\xbb\xbf \t\r\n"))
        if r.data[lead:lead + 1] != b"[":
            raise ValueError("not an array")
        start, first = lead + 1, True
    else:
        start, first = first_separator(r.data, state, depth), False
        if start is None:
            return
    decode = json.JSONDecoder().raw_decode
    while True:  # one pass per buffer: at its end it is read on, from the last element that was not whole
        text, at, byte = r.text_from(start), 0, start
        while True:
            i = at
            while i < len(text) and text[i] in _SPACE:
                i += 1
            if first and text[i:i + 1] == "]":
                return _closed(r, byte + len(text[at:i + 1].encode("utf-8", "surrogateescape")))
            try:
                value, j = decode(text, i)
            except json.JSONDecodeError as exc:
                problem = exc
                break
            k = j
            while k < len(text) and text[k] in _SPACE:
                k += 1
            if k == len(text):  # the value may go on
                problem = ValueError("the array is not closed")
                break
            if not isinstance(value, dict):
                raise ValueError("an element is no object")
            element = text[i:j]
            element.encode("utf-8")  # raises if the bytes are no UTF-8
            yield element
            first = False
            byte += len(text[at:k + 1].encode("utf-8", "surrogateescape"))
            if text[k] == "]":
                return _closed(r, byte)
            if text[k] != ",":
                raise ValueError(f"{text[k]!r} after an element")
            if byte > r.size:  # the separator lies in the next range
                return
            at = k + 1
        start = byte
        if not r.more():
            raise problem


def _closed(r: _Range, end: int) -> None:
    while True:
        if r.data[end:].strip(b" \t\r\n"):
            raise ValueError("text behind the array")
        r.data, r.at, r.size, end = b"", r.at + len(r.data), 0, 0
        if not r.more():
            return


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for x in pdf.itertuples(index=False):
            data = _Range(x.path, x.at, x.size, x.length, 0).data
            rows.append((x.path, x.chunk, *(v for s in (OUTSIDE, INSIDE, ESCAPED) for v in summary(data, s))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY_T.split(", ")])


def _beginnings(pdf: pd.DataFrame) -> pd.DataFrame:
    """How each range of one file begins: a row per range in, a row per range out."""
    rows, state, depth = [], OUTSIDE, 0
    for x in pdf.sort_values("chunk").itertuples(index=False):
        rows.append((x.path, x.chunk, state, depth))
        state, depth = getattr(x, f"end{state}"), depth + getattr(x, f"deeper{state}")
    return pd.DataFrame(rows, columns=["path", "chunk", "state", "depth"])


def _elements(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                rows, error = [], None
                try:
                    for e in elements(_Range(x.path, x.at, x.size, x.length, most), x.state, x.depth):
                        rows.append((x.path, x.chunk, len(rows), e, None))
                except (ValueError, RecursionError) as exc:
                    error = f"{type(exc).__name__}: {exc}"
                yield pd.DataFrame(rows if error is None else [(x.path, x.chunk, -1, None, error)], columns=["path", "chunk", "place", "element", "error"])
    return run


def read_json_arrays(spark: SparkSession, root: str, chunk_bytes: int = 32 << 20, max_element_bytes: int = 64 << 20, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Array files below ``root`` -> (elements (path, idx, element), rejects (path, error))."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk_bytes).cast("long"))).alias("chunk"))
    ranges = ranges.select("path", "chunk", (F.col("chunk") * chunk_bytes).alias("at"), F.least(F.lit(chunk_bytes).cast("long"), F.col("length") - F.col("chunk") * chunk_bytes).alias("size"), "length")
    spread = ranges.repartition(parts, "path", "chunk")
    begin = spread.mapInPandas(_summaries, SUMMARY_T).groupBy("path").applyInPandas(_beginnings, "path string, chunk long, state int, depth long")
    path = scratch_path(spark, "json-elements")
    read = ranges.join(begin, ["path", "chunk"]).repartition(parts, "path", "chunk").mapInPandas(_elements(max_element_bytes), ELEMENT_T)
    read.write.parquet(path)  # read for the elements, their numbers and the rejects
    found = spark.read.schema(ELEMENT_T).parquet(path)
    bad = found.where("error is not null").groupBy("path").agg(F.min_by("error", "chunk").alias("error"))
    good = found.where("error is null").join(bad.select("path"), "path", "left_anti")
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = good.groupBy("path", "chunk").agg(F.count(F.lit(1)).alias("_n")).select("path", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = good.join(offsets, ["path", "chunk"]).select("path", (F.col("_before") + F.col("place")).cast("long").alias("idx"), "element")
    return numbered, bad
