"""Token files coded with a static range asymmetric numeral system (rANS).

``write_tokens`` lays documents out in ascending ``doc_id`` order (a range shuffle of the
texts, sorted in each part), tokenises them, counts all ids of the corpus into one shared
frequency table and codes the ids in independent blocks. A block interleaves ``LANES``
rANS states; every ``SEGMENT`` ids it keeps a checkpoint (the lane states and the place in
the word stream) and a CRC-32 of the ids up to the next one, so segments decode alone and
in parallel. Files are Parquet tables of block rows, written by Spark's committer; the
frequency table, at most one row per vocabulary entry, lies beside them.

``read_tokens`` decodes every block from the files, verifies the checksums and gives each
document's place. Blocks hold whole documents; a document longer than a block has one to
itself, with more segments. The global start of a document needs only the sums of the
parts, one row per part.

Defined results: null text counts as empty and yields the end id alone; a null ``doc_id``
sorts first; rows with equal ids are ordered by text; other columns are ignored; an empty
table writes a table without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonotable.llm.common import release, select_plain
from sonotable.llm.tokens import coder
from sonotable.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
PRECISION = 20          # frequencies sum to 2**PRECISION
LANES = 2048
SEGMENT = 64 * LANES   # ids between checkpoints
BLOCK_IDS = 4 * SEGMENT
_LOW = np.uint64(1 << 31)

BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("words", T.BinaryType()), T.StructField("states", T.BinaryType()),
    T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("checks", T.ArrayType(T.LongType())),
])


class Table:
    """Frequencies of all ids, scaled to sum to 2**PRECISION, each at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbol

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        total = 1 << PRECISION
        spare = total - len(counts)
        exact = counts * (spare / max(1, counts.sum()))
        freq = np.floor(exact).astype(np.int64) + 1
        short = total - int(freq.sum())
        # what rounding left over goes to the most frequent id
        freq[int(np.argmax(counts))] += short
        return freq


def encode(ids: np.ndarray, table: Table) -> tuple[bytes, bytes, list[int], list[int]]:
    """Word stream, checkpoint states, word offset of each checkpoint, CRC-32 of each segment's ids."""
    n = len(ids)
    steps = -(-n // LANES)
    x = np.full(LANES, _LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    states, taken = [], []
    n_words = 0
    for step in range(steps - 1, -1, -1):
        s = ids[step * LANES:(step + 1) * LANES]
        f, c = table.freq[s], table.start[s]
        y = x[:len(s)]
        full = y >= f << np.uint64(63 - PRECISION)
        if full.any():
            w = y[full].astype(np.uint32)
            out.append(w)
            n_words += len(w)
            y[full] >>= np.uint64(32)
        q = y // f
        x[:len(s)] = (q << np.uint64(PRECISION)) + (y - q * f) + c
        if step * LANES % SEGMENT == 0:
            states.append(x.copy())
            taken.append(n_words)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    places = [n_words - t for t in reversed(taken)]
    checks = [zlib.crc32(ids[a:a + SEGMENT].astype("<u4").tobytes()) for a in range(0, n, SEGMENT)]
    return words.astype("<u4").tobytes(), b"".join(a.astype("<u8").tobytes() for a in reversed(states)), places, checks


def decode_segment(k: int, n_ids: int, words: np.ndarray, states: np.ndarray, places, checks, table: Table) -> np.ndarray:
    """Ids of segment ``k``, from its checkpoint on; raises if they don't match their checksum."""
    x = states[k * LANES:(k + 1) * LANES].astype(np.uint64)
    n = min(SEGMENT, n_ids - k * SEGMENT)
    ids = np.empty(n, dtype=np.uint16)
    at, mask = int(places[k]), np.uint64((1 << PRECISION) - 1)
    for a in range(0, n, LANES):
        m = min(LANES, n - a)
        y = x[:m]
        slot = y & mask
        s = table.symbol[slot]
        ids[a:a + m] = s
        y = table.freq[s] * (y >> np.uint64(PRECISION)) + slot - table.start[s]
        low = y < _LOW
        need = int(np.count_nonzero(low))
        if need:
            y[low] = (y[low] << np.uint64(32)) | words[at:at + need]
            at += need
        x[:m] = y
    if zlib.crc32(ids.astype("<u4").tobytes()) != checks[k]:
        raise ValueError(f"token block: segment {k} does not match its checksum")
    return ids


def _tokenise(tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        end, code = np.array([END_ID], dtype="<u2").tobytes(), coder(tokenizer)
        for pdf in batches:
            ids = [code.encode(t or "").tobytes() + end for t in pdf["text"]]
            lengths = np.array([len(b) // 2 for b in ids], dtype=np.int64)
            starts = at + np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
            at += int(lengths.sum())
            yield pd.DataFrame({"part": part, "at": starts, "doc_id": pdf["doc_id"].astype("Int64"), "ids": ids})
    return run


def _count_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << 16, dtype=np.int64)
    for pdf in batches:
        for b in pdf["ids"]:
            counts += np.bincount(np.frombuffer(b, dtype="<u2"), minlength=1 << 16) if len(b) > 1 << 16 else 0
        small = b"".join(b for b in pdf["ids"] if len(b) <= 1 << 16)
        counts += np.bincount(np.frombuffer(small, dtype="<u2"), minlength=1 << 16)
    ids = np.flatnonzero(counts)
    yield pd.DataFrame({"id": ids.astype(np.int32), "n": counts[ids]})


def _encode_blocks(freq: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(freq)
        held: list[tuple] = []
        n_held = 0

        def block() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(h[3] for h in held), dtype="<u2")
            words, states, places, checks = encode(ids, table)
            return pd.DataFrame({"part": [held[0][0]], "at": [held[0][1]], "n_ids": [len(ids)],
                                 "doc_ids": [[h[2] for h in held]], "lengths": [[len(h[3]) // 2 for h in held]],
                                 "words": [words], "states": [states], "places": [places], "checks": [checks]})

        for pdf in batches:
            for part, at, doc_id, ids in zip(pdf["part"], pdf["at"], pdf["doc_id"], pdf["ids"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                # a block is one unbroken run of a part; its ids are all null or none is
                if held and (part != held[0][0] or at != held[-1][1] + len(held[-1][3]) // 2 or n_held >= BLOCK_IDS or (doc_id is None) != (held[0][2] is None)):
                    yield block()
                    held, n_held = [], 0
                held.append((int(part), int(at), doc_id, ids))
                n_held += len(ids) // 2
        if held:
            yield block()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Write the ids of all documents below ``path``: ``blocks`` and ``frequencies``."""
    spark = docs.sparkSession
    ids_path = scratch_path(spark, "token-ids")
    rows = select_plain(docs, "doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows.mapInPandas(_tokenise(tokenizer), "part int, at long, doc_id long, ids binary").write.option("compression", "zstd").parquet(ids_path)
    del rows
    release(spark)
    ids = spark.read.parquet(ids_path)
    counted = ids.select("ids").mapInPandas(_count_ids, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in counted.collect():  # at most one row per 16-bit id
        counts[r["id"]] = r["n"]
    freq = Table.scaled(counts)
    spark.createDataFrame(pd.DataFrame({"id": np.arange(len(freq), dtype=np.int32), "freq": freq})).coalesce(1).write.parquet(f"{path}/frequencies")
    ids.mapInPandas(_encode_blocks(freq), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _decode_blocks(freq: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(freq)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words, states = np.frombuffer(r.words, dtype="<u4").astype(np.uint64), np.frombuffer(r.states, dtype="<u8")
                ids = np.concatenate([decode_segment(k, r.n_ids, words, states, r.places, r.checks, table) for k in range(len(r.places))])
                ends = np.cumsum(np.asarray(r.lengths, dtype=np.int64))
                wide = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), r.lengths)]
                yield pd.DataFrame({"part": r.part, "doc_id": pd.array([None if d is None or d != d else int(d) for d in r.doc_ids], dtype="Int64"),
                                    "at": r.at + ends - np.asarray(r.lengths), "n_tokens": np.asarray(r.lengths, dtype=np.int64), "ids_crc32": crc})
    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below ``path``."""
    table = spark.read.parquet(f"{path}/frequencies").orderBy("id").toPandas()  # one row per 16-bit id
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per part
    parts = sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    found = blocks.mapInPandas(_decode_blocks(table["freq"].to_numpy()), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(parts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
