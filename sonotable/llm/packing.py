"""Best-fit packing of tokenised documents into fixed-size sequences by bin completion.

Documents longer than a sequence are cut: the first piece takes the remainder, all others
are full and need no packing. What is left is a bin-packing problem in which only the
*lengths* matter, and there are fewer than ``size`` of them. So the tasks reduce all
pieces to a histogram (at most ``size - 1`` rows, whatever the corpus), the branch and
bound runs on that histogram, and its answer, patterns of lengths with a number of
repeats, is applied to the pieces by the tasks again.

Bin completion: a node takes the largest length left and enumerates the undominated
fillings of the room beside it, best fit first; a filling is used for as many bins as its
lengths allow, so a path has at most as many nodes as there are lengths. Waste already
made prunes a node against the best packing so far. The first descent is the best-fit
solution and the first incumbent. The search ends when the incumbent meets the lower bound or after ``max_nodes`` nodes; that limits
the effort for the last few bins, not what is packed.

Placement: the r-th piece of a length (ranked within salted parts of each length, so that
a frequent length is spread over tasks) takes the r-th slot the patterns give that length.

Defined results: null text counts as empty (the separator alone); rows that repeat both
id and text are packed as separate documents; a null ``doc_id`` is kept; other columns
are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonotable.llm.common import select_plain, written
from sonotable.llm.tokens import coder

TOKENIZER = "byte_bpe_50k.json"
SIZE = 2048
SEPARATOR = 0
SALTS = 64


# ---- branch and bound on a histogram of lengths -------------------------------------------------

def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of Martello and Toth's L2 bounds. counts[l]: pieces of length l."""
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // size)
    for k in range(1, size // 2 + 1):
        large = int(counts[size - k + 1:].sum())
        middle = slice(size // 2 + 1, size - k + 1)
        n_mid, room = int(counts[middle].sum()), 0
        room = n_mid * size - int((counts[middle] * lengths[middle]).sum())
        small = slice(k, size // 2 + 1)
        rest = int((counts[small] * lengths[small]).sum()) - room
        best = max(best, large + n_mid + max(0, -(-rest // size)))
    return best


def fillings(counts: list[int], room: int, limit: int) -> list[tuple[int, ...]]:
    """Up to ``limit`` fillings of ``room``, least waste first, then those of fewer and larger pieces.

    Pieces are chosen in falling order, equal ones as one run (length, count), so the stack
    is as deep as there are lengths. A filling is dominated, and left out, if its room still
    takes another piece: the fuller one is listed instead.
    """
    lengths = [n for n in range(min(room, len(counts) - 1), 0, -1) if counts[n]]
    if not lengths:
        return [()]
    smaller = [0] * (len(lengths) + 1)  # all pieces from each length on
    for i in range(len(lengths) - 1, -1, -1):
        smaller[i] = smaller[i + 1] + lengths[i] * counts[lengths[i]]
    found: list[tuple[int, int, list[tuple[int, int]]]] = []
    least = room + 1
    steps = 0
    runs: list[tuple[int, int]] = []  # (place in lengths, count)
    at = 0
    while True:
        for i in range(at, len(lengths)):  # as many as fit of each length
            k = min(room // lengths[i], counts[lengths[i]])
            if k:
                runs.append((i, k))
                room -= k * lengths[i]
                steps += 1
            if room < lengths[-1]:
                break
        taken = dict(runs)
        if not any(counts[n] > taken.get(i, 0) for i, n in enumerate(lengths) if n <= room):
            found.append((room, sum(taken.values()), list(runs)))
            least = min(least, room)
        if steps >= 4000 or steps > 400 and found or least == 0 and len(found) >= limit:
            break
        while runs:  # one less of the last run, if smaller pieces can take its place
            i, k = runs.pop()
            room += lengths[i]
            if room - smaller[i + 1] < lengths[i]:
                if k > 1:
                    runs.append((i, k - 1))
                at = i + 1
                break
            room += (k - 1) * lengths[i]
        else:
            break
    found.sort(key=lambda x: x[:2])
    return [tuple(lengths[i] for i, k in r for _ in range(k)) for _, _, r in found[:limit]]


def plan(counts: np.ndarray, size: int, max_nodes: int = 20_000, branch: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (falling lengths) and how many bins each fills; together they use up ``counts``."""
    bound = lower_bound(counts, size)
    total = int((counts * np.arange(len(counts))).sum())
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins = 1 << 62
    left = [int(c) for c in counts]
    path: list[tuple[tuple[int, ...], int]] = []
    nodes = 0

    def children() -> Iterator[tuple[int, ...]]:
        largest = next((n for n in range(len(left) - 1, 0, -1) if left[n]), 0)
        if not largest:
            return iter(())
        left[largest] -= 1
        options = fillings(left, size - largest, branch)
        left[largest] += 1
        return iter([(largest, *c) for c in options])

    stack = [children()]
    waste = [0]
    while stack:
        pattern = next(stack[-1], None)
        if pattern is None or (best is not None and (best_bins <= bound or nodes >= max_nodes)):
            stack.pop()
            waste.pop()
            if path and len(path) == len(stack):
                used, times = path.pop()
                for n in used:
                    left[n] += times
            continue
        nodes += 1
        times = min(left[n] // pattern.count(n) for n in set(pattern))
        made = waste[-1] + times * (size - sum(pattern))
        # bins so far and to come hold all tokens plus all waste
        if best is not None and -(-(total + made) // size) >= best_bins:
            continue
        for n in pattern:
            left[n] -= times
        path.append((pattern, times))
        if any(left):
            stack.append(children())
            waste.append(made)
            continue
        bins = sum(t for _, t in path)
        if bins < best_bins:
            best, best_bins = list(path), bins
        used, times = path.pop()
        for n in used:
            left[n] += times
    return best or []


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each of its runs of slots."""
    taken: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            runs.setdefault(n, []).append((taken.get(n, 0), first, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        first += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in runs.items()}


# ---- the job -------------------------------------------------------------------------------------

def _pieces(tokenizer: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(tokenizer)
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                wide = memoryview(code.encode(text or "").astype("<u4").tobytes() + end)
                n = len(wide) // 4
                cuts = [0, *range(n % size or min(size, n), n + 1, size)]
                out += [(doc_id, k, a, b - a, zlib.crc32(wide[4 * a:4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            rows = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            rows["doc_id"] = rows["doc_id"].astype("Int64")
            yield rows
    return run


def _place(found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                ranked, first, place = found[int(n)]
                k = np.searchsorted(ranked, ranks[at], side="right") - 1
                sequence[at], offset[at] = first[k] + ranks[at] - ranked[k], place[k]
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)
    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, max_nodes: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = written(select_plain(docs, "doc_id", "text").mapInPandas(_pieces(tokenizer, size), schema), "pack-pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    per_salt = pieces.groupBy("length", "salt").count()
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in per_salt.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most one row per length up to ``size``
        counts[r["length"]] = r["n"]
    full, counts[size] = int(counts[size]), 0
    patterns = plan(counts, size, max_nodes)
    if full:
        patterns.append(((size,), full))
    # at most ``size`` lengths x SALTS rows
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = per_salt.select("length", "salt", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    return ranked.mapInPandas(_place(slots(patterns)), schema + ", sequence_id long, offset long")
