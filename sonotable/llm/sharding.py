"""Shards of near equal bytes by histogram sort (DataFrame functions only on the rows).

Rows are ordered by a key of three integers: 60 bits of the text's MD5, and the two halves
of ``doc_id``, so that equal texts lie together and still can be cut. A shard is a range of
that order; shard ``i`` ends with the row in which the bytes counted so far reach ``i/n`` of
all. The row is found as in histogram sort: in a round, every range that is still open is
cut by evenly spaced probes between its smallest and its largest key, the exact bytes and
rows between neighbouring probes are summed over all partitions, and of each open range
only the cells that a boundary falls into stay open. A boundary is settled when its cell
holds one key, or ends within ``tolerance`` of the wanted bytes. The rows of open cells are
written for the next round, so rounds read less and less. The driver sees at most
``PROBES`` sums a round, whatever the input is.

Then the documents are read again and exchanged once, by the part they fall into. Parts are
shards cut further, at equal bytes and at equal rows, so that no task gets more than
``PART_BYTES`` or a shard's share of the rows (at most ``MAX_PARTS`` cuts of a shard; beyond
that parts grow and sort on disk). The histogram has counted the rows before every part, so
a row's slot is its place in its part plus a constant.

Defined results: a null text has no bytes and is hashed as an empty one; a null ``doc_id``
comes before all others; rows that repeat text and ``doc_id`` have one key and stay in one
shard, numbered in any order; other columns are passed on (one that is itself named
``shard`` or ``slot`` gives way); an empty table gives an empty result. Sizes are positive (UTF-8 bytes plus ``overhead``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonotable.llm.common import written

PROBES = 1 << 16
PART_BYTES = 128 << 20
MAX_PARTS = 400
#: Parts within a shard need not be exact; this share of their size is near enough.
PART_TOLERANCE = Fraction(1, 10)
KEY = ["k0", "k1", "k2"]
TOP = (1 << 63) - 1


def key_columns(doc_id: Column, text: Column) -> list[Column]:
    """The sort key of a document, as three integers whose differences fit 64 bits."""
    digest = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    high = F.coalesce(F.shiftright(doc_id.cast("long"), 32), F.lit(-(1 << 31) - 1).cast("long"))
    return [digest, high, F.coalesce(doc_id.cast("long").bitwiseAND((1 << 32) - 1), F.lit(0).cast("long"))]


@dataclass(frozen=True)
class Target:
    """A boundary to find: ``share`` of all bytes (or rows), met within ``slack`` of them."""

    by: str
    share: Fraction
    slack: Fraction
    shard: bool = False


@dataclass
class Cell:
    """A range of keys: what lies before it and in it, the smallest and largest of each key column, boundaries in it."""

    before: dict[str, int]
    held: dict[str, int]
    low: list[int]
    high: list[int]
    targets: list[Target]

    @property
    def column(self) -> int | None:
        """The first key column that differs within the cell."""
        return next((k for k in range(len(self.low)) if self.low[k] < self.high[k]), None)

    def last_key(self) -> tuple:
        """The largest key that sorts into the cell: everything up to it lies in the cell or before it."""
        k = self.column
        return tuple(self.high) if k is None else (*self.high[:k + 1], *[TOP] * (len(self.high) - k - 1))


@dataclass(frozen=True)
class Boundary:
    """Rows with keys up to ``key`` lie before it: ``rows`` of them, with ``bytes``."""

    key: tuple
    rows: int
    bytes: int
    shard: int


def _sums() -> list[Column]:
    ends = [f(k).alias(f"{n}_{k}") for k in KEY for n, f in (("low", F.min), ("high", F.max))]
    return [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ends]


def _cell(row, before: dict[str, int], targets: list[Target]) -> Cell:
    return Cell(before, {"bytes": int(row["bytes"]), "rows": int(row["rows"])}, [row[f"low_{k}"] for k in KEY], [row[f"high_{k}"] for k in KEY], targets)


def _rows_of(spark, rows: list[dict], schema: str) -> DataFrame:
    """A few rows made by the driver, as a plain projection."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def boundaries(keyed: DataFrame, targets: list[Target], probes: int = PROBES) -> tuple[list[Boundary], int]:
    """The boundaries of ``targets`` over ``keyed`` (k0, k1, k2, size; a written table) in key order, and the rounds taken."""
    spark = keyed.sparkSession
    total = keyed.agg(*_sums()).first()
    if not total["rows"]:
        return [], 0
    whole = {"bytes": int(total["bytes"]), "rows": int(total["rows"])}
    found: list[Boundary] = []

    def settled(cell: Cell) -> list[Target]:
        """Notes the boundaries that the end of ``cell`` is good for; returns the others."""
        rest = []
        for t in cell.targets:
            end = cell.before[t.by] + cell.held[t.by]
            if cell.column is None or end - t.share * whole[t.by] <= t.slack * whole[t.by]:
                found.append(Boundary(cell.last_key(), cell.before["rows"] + cell.held["rows"], cell.before["bytes"] + cell.held["bytes"], int(t.shard)))
            else:
                rest.append(t)
        return rest

    root = _cell(total, {"bytes": 0, "rows": 0}, targets)
    root.targets = settled(root)
    cells = [root] if root.targets else []
    rows = keyed.select(*KEY, "size", F.lit(0).alias("open"))
    rounds = 0
    while cells:
        rounds += 1
        each = max(2, probes // len(cells))
        plan = [{"open": i, "col": c.column, "low": c.low[c.column], "width": -(-(c.high[c.column] - c.low[c.column] + 1) // each)} for i, c in enumerate(cells)]
        if len(plan) == 1:
            dealt = rows.withColumns({k: F.lit(plan[0][k]).cast("long") for k in ("low", "width")}).withColumn("col", F.lit(plan[0]["col"]))
        else:  # at most one row per target
            dealt = rows.join(F.broadcast(_rows_of(spark, plan, "open:int,col:int,low:long,width:long")), "open")
        value = F.get(F.array(*KEY), F.col("col"))
        dealt = dealt.withColumn("cell", F.call_function("div", value - F.col("low"), F.col("width")))
        dealt = dealt.select(*KEY, "size", "open", "cell")
        counted = dealt.groupBy("open", "cell").agg(*_sums()).collect()  # at most PROBES sums
        counted.sort(key=lambda r: (r["open"], r["cell"]))
        follow, kept = [], []
        at, before = -1, {"bytes": 0, "rows": 0}
        for r in counted:
            if r["open"] != at:
                at, before = r["open"], dict(cells[r["open"]].before)
            reach = {n: before[n] + int(r[n]) for n in before}
            here = [t for t in cells[at].targets if before[t.by] < t.share * whole[t.by] <= reach[t.by]]
            if here:
                cell = _cell(r, dict(before), here)
                cell.targets = settled(cell)
                if cell.targets:
                    kept.append({"open": at, "cell": int(r["cell"]), "next": len(follow)})
                    follow.append(cell)
            before = reach
        cells = follow
        if cells:
            still = F.broadcast(_rows_of(spark, kept, "open:int,cell:long,next:int"))  # at most one row per target
            rows = written(dealt.join(still, ["open", "cell"]).select(*KEY, "size", F.col("next").alias("open")), "shard-open")
    return sorted(found, key=lambda b: (b.key, b.shard)), rounds


def _targets(n: int, parts: int, tolerance: float) -> list[Target]:
    slack = Fraction(tolerance) / n
    exact = [Target("bytes", Fraction(i, n), slack, True) for i in range(1, n)]
    fine = PART_TOLERANCE / (n * parts)
    cuts = [Target(by, Fraction(i, n * parts), fine) for by in ("bytes", "rows") for i in range(1, n * parts) if by == "rows" or i % parts]
    return exact + cuts


def _count_below(keys: list[tuple], key: Column) -> Column:
    """How many of the ascending ``keys`` are smaller than ``key``, by bisection of one constant array."""
    fields = ",".join(f"{k}:long" for k in KEY)
    known = F.from_json(F.lit(json.dumps([dict(zip(KEY, k)) for k in keys])), f"array<struct<{fields}>>")
    steps = [1 << i for i in reversed(range(len(keys).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) < key, at + step).otherwise(at))


def shard(docs: DataFrame, n: int, overhead: int = 8, tolerance: float = 0.0, probes: int = PROBES, part_bytes: int = PART_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, with ``shard`` (0 to n - 1) and ``slot`` (from 0, without gaps) first.

    With ``tolerance`` 0 boundaries are exact: a row lies in shard ``floor(n * before / all)``,
    ``before`` being the bytes of smaller keys; else a boundary may miss its place by that
    share of a shard.
    """
    at = [i for i, c in enumerate(docs.columns) if c.lower() not in ("shard", "slot")]
    names = [docs.columns[i] for i in at]
    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]).select(*[F.col(f"_c{i}") for i in at])
    doc_id, text = (F.col(inner.columns[names.index(c)]) for c in ("doc_id", "text"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead
    keyed = inner.withColumns({**dict(zip(KEY, key_columns(doc_id, text))), "size": size})
    narrow = written(keyed.select(*KEY, "size"), "shard-keys")
    held = int(narrow.agg(F.sum("size")).first()[0] or 0)
    parts = min(MAX_PARTS, max(1, -(-held // (n * part_bytes))))
    found, _ = boundaries(narrow, _targets(n, parts, tolerance), probes)

    starts, shards = [0], [0]  # of every part: rows before it, and its shard
    for b in found:
        starts.append(b.rows)
        shards.append(shards[-1] + b.shard)
    first: dict[int, int] = {}
    for s, rows in zip(shards, starts):
        first.setdefault(s, rows)
    lookup = lambda values, kind: F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("_part"))
    placed = keyed.withColumn("_part", _count_below([b.key for b in found], F.struct(*KEY)))
    by_key = Window.partitionBy("_part").orderBy(*KEY)
    out = placed.select(
        lookup(shards, "int").alias("shard"),
        (F.row_number().over(by_key) - 1 + lookup([s - first[k] for s, k in zip(starts, shards)], "long")).cast("long").alias("slot"), *inner.columns)
    return out.toDF("shard", "slot", *names)


def write_shards(docs: DataFrame, n: int, path: str, **options) -> None:
    """``shard`` as files: one folder ``shard=<i>`` each, rows in slot order within a file."""
    rows = shard(docs, n, **options)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
