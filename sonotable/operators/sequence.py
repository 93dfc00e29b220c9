"""Order-dependent operators that stay safe when one key holds a large share of rows.

``row_number()/lag() over (partition by key order by ...)`` sends every row of a key to
one task. Here the caller names a coarse *slice* of the order (a day of a timestamp, a
block of a sequence number, a split of a file): an expression that never decreases along
it. The work per row is a window over (key, slice); what crosses slices is one row per
(key, slice), joined back on both. There is one plan at every size, nothing is sampled
and nothing runs while the query is built.

``df`` is read twice, so pass a table or a cheap plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonotable.storage import written

_SLICE = "_slice"


def _with_slice(df: DataFrame, slice_by: Column | str) -> DataFrame:
    return df.withColumn(_SLICE, F.col(slice_by) if isinstance(slice_by, str) else slice_by)


def _join_per_slice(rows: DataFrame, per_slice: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their (key, slice); null keys meet, too."""
    right = per_slice.withColumnRenamed(key, "_r_key").withColumnRenamed(_SLICE, "_r_slice")
    on = F.col(key).eqNullSafe(F.col("_r_key")) & F.col(_SLICE).eqNullSafe(F.col("_r_slice"))
    return rows.join(right, on, "left").drop("_r_key", "_r_slice")


def positional_index(df: DataFrame, key: str, order: list[str], slice_by: Column | str, name: str = "idx") -> DataFrame:
    """Add ``name`` = 0-based position of each row within its ``key``, by ``order``.

    Equals ``row_number() over (partition by key order by order) - 1``; ``order`` must make
    rows unique within a key so that the result is deterministic.
    """
    sliced = _with_slice(df, slice_by)
    local = sliced.withColumn(name, F.row_number().over(Window.partitionBy(key, _SLICE).orderBy(*order)) - 1)
    counts = sliced.groupBy(key, _SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, _SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = _join_per_slice(local, offsets, key)
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop(_SLICE, "_before")


def previous_values(df: DataFrame, key: str, order: list[str], cols: list[str], slice_by: Column | str, prefix: str = "prev_") -> DataFrame:
    """Add ``prefix+c`` = value of ``c`` on the previous row of the same key (null on the first).

    Equals ``lag(c) over (partition by key order by order)``.
    """
    sliced = _with_slice(df, slice_by)
    w = Window.partitionBy(key, _SLICE).orderBy(*order)
    local = sliced.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        local = local.withColumn(prefix + c, F.lag(c).over(w))
    tails = sliced.groupBy(key, _SLICE).agg(F.max_by(F.struct(*[F.col(c).alias("_t_" + c) for c in cols]), F.struct(*order)).alias("_tail"))
    prev = tails.select(key, _SLICE, F.lag("_tail").over(Window.partitionBy(key).orderBy(_SLICE)).alias("_prev"))
    out = _join_per_slice(local, prev, key)
    for c in cols:
        out = out.withColumn(prefix + c, F.when(F.col("_rn") == 1, F.col("_prev._t_" + c)).otherwise(F.col(prefix + c)))
    return out.drop(_SLICE, "_rn", "_prev")


# --- the same operators, and runs of rows, without a named slice -------------------------
#
# Rows are range-partitioned on (key, order), sorted and written once with their place. The
# partitions are what a slice is above: they hold equal shares of the rows however the
# order is distributed, also if all rows have one key. Windows run within a partition, and
# one carry row per partition says what the partitions before it hold of its first key.

_PART, _AT, _SAME = "_part", "_at", "_same"


def ranged(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in the order of (key, order) as a written table: ``_at`` ascends with it, ``_part`` is the partition.

    Nulls come first. The bounds of the ranges come from Spark's own sampling; all rows
    are in the table.
    """
    by = [F.col(c).asc_nulls_first() for c in [key, *order]]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    placed = dealt.sortWithinPartitions(*by).withColumn(_AT, F.monotonically_increasing_id())
    return written(placed.withColumn(_PART, F.shiftright(F.col(_AT), 33)), "ranged")


def ranged_ranks(placed: DataFrame, name: str = "rank") -> DataFrame:
    """``placed`` with the 0-based position of every row over the whole table."""
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"), F.min(_AT).alias("_head"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select(_PART, "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, _PART).withColumn(name, (F.col(_AT) - F.col("_head") + F.col("_before")).cast("long")).drop("_head", "_before")


def _with_runs(placed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_local`` (position within the key's run in its partition) and ``_first`` (first run of the
    partition); per partition its first and last key and how many rows the last key has there."""
    w = Window.partitionBy(_PART).orderBy(_AT)
    starts = placed.withColumn("_new", F.lag(F.struct(key)).over(w).isNull() | ~F.lag(key).over(w).eqNullSafe(F.col(key)))
    runs = starts.withColumn("_start", F.max(F.when(F.col("_new"), F.col(_AT))).over(w))
    runs = runs.withColumn("_local", F.col(_AT) - F.col("_start")).withColumn("_first", F.col("_start") == F.min(_AT).over(w))
    ends = runs.groupBy(_PART).agg(
        F.max_by(F.struct(F.col(key).alias("k"), (F.col("_local") + 1).alias("n")), _AT).alias("_last"),
        F.min_by(F.struct(F.col(key).alias("k")), _AT).alias("_head"))
    return runs.drop("_new", "_start"), ends


def ranged_index(df: DataFrame, key: str, order: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """``positional_index`` without a slice: equals ``row_number() over (partition by key order by order) - 1``.

    Two exchanges of the rows (by range, then by partition number); a key that holds all
    rows is spread like any other. Rows with equal key and order are numbered in either order.
    """
    runs, ends = _with_runs(ranged(df, key, order, partitions), key)
    held = Window.partitionBy("_last.k").orderBy(_PART)
    tails = ends.withColumn("_upto", F.sum("_last.n").over(held))
    over = Window.orderBy(_PART)  # one row per partition
    carry = tails.select(_PART, F.when(F.lag("_last.k").over(over).eqNullSafe(F.col("_head.k")), F.lag("_upto").over(over)).alias("_carry"))
    out = runs.join(carry, _PART)
    idx = F.col("_local") + F.when(F.col("_first"), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return out.withColumn(name, idx.cast("long")).drop(_PART, _AT, "_local", "_first", "_carry")


def ranged_previous(df: DataFrame, key: str, order: list[str], cols: list[str], prefix: str = "prev_",
                    partitions: int | None = None) -> DataFrame:
    """``previous_values`` without a slice: equals ``lag(c) over (partition by key order by order)``."""
    return _with_previous(ranged(df, key, order, partitions), key, cols, prefix).drop(_PART, _AT, _SAME)


def _with_previous(placed: DataFrame, key: str, cols: list[str], prefix: str) -> DataFrame:
    """``placed`` with the columns of the row before, where that has the same key (``_same``)."""
    w = Window.partitionBy(_PART).orderBy(_AT)
    whole = F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    tails = placed.groupBy(_PART).agg(F.max_by(whole, _AT).alias("_tail"))
    carry = tails.select(_PART, F.lag("_tail").over(Window.orderBy(_PART)).alias("_carry"))  # one row per partition
    out = placed.withColumn("_prev", F.lag(whole).over(w)).join(carry, _PART)
    prev = F.coalesce("_prev", "_carry")
    out = out.withColumn(_SAME, prev.isNotNull() & prev["k"].eqNullSafe(F.col(key)))
    for i, c in enumerate(cols):
        out = out.withColumn(prefix + c, F.when(F.col(_SAME), prev[f"v{i}"]))
    return out.drop("_prev", "_carry")


def ranged_runs(df: DataFrame, key: str, order: list[str], cols: list[str], goes_on: Column, name: str = "run",
                prefix: str = "prev_", partitions: int | None = None) -> DataFrame:
    """Number runs of rows that hang together, without a slice and however long a run or a key is.

    A row belongs to the run of the row before it (of the same key, by ``order``) where
    ``goes_on`` is true; it may use ``prefix + c`` of that row for the columns ``cols``.
    Any other row starts a run. Run numbers ascend with (key, order) over the whole table.
    """
    placed = _with_previous(ranged(df, key, order, partitions), key, cols, prefix)
    starts = placed.withColumn("_new", F.when(F.col(_SAME) & goes_on, 0).otherwise(1))
    totals = starts.groupBy(_PART).agg(F.sum("_new").alias("_n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    out = starts.withColumn(name, F.sum("_new").over(within)).join(offsets, _PART)
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop(_PART, _AT, _SAME, "_new", "_before", *[prefix + c for c in cols])
