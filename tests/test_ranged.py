"""Positions and previous values over range partitions: equal to window functions, whatever one key holds."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sonotable.operators.sequence import ranged, ranged_index, ranged_previous, ranged_ranks

#: A key with two thirds of the rows, small ones, a null one; the order is one value for a third of the rows.
ROWS = [("hot", k % 2, k) for k in range(2000)] + [(f"k{k % 50}", 7, 5000 + k) for k in range(700)] + [(None, k % 3, 9000 + k) for k in range(300)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "file_id string, t int, n long").repartition(5)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_position_equals_row_number(rows, partitions):
    got = ranged_index(rows, "file_id", ["t", "n"], partitions=partitions)
    want = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("file_id").orderBy("t", "n")) - 1).cast("long"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got.select(want.columns)).isEmpty()


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_previous_equals_lag(rows, partitions):
    got = ranged_previous(rows, "file_id", ["t", "n"], ["n", "t"], partitions=partitions)
    w = Window.partitionBy("file_id").orderBy("t", "n")
    want = rows.withColumn("prev_n", F.lag("n").over(w)).withColumn("prev_t", F.lag("t").over(w))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got.select(want.columns)).isEmpty()


def test_one_key_spreads_over_partitions(rows):
    placed = ranged(rows.where("file_id = 'hot'"), "file_id", ["t", "n"], 8)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2000 / 3


def test_ranks_are_dense_and_ascend(rows):
    got = ranged_ranks(ranged(rows, "file_id", ["t", "n"], 9)).collect()
    assert sorted(r["rank"] for r in got) == list(range(len(ROWS)))
    by_rank = [(r.file_id or "", r.t, r.n) for r in sorted(got, key=lambda r: r["rank"])]
    assert by_rank == sorted(by_rank)


def test_no_rows(rows):
    assert ranged_index(rows.where("false"), "file_id", ["t", "n"]).count() == 0
    assert ranged_previous(rows.where("false"), "file_id", ["t"], ["n"]).count() == 0
    assert ranged_ranks(ranged(rows.where("false"), "file_id", ["t"])).count() == 0


def test_runs_of_one_key_over_partitions(spark):
    import random

    from sonotable.operators.sequence import ranged_runs

    rng = random.Random(3)
    rows, at = [], 0
    for i in range(3000):  # a hot key, a null key and small ones
        at += rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 5])
        rows.append((rng.choice(["hot", "hot", "hot", None, f"k{i % 7}"]), at))
    df = spark.createDataFrame(rows, "k string, at long").repartition(7)
    near = F.col("at") - F.col("prev_at") <= 3
    for parts in (1, 8, 40):
        got = ranged_runs(df, "k", ["at"], ["at"], near, partitions=parts).collect()
        assert len(got) == len(rows)
        want, n, last = {}, 0, object()
        for k, a in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
            n += not (last == (k, last[1]) and a - last[1] <= 3) if isinstance(last, tuple) else 1
            want[(k, a)], last = n, (k, a)
        assert {(r.k, r.at): r.run for r in got} == want
