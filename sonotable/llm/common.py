"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonotable.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs whose frames are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes the buckets of a job."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def ascii_lower(text):
    """A-Z to a-z and nothing else. ``lower`` does just that on pure ASCII texts, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: Texts that a Python worker is handed at a time; Spark's own default of 10,000 whole texts takes too much memory.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def select_plain(df: DataFrame, *names: str) -> DataFrame:
    """Columns by exact name only; a column whose name differs in case does not make them ambiguous.

    Every operator on texts starts here, so this also bounds the batches that tasks hand to Python.
    """
    bounded_batches(df.sparkSession)
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def _filter_mask(h, bits: int = 3):
    mask = F.lit(0).cast("long")
    for i in range(bits):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 46 + 6 * i).bitwiseAND(63).cast("int")))
    return mask


def probed(rows: DataFrame, keys: DataFrame, key: str, max_words: int = 1 << 20, rows_per_word: int = 8) -> DataFrame:
    """``rows`` with ``_maybe``: false where ``keys`` (a written table) surely lacks the key.

    The Bloom filter that is broadcast has at most ``max_words`` words of 64 bits; the more
    keys beyond that, the more rows are true.
    """
    words, n = 1024, keys.count()
    while words < max_words and words * rows_per_word < n:
        words *= 2
    h = F.xxhash64(key)
    made = keys.select(h.bitwiseAND(words - 1).alias("_word"), _filter_mask(h).alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    out = rows.withColumn("_word", h.bitwiseAND(words - 1)).join(F.broadcast(written(made, "key-filter")), "_word", "left")
    maybe = F.coalesce(F.col("_mask").bitwiseAND(_filter_mask(h)) == _filter_mask(h), F.lit(False))
    return out.withColumn("_maybe", maybe).drop("_word", "_mask")


def semi_join_small(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys`` (a written table); most others are dropped before the shuffle."""
    return probed(rows, keys, key).where("_maybe").drop("_maybe").join(keys, key, "left_semi")


def anti_join_small(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``keys`` (a written table); most of them are not shuffled."""
    both = probed(rows, keys, key)
    return both.where("not _maybe").drop("_maybe").unionByName(both.where("_maybe").drop("_maybe").join(keys, key, "left_anti"))


#: Links that one task of ``connected`` contracts at a time.
LINKS_PER_TASK = 500_000


def _contract(batches):
    """Links of one task as stars: every node points at the smallest that they connect it with."""
    import pandas as pd

    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, dtype="int64")


def connected(edges: DataFrame, name: str, links_per_task: int = LINKS_PER_TASK, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node that links lead to.

    A round first contracts the links of each task to stars, then joins the stars of
    different tasks by a large-star and a small-star step (a group-by and a join over the
    links, whose number never grows). Once all that is left fits one task, its stars are
    the answer. Every round is written to the shared folder.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(max_rounds):
        tasks = -(-edges.count() // links_per_task)
        if tasks <= 1:
            edges = written(edges.coalesce(1).mapInPandas(_contract, "a long, b long"), name)
            # a star: every node points at its root
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        stars = edges.repartition(tasks).mapInPandas(_contract, "a long, b long").distinct()
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        following = written(small, name)
        if following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        edges = following
    raise RuntimeError(f"{name}: no fixed point in {max_rounds} rounds")
