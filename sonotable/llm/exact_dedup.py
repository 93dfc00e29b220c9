"""Exact dedup in two passes around a Bloom filter (DataFrame functions only).

Pass 1 sets, for every row, ``K_BITS`` bits of one 64-bit filter word chosen by the
row's hash, and keeps the bits that two or more rows have set. Pass 2 probes that
filter in a broadcast join: a row with a bit that nobody else set has no equal and goes
straight through; only the other rows are shuffled and grouped by their whole SHA-256.
A false positive of the filter costs the shuffle of one narrow row, never a wrong answer.

The filter has at most ``max_words`` words, so what is broadcast is bounded whatever
the input is: 2**20 words of 8 bytes by default. Beyond some 16 million rows per
``max_words`` of that size it fills up and more rows take the shuffle.

Groups may hold a third of all rows: they are aggregated map-side, and rows meet their
group's figures in a join on (hash, salt), where a group has at most ``SALTS`` salts.

Defined results: null text counts as empty text; rows with a null ``doc_id`` are grouped
like others, and stay only if no row of the group has an id; rows that repeat both text
and ``doc_id`` are all returned, with equal figures. Other columns are passed on by
``without_copies`` and ignored by ``mark_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import ascii_lower, select_plain, written

K_BITS = 3
ROWS_PER_WORD = 4
SALTS = 64


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 (binary) of the lower-cased (A-Z only) text of every row."""
    rows = select_plain(docs, "doc_id", "text")
    return rows.select("doc_id", F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)).alias("sha"))


def _probe(rows: DataFrame, n_words: int) -> DataFrame:
    """Adds the filter word and the bits of a row, from its hash column ``sha``."""
    h = F.xxhash64("sha")
    bits = [F.shiftrightunsigned(h, 46 + 6 * i).bitwiseAND(63).cast("int") for i in range(K_BITS)]
    return rows.withColumn("_word", h.bitwiseAND(n_words - 1)).withColumn("_bits", F.array_distinct(F.array(*bits)))


def repeated_bits(rows: DataFrame, n_words: int) -> DataFrame:
    """Pass 1: the bits of each filter word that at least two rows have set."""
    bits = _probe(rows, n_words).select("_word", F.explode("_bits").alias("_bit"))
    seen = bits.groupBy("_word", "_bit").count().where("count > 1")
    return seen.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_twice"))


def filter_words(n_rows: int, max_words: int) -> int:
    words = 1024
    while words < max_words and words * ROWS_PER_WORD < n_rows:
        words *= 2
    return words


def mark_copies(rows: DataFrame, max_words: int = 1 << 20) -> DataFrame:
    """doc_id, sha, keep_id, group_size, kept for every row of ``rows`` (doc_id, sha).

    ``rows`` is read more than once, so pass a written table.
    """
    n_words = filter_words(rows.count(), max_words)
    twice = F.broadcast(repeated_bits(rows, n_words))
    probed = _probe(rows, n_words).join(twice, "_word", "left")
    mask = F.aggregate("_bits", F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    probed = probed.withColumn("_maybe", F.coalesce(F.col("_twice").bitwiseAND(mask) == mask, F.lit(False)))
    single = probed.where(~F.col("_maybe")).select(
        "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))

    maybe = probed.where("_maybe").select("doc_id", "sha", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_salt"))
    salted = maybe.groupBy("sha", "_salt").agg(F.max("doc_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    whole = salted.groupBy("sha").agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"))
    figures = salted.select("sha", "_salt").join(whole, "sha")
    grouped = maybe.join(figures, ["sha", "_salt"]).select(
        "doc_id", "sha", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return single.unionByName(grouped)


def exact_dedup(docs: DataFrame, max_words: int = 1 << 20) -> DataFrame:
    """One row per document, kept or not: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = mark_copies(written(digests(docs), "exact-digests"), max_words)
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, max_words: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts the largest doc_id, once.

    Rows that the filter calls single are passed on from the scan without a shuffle.
    """
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"_c{names.index(n)}") for n in ("doc_id", "text"))
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))
    keys = written(digests(docs), "exact-digests")
    n_words = filter_words(keys.count(), max_words)
    twice = F.broadcast(written(repeated_bits(keys, n_words), "exact-filter"))
    mask = F.aggregate("_bits", F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    probed = _probe(inner.withColumn("sha", sha), n_words).join(twice, "_word", "left").withColumn(
        "_maybe", F.coalesce(F.col("_twice").bitwiseAND(mask) == mask, F.lit(False)))
    single = probed.where(~F.col("_maybe")).select(*inner.columns)
    maybe_keys = _probe(keys, n_words).join(twice, "_word").where(F.col("_twice").bitwiseAND(mask) == mask)
    stay = maybe_keys.groupBy("sha").agg(F.max("doc_id").alias("_keep"))
    grouped = probed.where("_maybe").withColumn("_id", doc_id).join(
        stay, (F.col("_id").eqNullSafe(F.col("_keep"))) & (probed["sha"] == stay["sha"]), "left_semi")
    grouped = grouped.dropDuplicates(["_id", "sha"]).select(*inner.columns)
    return single.unionByName(grouped).toDF(*names)
