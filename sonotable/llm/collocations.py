"""Phrases of two and three words that belong together, per language.

Texts become word numbers once: a task collects the texts of ``FLUSH_TOKENS`` words, numbers
its own words in order of appearance, and writes one row per language with the number
sequence (a mark between pieces), its words and their counts. Words counted over all rows
that occur ``min_count`` times get dense global ids; no phrase can hold another word. Each
task's row gets the ids of its own words back by a join on the row's number, so no
dictionary is broadcast. The row's bigrams and trigrams of such words are packed and counted
in counting quotient filters (``quotient_filter.py``), whose quotient ranges are exchanged
and merged, shard by shard. Sharding follows a permutation of the n-gram, so neither a
frequent word nor a frequent phrase loads one shard; a language's sequences are spread over
rows, its n-grams over shards.

What comes out is exact. Scores are decimals of 38 digits: counts below 10^13 are safe.

Defined results: null texts are empty, a null ``lang`` is ``und``; documents of one id are
separate texts; languages without a phrase have no row; an empty table gives no rows. Of
other columns nothing is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonotable.llm import quotient_filter as Q
from sonotable.llm.common import release, select_plain, written
from sonotable.operators.sequence import ranged_ranks

MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS, b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * len(MARKS))  # 0xFF is in no UTF-8 text
FLUSH_TOKENS = 6_000_000
#: Entries of filters that one merging task gets, about.
SHARD_ENTRIES = 4_000_000
ID_BITS = 32  # at most
ROWS_T = "row string, lang string, numbers binary, words array<string>, counts array<long>"
SLICE_T = "lang string, n int, shard int, filter binary"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words in order; 0xFF ends a piece."""
    return ((text or "").encode("utf-8", "surrogatepass").translate(_TABLE) + b"\xff").replace(b"\xff", b" \xff ").split()


def _numbered(flush_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        n = 0

        def flush() -> Iterator[pd.DataFrame]:
            for lang, (known, parts) in held.items():
                numbers = np.concatenate(parts)
                counts = np.bincount(numbers, minlength=len(known))[1:]
                if len(counts):
                    yield pd.DataFrame({"row": [uuid.uuid4().hex], "lang": [lang], "numbers": [pack.compress(numbers.astype("<u4").tobytes())],
                                        "words": [[w.decode("utf-8", "surrogatepass") for w in list(known)[1:]]], "counts": [counts]})

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if lang not in held:
                    held[lang] = (_Numbers({b"\xff": 0}), [])
                known, parts = held[lang]
                words = tokens(text)
                parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)))
                n += len(words)
                if n >= flush_tokens:
                    yield from flush()
                    held, n = {}, 0
        yield from flush()
    return run


def _counted(shards: int, id_bits: int):
    def run(keys, rows: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(ids):
            r = rows.iloc[0]
            numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["numbers"]), dtype="<u4")
            known = np.zeros(int(numbers.max()) + 1, dtype=np.uint32)  # 0: a mark, or a word too rare
            known[ids["at"].to_numpy() + 1] = ids["id"].to_numpy() + 1
            g = known[numbers]
            for n in (2, 3):
                columns = [g[k:len(g) - n + 1 + k] for k in range(n)]
                whole = np.logical_and.reduce([c > 0 for c in columns])
                if whole.any():
                    f = Q.counted([c[whole] - 1 for c in columns], id_bits)
                    out += [(r["lang"], n, s, part.dump(n, id_bits)) for s, part in f.slices(shards, n, id_bits)]
        return pd.DataFrame(out, columns=["lang", "n", "shard", "filter"])
    return run


def _merged(min_count: int, id_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        f = Q.merged([Q.Filter.load(x, n, id_bits) for x in pdf["filter"]]).at_least(min_count)
        ids = Q.grams(f, n, id_bits)
        third = ids[2].astype(np.int64) if n == 3 else np.full(len(f), -1, dtype=np.int64)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "n": n, "w1": ids[0].astype(np.int64), "w2": ids[1].astype(np.int64), "w3": third, "a": f.count})
    return run


def count_phrases(docs: DataFrame, min_count: int, flush_tokens: int = FLUSH_TOKENS, shard_entries: int = SHARD_ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, id, word, f), frequent n-grams (lang, n, w1, w2, w3, a; w3 is -1 for two words) and sizes (lang, n)."""
    spark = docs.sparkSession
    texts = select_plain(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = written(texts.mapInPandas(_numbered(flush_tokens), ROWS_T), "phrase-rows")

    # words occur once per row; one exchange serves the counts and the way back
    words = rows.select("row", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("row", "lang", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    sizes = written(rows.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("c")).groupBy("lang").agg(F.sum("c").alias("n")), "phrase-sizes")
    frequent = words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count)
    at = written(frequent.withColumn("_at", F.monotonically_increasing_id()), "phrase-words").withColumn("_part", F.shiftright("_at", 33))
    known = written(ranged_ranks(at, "id").select("lang", "word", "f", "id"), "phrase-dictionary")
    n_words = known.count()
    id_bits = max(1, (n_words - 1).bit_length()) if n_words else 1
    if id_bits > ID_BITS:
        raise ValueError(f"{n_words} frequent words do not fit ids of {ID_BITS} bits")
    back = written(words.select("row", "lang", "at", "word").join(known.select("lang", "word", "id"), ["lang", "word"]).select("row", "at", "id"), "phrase-ids")
    release(spark)

    entries = int(sizes.agg(F.sum("n")).first()[0] or 0)
    shards = max(1, -(-entries // shard_entries))
    slices = rows.select("row", "lang", "numbers").groupBy("row").cogroup(back.groupBy("row")).applyInPandas(_counted(shards, id_bits), SLICE_T)
    merged = slices.groupBy("lang", "n", "shard").applyInPandas(_merged(min_count, id_bits), "lang string, n int, w1 long, w2 long, w3 long, a long")
    return known, written(merged, "phrase-counts"), sizes


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact for counts below 10^13."""
    a, left, right = (c.cast("decimal(13,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right).cast("long")


def collocations(docs: DataFrame, min_count: int = 10, top: int = 2000, inside_percent: int = 50, **options) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if ``inside_percent`` of its occurrences are in one longer frequent phrase.
    """
    known, found, sizes = count_phrases(docs, min_count, **options)
    two, three = found.where("n = 2").drop("n", "w3"), found.where("n = 3").drop("n")

    parts = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = parts.groupBy("lang", "w1", "w2").agg(F.max("a").alias("_in"))
    two_kept = two.join(longer, ["lang", "w1", "w2"], "left").where(F.col("_in").isNull() | (100 * F.col("_in") < inside_percent * F.col("a"))).drop("_in")

    def word(name: str) -> DataFrame:
        return known.select("lang", F.col("id").alias(name), F.col("word").alias(f"{name}_text"), F.col("f").alias(f"{name}_f"))

    def pair(first: str, second: str, name: str) -> DataFrame:
        return two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(name))

    pairs = two_kept.join(word("w1"), ["lang", "w1"]).join(word("w2"), ["lang", "w2"]).select(
        "lang", F.concat_ws(" ", "w1_text", "w2_text").alias("phrase"), "a", F.col("w1_f").alias("l"), F.col("w2_f").alias("r"))
    triples = three.join(pair("w1", "w2", "f12"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "f23"), ["lang", "w2", "w3"])
    triples = triples.join(word("w1"), ["lang", "w1"]).join(word("w2"), ["lang", "w2"]).join(word("w3"), ["lang", "w3"])
    early = score(F.col("a"), F.col("w1_f"), F.col("f23")) <= score(F.col("a"), F.col("f12"), F.col("w3_f"))
    triples = triples.select("lang", F.concat_ws(" ", "w1_text", "w2_text", "w3_text").alias("phrase"), "a",
                             F.when(early, F.col("w1_f")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("w3_f")).alias("r"))
    scored = pairs.unionByName(triples).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for salts in (64, 4):  # the first `top` of shares first, so that no task ever gets more than 64 times `top`
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        scored = scored.withColumn("_place", F.row_number().over(share)).where(F.col("_place") <= top).drop("_place")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
