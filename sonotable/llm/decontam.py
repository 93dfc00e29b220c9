"""Benchmark decontamination: every passage of every document queries a BM25 index of test items.

The inverted index holds the test items, cut into parts of at most ``PART_WORDS`` words.
Impacts are BM25 weights divided by the part's score against itself, so a score says how
much of a part a passage covers, and one threshold fits all. Parts are numbered in blocks
of ``BLOCK``; a term has its largest impact in each block beside its postings (block-max).

Passages are ``2 * PART_WORDS`` words long and start every ``PART_WORDS`` words, so each
stretch of ``PART_WORDS`` words lies whole in one. For each passage, block-max WAND finds
*all* parts that reach the threshold: the block maxima of the passage's terms are summed
first, for many passages at once, and blocks that stay below it are skipped; in the others
cursors move from pivot to pivot.

A hit is then verified: of the word 3-grams of the part found, or of the item's question
and also of its answer (its last sentence), a share of ``least_overlap`` must occur in the
passage and its neighbours. So a trimmed or edited item is found, a question without its
answer, and a part of a long item; most of the 3-grams of a part are not met by chance.

No documents are shuffled. The index of one shard of the benchmark goes to the tasks;
shards are cut so that their texts stay below ``max_shard_bytes``, a bound on what is
broadcast, and each shard scans the documents once. Document frequencies are counted over
the whole benchmark before it is cut.

Defined results: null or wordless texts and items match nothing; items that repeat are
each reported; repeated rows get equal results; null ids are kept; other columns are
ignored or passed on; an empty table on either side gives no match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import select_plain

PART_WORDS = 64
BLOCK = 4
AT_ONCE = 512  # passages whose blocks are bounded together
K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!\n])\s*(?=\S)")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts_of(words: list[str]) -> list[list[str]]:
    """Cuts of about equal size, at most ``PART_WORDS`` words each."""
    n = -(-len(words) // PART_WORDS)
    return [words[len(words) * k // n:len(words) * (k + 1) // n] for k in range(n)]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; of a single sentence, the last quarter is the answer."""
    sentences = [s for s in _SENTENCE.split(text) if words_of(s)]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in words_of(s)], words_of(sentences[-1])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def _grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(wanted: list[str], words: list[str]) -> float:
    """Share of the word 3-grams of ``wanted`` (of the whole, if it is shorter) that occur in ``words``; 1 if there are none."""
    grams = _grams(wanted)
    if not grams:
        return 1.0
    n = len(next(iter(grams)))
    return len(grams & {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}) / len(grams)


class Index:
    """Block-max inverted index of item parts."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n_parts: int, mean_length: float):
        self.items, self.of, parts = items, [], []
        for i, (_, text) in enumerate(items):
            for p in parts_of(words_of(text)):
                self.of.append(i)
                parts.append(p)
        self.term: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for p, words in enumerate(parts):
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean_length)
            impact = {w: np.log(1 + (n_parts - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in tf.items()}
            own = sum(sorted(impact.values()))
            for w, x in impact.items():
                if w not in self.term:
                    self.term[w] = len(postings)
                    postings.append([])
                postings[self.term[w]].append((p, x / own))
        self.parts = [[p for p, _ in ps] for ps in postings]
        self.impacts = [[x for _, x in ps] for ps in postings]
        self.list_max = [max(xs) for xs in self.impacts]
        self.n_blocks = -(-len(parts) // BLOCK)
        maxima = [{} for _ in postings]
        for t, ps in enumerate(postings):
            for p, x in ps:
                maxima[t][p // BLOCK] = max(maxima[t].get(p // BLOCK, 0.0), x)
        # term t has blocks[first[t]:first[t + 1]] with these maxima
        self.first = np.concatenate([[0], np.cumsum([len(m) for m in maxima])]).astype(np.int64)
        self.blocks = np.array([k for m in maxima for k in m], dtype=np.int64)
        self.maxima = np.array([x for m in maxima for x in m.values()], dtype=np.float64)
        self.wanted = [question_and_answer(t) for _, t in items]

    def block_bounds(self, passage: np.ndarray, term: np.ndarray, n_passages: int) -> np.ndarray:
        """Sums of block maxima over distinct (passage, term) pairs: one row per passage, one column per block."""
        n = self.first[term + 1] - self.first[term]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(self.first[term], n) + within
        cell = np.repeat(passage, n) * self.n_blocks + self.blocks[at]
        return np.bincount(cell, weights=self.maxima[at], minlength=n_passages * self.n_blocks).reshape(n_passages, self.n_blocks)

    def search(self, terms: list[int], threshold: float, bounds: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all parts whose impacts over ``terms`` (distinct) sum to at least ``threshold``.

        ``bounds`` has the sums of the terms' block maxima.
        """
        low = threshold - 1e-9
        open_blocks = np.flatnonzero(bounds >= low).tolist()
        found = []
        at = dict.fromkeys(terms, 0)
        live = list(terms)
        to = open_blocks[0] * BLOCK if open_blocks else None
        while to is not None:
            # every list moves to the first part that may still be a hit
            for t in live:
                if self.parts[t][at[t]] < to:
                    at[t] = bisect_left(self.parts[t], to, at[t])
            live = [t for t in live if at[t] < len(self.parts[t])]
            live.sort(key=lambda t: self.parts[t][at[t]])
            total, pivot = 0.0, None
            for t in live:
                total += self.list_max[t]
                if total >= low:
                    pivot = self.parts[t][at[t]]
                    break
            if pivot is None:
                break
            k = bisect_left(open_blocks, pivot // BLOCK)
            if k == len(open_blocks):
                break
            if open_blocks[k] != pivot // BLOCK:
                to = open_blocks[k] * BLOCK
                continue
            score = 0.0
            for t in live:
                ps = self.parts[t]
                if ps[at[t]] > pivot:
                    break
                i = bisect_left(ps, pivot, at[t])
                if i < len(ps) and ps[i] == pivot:
                    score += self.impacts[t][i]
            if score >= low:
                found.append((pivot, score))
            to = pivot + 1
        return found

    def matches(self, text: str | None, threshold: float, least_overlap: float) -> dict[int, tuple[float, float, float]]:
        """Verified items: position in ``items`` to (best score, question overlap, answer overlap)."""
        words = words_of(text)
        if not words or not self.term:
            return {}
        get = self.term.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        n_passages = max(1, -(-(len(words) - PART_WORDS) // PART_WORDS))
        out: dict[int, tuple[float, float, float]] = {}
        for p0 in range(0, n_passages, AT_ONCE):
            p1 = min(n_passages, p0 + AT_ONCE)
            own = np.flatnonzero(ids[p0 * PART_WORDS:(p1 + 1) * PART_WORDS] >= 0) + p0 * PART_WORDS
            # a word lies in the passage that starts in its stretch of PART_WORDS words and in the one before
            passage = np.concatenate([own // PART_WORDS, own // PART_WORDS - 1])
            term = np.concatenate([ids[own], ids[own]])
            inside = (passage >= p0) & (passage < p1)
            pairs = np.unique((passage[inside] - p0) * len(self.term) + term[inside])
            passage, term = pairs // len(self.term), pairs % len(self.term)
            bounds = self.block_bounds(passage, term, p1 - p0)
            self._verify(words, p0, passage, term, bounds, threshold, least_overlap, out)
        return out

    def _verify(self, words, p0, passage, term, bounds, threshold, least_overlap, out) -> None:
        for k in np.flatnonzero((bounds >= threshold - 1e-9).any(axis=1)).tolist():
            a, b = (p0 + k) * PART_WORDS, (p0 + k + 2) * PART_WORDS
            terms = term[np.searchsorted(passage, k):np.searchsorted(passage, k + 1)].tolist()
            for part, score in self.search(terms, threshold, bounds[k]):
                i = self.of[part]
                question, answer = self.wanted[i]
                reach = len(question) + len(answer)
                near = words[max(0, a - reach):b + reach]
                q, r = overlap(question, near), overlap(answer, near)
                found = q >= least_overlap and r >= least_overlap
                found = found or overlap(parts_of(question + answer)[part - bisect_left(self.of, i)], near) >= least_overlap
                if found and (i not in out or score > out[i][0]):
                    out[i] = (score, q, r)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = [p for t in pdf["text"] for p in parts_of(words_of(t))]
        yield pd.DataFrame({"words": pd.Series(parts, dtype=object), "n": pd.Series([len(p) for p in parts], dtype="int64")})


def indexes(benchmark: DataFrame, max_shard_bytes: int = 32 << 20) -> list[Index]:
    """One index per shard of the benchmark; a shard's texts take about ``max_shard_bytes`` at most."""
    items = select_plain(benchmark, "item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_shards = -(-total // max_shard_bytes)
    parts = items.mapInPandas(_parts, "words array<string>, n long")
    n_parts, mean = parts.agg(F.count(F.lit(1)), F.avg("n")).first()
    if not n_parts:
        return []
    df = parts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    shard = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)))
    out = []
    for k in range(n_shards):
        own = shard.where(F.col("shard") == k).select("item_id", "text")
        vocabulary = own.mapInPandas(_parts, "words array<string>, n long").select(F.explode("words").alias("word")).distinct()
        out.append(Index([tuple(r) for r in own.orderBy("item_id", "text").collect()],
                         {r["word"]: r["df"] for r in df.join(vocabulary, "word", "left_semi").collect()}, n_parts, mean))
    return out


def _find(index: Index, threshold: float, least_overlap: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc_id, index.items[i][0], *m) for doc_id, text in zip(pdf["doc_id"], pdf["text"])
                    for i, m in sorted(index.matches(text, threshold, least_overlap).items())]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least_overlap: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and test item that it contains."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = select_plain(docs, "doc_id", "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for k, index in enumerate(indexes(benchmark)):
        found = rows.mapInPandas(_find(index, threshold, least_overlap), schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def _clean(index: Index, text_at: int, threshold: float, least_overlap: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([not index.matches(t.as_py(), threshold, least_overlap) for t in batch.column(text_at)], type=pa.bool_()))
    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least_overlap: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no test item."""
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    for index in indexes(benchmark):
        inner = inner.mapInArrow(_clean(index, names.index("text"), threshold, least_overlap), inner.schema)
    return inner.toDF(*names)
