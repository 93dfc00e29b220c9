"""Toxicity scores from confirmed toxic examples and unlabelled text.

Non-negative positive-unlabelled learning: only positives are trusted. With class prior
``pi``, the risk is ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``: the loss of calling
unlabelled text clean, less the share of it that the prior says is toxic, kept from going
negative (when it does, the step goes against it, so the model stops fitting noise).

Training is bounded: at most about ``max_positive`` confirmed toxic texts and
``max_unlabelled`` other texts, chosen by a hash of ``doc_id``, and ``max_words``
features. A feature is a word that occurs, or the start of words (``STEMS`` letters) that
occurs more often than once and once more per ``SPACING`` words. Candidates and their
counts come from Spark aggregates over the sample's whole texts, and the features with the
largest gain of information about the positives are kept. The weights (``max_words`` numbers) go to the
tasks, which score every text of the table. ``pi`` is the share of toxic rows among all
training labels.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are trained on. ``doc_id`` chooses
the sample and the fold; it, ``lang`` and ``source`` are never features.

Defined results: null text counts as empty and scores the bias alone; a null ``doc_id``
is in no fold (``held_out`` false) and is not trained on; labels that are null are no
labels; contradicting labels of one id count as toxic; repeated rows get equal scores;
without any toxic label every score is ``pi`` of an empty model, 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import select_plain, written

FOLDS = 5
STEMS = (4, 5, 6)
SPACING = 200
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(text: str | None) -> set[str]:
    """Words of the text, and starts of words that are frequent in it, marked by ``*``."""
    words = words_of(text)
    least = 1 + len(words) / SPACING
    found = set(words)
    for k in STEMS:
        found.update(f"{w}*" for w, n in Counter(w[:k] for w in words if len(w) >= k).items() if n >= least)
    return found


class Scorer:
    """Sums of weights over the features of a text. Each word's known features are looked up once and cached."""

    def __init__(self, weights: dict[str, float], max_cached: int = 100_000):
        self.weights, self.max_cached, self.cache = weights, max_cached, {}

    def _known(self, word: str) -> tuple[str, ...]:
        if len(self.cache) >= self.max_cached:
            self.cache.clear()
        stems = (f"{word[:k]}*" for k in STEMS if len(word) >= k)
        out = self.cache[word] = tuple(f for f in (word, *stems) if f in self.weights)
        return out

    def __call__(self, text: str | None) -> float:
        words, cache = words_of(text), self.cache
        least = 1 + len(words) / SPACING
        hits: Counter[str] = Counter()
        for w in words:
            known = cache.get(w)
            if known is None:
                known = self._known(w)
            if known:
                hits.update(known)
        return self.weights[""] + sum(sorted(self.weights[f] for f, n in hits.items() if f[-1] != "*" or n >= least))


def _sampled(doc_id: Column, share: float, seed: int) -> Column:
    """True for about ``share`` of ids, by hash."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [sorted(features_of(t)) for t in pdf["text"]]
        yield pd.DataFrame({"positive": pdf["positive"].repeat([len(w) for w in found]).to_numpy(), "word": pd.Series([x for w in found for x in w], dtype=object)})


def _feature_rows(words: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {w: i for i, w in enumerate(words)}
        for pdf in batches:
            yield pd.DataFrame({"positive": pdf["positive"], "features": [sorted(at[w] for w in features_of(t) if w in at) for t in pdf["text"]]})
    return run


def training_sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(positive, text) rows of the sample, and the class prior."""
    lab = select_plain(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = lab.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    n_docs = docs.count()
    prior = (toxic or 0) / n if n else 0.0
    if not toxic or not n_docs:
        return docs.sparkSession.createDataFrame([], "positive boolean, text string"), prior
    rows = select_plain(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # about max_positive ids: small enough to broadcast
    confirmed = lab.where((F.col("toxic") == 1) & _sampled(F.col("doc_id"), max_positive / toxic, 1)).select("doc_id")
    positive = rows.join(F.broadcast(confirmed), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    unlabelled = rows.where(_sampled(F.col("doc_id"), max_unlabelled / n_docs, 2)).select(F.lit(False).alias("positive"), "text")
    return positive.unionByName(unlabelled), prior


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [words_of(t) for t in pdf["text"]]
        triples = [{" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))} for w in found]
        pdf["s0"], pdf["s1"] = ([min(zlib.crc32(f"{k} {x}".encode()) for x in xs) for xs in triples] for k in range(2))
        yield pdf


def distinct_texts(sample: DataFrame) -> DataFrame:
    """Copies of one text, near ones mostly included (equal in one of two min-hashes of their word triples), count once."""
    rows = sample.mapInPandas(_sketches, "positive boolean, text string, s0 long, s1 long")
    for key in ("s0", "s1"):
        one = rows.groupBy("positive", key).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "s0", "s1")).alias("r"))
        rows = one.select("positive", "r.text", "r.s0", "r.s1")
    return rows.select("positive", "text")


def select_words(sample: DataFrame, max_words: int, least: int = 3, least_gain: float = 8.0) -> list[str]:
    """The words whose presence tells most about being a positive (mutual information, ties by word)."""
    sizes = sample.groupBy("positive").count().collect()
    n = {r["positive"]: r["count"] for r in sizes}
    n_pos, n_un = n.get(True, 0), n.get(False, 0)
    if not n_pos or not n_un:
        return []
    counts = sample.mapInPandas(_word_rows, "positive boolean, word string").groupBy("word").agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("u")).where(f"p >= {least}")
    a, b = (F.col("p") + 0.5) / (n_pos + 1), (F.col("u") + 0.5) / (n_un + 1)
    gain = lambda x, y: x * F.log(2 * x / (x + y)) + y * F.log(2 * y / (x + y))
    scored = counts.withColumn("gain", gain(a, b) + gain(1 - a, 1 - b))
    # a word must tell more than chance would among so many candidates
    scored = scored.where(F.col("gain") * 2 * n_pos >= least_gain).where(a > b)
    return [r["word"] for r in scored.orderBy(F.desc("gain"), "word").limit(max_words).collect()]


def train(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 80, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (the last one the bias) by Adam on the non-negative risk with the sigmoid loss.

    That loss is bounded, so positives that look like all other text cost little. It is
    not convex; the start is the log odds of the words.
    """
    rng = np.random.default_rng(seed)
    xp, xu = x[positive], x[~positive]
    a, b = (xp.sum(0) + 0.5) / (len(xp) + 1), (xu.sum(0) + 0.5) / (len(xu) + 1)
    w = np.append(np.log(a * (1 - b) / (b * (1 - a))), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(4, len(xu) // 1024)

    def slope(rows: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean sigmoid loss of calling ``rows`` ``sign``, and its gradient."""
        loss = 1 / (1 + np.exp(np.clip(sign * (rows @ w[:-1] + w[-1]), -30, 30)))
        g = -sign * loss * (1 - loss) / len(rows)
        return float(loss.mean()), np.append(g @ rows, g.sum())

    for _ in range(epochs):
        for bp, bu in zip(np.array_split(rng.permutation(len(xp)), steps), np.array_split(rng.permutation(len(xu)), steps)):
            if not len(bp) or not len(bu):
                continue
            _, up = slope(xp[bp], 1.0)
            loss_n, un = slope(xp[bp], -1.0)
            loss_u, uu = slope(xu[bu], -1.0)
            negative = uu - prior * un
            g = prior * up + negative if loss_u - prior * loss_n >= 0 else -negative
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 12000, max_words: int = 256) -> dict[str, float]:
    """Weights of features; the bias is that of the empty word."""
    sample, prior = training_sample(docs, labels, max_positive, max_unlabelled)
    sample = written(distinct_texts(sample), "toxic-sample")
    words = select_words(sample, max_words)
    if not words:
        return {"": -30.0}
    rows = sample.mapInPandas(_feature_rows(words), "positive boolean, features array<int>").toPandas()  # bounded by the sample's size
    x = np.zeros((len(rows), len(words)), dtype=np.float32)
    for i, f in enumerate(rows["features"]):
        x[i, np.asarray(f, dtype=np.int64)] = 1
    # rows in an order of their own, so that the weights do not depend on that of the partitions
    order = np.lexsort(np.vstack([x.T[:64], rows["positive"].to_numpy()[None]]))
    w = train(x[order], rows["positive"].to_numpy()[order].astype(bool), prior)
    return {"": float(w[-1])} | dict(zip(words, w[:-1].tolist()))


def _score(weights: dict[str, float], name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score_of = Scorer(weights)
        for pdf in batches:
            z = np.array([score_of(t) for t in pdf[name]], dtype=np.float64)
            pdf["score"] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pdf.drop(columns=[name])
    return run


def score(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = select_plain(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text").mapInPandas(
        _score(weights, "text"), "doc_id string, held_out boolean, score double")
    return scored.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(weights: dict[str, float], text_at: int):
    def run(batches):
        import pyarrow as pa

        score_of = Scorer(weights)
        for batch in batches:
            z = [score_of(t.as_py()) for t in batch.column(text_at)]
            yield batch.filter(pa.array([v < 0 for v in z], type=pa.bool_()))
    return run


def without_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    weights = fit(docs, labels, **bounds)
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return inner.mapInArrow(_clean(weights, names.index("text")), inner.schema).toDF(*names)
