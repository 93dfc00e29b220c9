"""Histogram sharding, Merkle proofs and collocations: brute force, hot groups and edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonotable.llm import collocations, merkle, sharding
from sonotable.llm import quotient_filter as Q
from sonotable.llm.common import written
from sonotable.llm.queries import QUERIES

LONG = "long words, here. " * 30_000
TEXTS = [(1, "a text", "en"), (1, "a text", "en"), (2, None, None), (None, "no id", "fr"), (3, "", "en"), (4, LONG, None), (5, LONG, "en"), (None, None, None),
         (6, "a text", "fr"), (7, "ünï cödé", ""), (-8, "below zero", "en"), (2 ** 62, "far", "en")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("shard", "Slot", "k0", "size", "open", "cell", "_part", "pos", "tree", "digest", "leaf", "rank", "phrase", "word"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


# --- 11 ---------------------------------------------------------------------------------

def expected_shards(rows, n):
    """(doc_id, text) rows with shard, by walking them in key order; rows of one key together."""
    def key(r):
        return int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0
    def size(r):
        return len((r[1] or "").encode()) + 8
    total, before, out = sum(map(size, rows)), 0, []
    order = sorted(rows, key=key)
    at = 0
    while at < len(order):
        same = [r for r in order[at:] if key(r) == key(order[at])]
        out += [(r[0], r[1], n * before // total) for r in same]
        before += sum(map(size, same))
        at += len(same)
    return out


@pytest.mark.parametrize("probes", [2, 64, 1 << 16])
def test_shards_equal_a_walk_in_key_order(spark, probes):
    rng = np.random.default_rng(1)
    rows = [(int(i), "hot text") for i in range(600)] + [(int(i), "w" * int(rng.integers(0, 300)) + str(i)) for i in range(600, 1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24, probes=probes).collect()
    assert sorted((r.doc_id, r.text, r.shard) for r in got) == sorted(expected_shards(rows, 24))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_parts_within_shards_leave_the_result_alone(spark):
    rows = [(i, f"text {i % 700} " * (i % 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, cut = (sorted(map(tuple, sharding.shard(docs, 5, part_bytes=b).collect())) for b in (1 << 30, 2000))
    assert whole == cut and len(whole) == 3000


def test_tolerance_bounds_the_miss(spark):
    rows = [(i, "y" * (i * 37 % 251)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, tolerance=0.05, probes=512).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text) + 8
    share = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(s - share) for s in sizes.values()) <= 0.05 * share + 260


def test_shards_of_odd_rows(odd):
    got = sharding.shard(odd, 4).collect()
    assert sorted(((r.doc_id, r.text, r.shard) for r in got), key=str) == sorted(expected_shards([t[:2] for t in TEXTS], 4), key=str)
    assert "cell" in got[0].asDict() and "Slot" not in got[0].asDict()
    assert sharding.shard(odd.where("false"), 4).collect() == []


def test_written_shards_hold_the_documents(spark, odd, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), 3, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted((t[:2] for t in TEXTS), key=str)


# --- 12 ---------------------------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, more=0):
    out = []
    for c in merkle.COLUMNS:
        v = r[c] + more if c == "n_chars" and r[c] is not None else r[c]
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return _h(*out)


def _fold(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _climb(levels, i, at, siblings):
    for level in levels[:-1]:
        o = i ^ 1
        other = level[o] if o < len(level) else None
        siblings += [other] if other else []
        at = _h(at) if other is None else _h(other, at) if o < i else _h(at, other)
        i >>= 1
    return at


def expected_proofs(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
    trees = {lang: _fold([_leaf(r) for r in groups[lang]]) for lang in langs}
    top = _fold([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            siblings: list[str] = []
            at = _climb(trees[lang], i, _leaf(r, int(hit)), siblings)
            at = _climb(top, k, at, siblings)
            out.append((r["doc_id"], _leaf(r), trees[lang][-1][0], top[-1][0], _h(*siblings), at, at == top[-1][0]))
    return out


def _audit(docs):
    found = merkle.audited(docs)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")), "folded_root", "verified").collect()


def test_proofs_equal_a_plain_tree(spark, odd):
    assert sorted(map(tuple, _audit(odd)), key=str) == sorted(expected_proofs([r.asDict() for r in odd.collect()]), key=str)
    rows = [(i, f"text {i}", "big" if i < 700 else f"l{i % 5}", "s", i) for i in range(800)]  # two segments in one tree, one in others
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, _audit(docs)), key=str)
    assert got == sorted(expected_proofs([r.asDict() for r in docs.collect()]), key=str)
    assert {r[6] for r in got} == {True, False}


def test_many_trees_and_three_segments(spark):
    """70,000 leaves in one tree and 300 trees: every leaf folds to the one root."""
    leaves = spark.range(70_300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 70_000, "big").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("lang"),
                                        F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"))
    way = merkle.proofs(written(leaves.withColumn("claimed", F.col("leaf")), "test-leaves"))
    got = way.select(F.count(F.lit(1)).alias("n"), F.count_if(merkle.folded(F.col("claimed"), F.col("siblings")) == F.col("root")).alias("ok"), F.count_distinct("root").alias("roots"),
                     F.count_distinct("doc_id").alias("ids"), F.max(F.size("siblings")).alias("steps")).first()
    assert tuple(got) == (70_300, 70_300, 1, 70_300, 17 + 9)


def test_proofs_of_one_row_and_of_none(spark, odd):
    one = odd.where("doc_id = 7")
    (r,) = merkle.audited(one).collect()
    assert r.leaf == r.subroot == r.root and r.siblings == []
    assert merkle.audited(odd.where("false")).collect() == []


# --- 13 ---------------------------------------------------------------------------------

@pytest.mark.parametrize("n, id_bits", [(2, 1), (2, 18), (3, 17), (2, 32), (3, 32)])
def test_filters_give_every_gram_back(n, id_bits):
    rng = np.random.default_rng(id_bits)
    ids = [rng.integers(0, min(1 << id_bits, 50) if k else 1 << id_bits, 4000).astype(np.uint64) for k in range(n)]
    ids = [np.r_[x, x[:1000], np.repeat(x[:1], 700)] for x in ids]
    want = Counter(zip(*(x.tolist() for x in ids)))
    f = Q.counted(ids, id_bits)
    halves = [Q.counted([x[a] for x in ids], id_bits) for a in (slice(0, 2000), slice(2000, None))]
    parts = defaultdict(list)
    for h in halves:
        for shard, part in h.slices(7, n, id_bits):
            parts[shard].append(Q.Filter.load(part.dump(n, id_bits), n, id_bits))
    merged = [Q.merged(p) for _, p in sorted(parts.items())]
    for filters in ([f], merged):
        got = Counter()
        for x in filters:
            got.update(dict(zip(zip(*(c.tolist() for c in Q.grams(x, n, id_bits))), x.count.tolist())))
        assert got == want
    assert sum(map(len, merged)) == len(f) == len(want)
    # less than the packed n-gram, a wide counter and a quotient each
    assert len(f.dump(n, id_bits)) < 200 + len(f) * ((n * id_bits + 7) // 8 + 4)


def expected_phrases(rows, min_count, top):
    one, many, total = Counter(), Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                many.update((lang, *words[i:i + n]) for i in range(len(words) - n + 1))
    frequent = {p: a for p, a in many.items() if len(p) > 2 and a >= min_count}
    out = defaultdict(list)
    for p, a in frequent.items():
        lang, words = p[0], p[1:]
        if len(words) == 2 and any(len(q) == 4 and q[0] == lang and words in (q[1:3], q[2:4]) and 100 * b >= 50 * a for q, b in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = many[(lang, *words[:k])], many[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out[lang].append((-s, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def phrases():
    rng = np.random.default_rng(3)
    words = ["New", "York", "new", "york", "city", "éa", "b\x1cc", "of", "the", "x"]
    rows = [(i, "".join(words[w] + " .,;\n\t\x0b   "[s] for w, s in zip(rng.integers(0, 10, 60), rng.choice(10, 60, p=[.02, .02, .02, .02, .02, .1, .02, .26, .26, .26]))),
             (None, "en", "fr", "und")[i % 4 if i % 3 else 1]) for i in range(300)]
    return rows + [(1, "new york city " * 50, "en")] * 2


@pytest.mark.parametrize("options", [{}, {"flush_tokens": 500, "shard_entries": 300}])
def test_collocations_equal_counting_everything(spark, phrases, options):
    docs = spark.createDataFrame(phrases, SCHEMA).repartition(3)
    got = collocations.collocations(docs, min_count=10, top=40, **options)
    assert sorted(map(tuple, got.collect())) == expected_phrases(phrases, 10, 40)


def test_collocations_of_odd_rows(odd):
    got = collocations.collocations(odd)
    assert sorted(map(tuple, got.collect())) == expected_phrases(TEXTS, 10, 2000)
    assert collocations.collocations(odd.where("false")).collect() == []
    assert collocations.collocations(odd.where("text = 'far'")).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 9_999_999_999_991, 9_999_999_999_993, 9_999_999_999_999
    got = spark.range(1).select(collocations.score(F.lit(a), F.lit(left), F.lit(right))).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_new_queries_are_registered():
    assert {"op11_histogram_sharding", "op12_merkle_manifest", "op13_phrase_collocations"} <= set(QUERIES)
