"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonotable.llm import decontam, exact_dedup, ngram_join, packing, pii, rans, secrets, substring, suffix_dedup, toxicity

LONG = "long words here " * 40_000  # 640,000 characters
TEXTS = [(1, "plain text of a document with some words in it that is long enough to make shingles"), (1, "plain text of a document with some words in it that is long enough to make shingles"),
         (2, "Plain text of a document with some words in it that is long enough to make shingles"), (3, None), (None, "text without an id"), (4, ""), (5, LONG), (6, LONG), (None, None)]
#: Names that operators use inside or return, and some that differ in case only from none of them.
CLASHING = ["kept", "sha", "keep_id", "score", "component_id", "spans", "bucket", "_word", "_maybe", "longest", "length", "salt", "item_id", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(None).cast("string") if k % 2 else F.lit("x"))
    return docs


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "plain text of a document with some words in it"), (2, None), (None, "nothing like it anywhere at all"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, 0, int(k in (1, 2))) for k in range(1, 7)] + [(1, 1, 0), (None, 0, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda d, b, lab: secrets.scan_secrets(d),
    "substring": lambda d, b, lab: substring.remove_repeats(d),
    "suffix": lambda d, b, lab: suffix_dedup.remove_repeats(d),
    "ngram": lambda d, b, lab: ngram_join.jaccard_components(d),
    "pii": lambda d, b, lab: pii.pseudonymise(d, "k"),
    "toxicity": lambda d, b, lab: toxicity.score(d, toxicity.fit(d, lab)),
    "exact": lambda d, b, lab: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_row_operators_return_a_row_per_row(odd, nothing, benchmark, labels, name):
    got = OPERATORS[name](odd, benchmark, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    assert OPERATORS[name](nothing, benchmark, labels).collect() == []


def test_defined_results(odd, benchmark, labels):
    words = {str(r.doc_id): r for r in substring.remove_repeats(odd).collect()}
    assert words["6"].n_removed == words["6"].n_words == 120_000 and words["6"].longest == 120_000
    assert words["None"].n_removed == 0 and words["4"].n_words == 0
    data = {str(r.doc_id): r for r in suffix_dedup.remove_repeats(odd).collect()}
    # "long words here " repeats itself: all but the first 16 bytes of the text is a repeat
    assert data["5"].n_bytes == len(LONG) and data["5"].n_removed == len(LONG) - 16 and data["5"].n_spans == 1
    assert data["6"].n_removed == len(LONG) and data["6"].kept_sha256 == hashlib.sha256(b"").hexdigest()
    comp = {str(r.doc_id): r for r in ngram_join.jaccard_components(odd).collect()}
    assert comp["2"].component_id == 1 and comp["6"].component_id == 5 and comp["3"].component_id == 3
    assert comp["None"].component_id is None and comp["3"].n_shingles == 0 and comp["5"].n_shingles == 3
    found = decontam.contaminated(odd, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 1), (2, 1)]
    assert {str(r.doc_id): r.held_out for r in toxicity.score(odd, {"": -1.0}).collect()}["None"] is False


def test_decontamination_without_rows(odd, nothing, benchmark):
    assert decontam.contaminated(nothing, benchmark).collect() == [] and decontam.contaminated(odd, benchmark.where("false")).collect() == []


def test_packing_odd_rows(odd, nothing):
    rows = packing.pack(odd).collect()
    assert {str(r.doc_id) for r in rows} == {str(i) for i, _ in TEXTS} and packing.pack(nothing).collect() == []
    long = sorted(r for r in rows if r.doc_id == 5)
    assert all(r.length == packing.SIZE for r in rows if r.doc_id == 5 and r.piece > 0) and len(long) > 50
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.SIZE


def test_token_files_odd_rows(spark, odd, nothing, tmpdir_new):
    rans.write_tokens(odd, f"{tmpdir_new}/odd")
    rows = sorted(rans.read_tokens(spark, f"{tmpdir_new}/odd").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6]  # a null id sorts first
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    rans.write_tokens(nothing, f"{tmpdir_new}/none")
    assert rans.read_tokens(spark, f"{tmpdir_new}/none").collect() == []


def test_toxicity_without_toxic_labels(odd, labels):
    rows = toxicity.score(odd, toxicity.fit(odd, labels.where("false"))).collect()
    assert len(rows) == len(TEXTS) and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in rows)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, nothing, benchmark, labels, tmpdir_new, stage):
    benchmark.write.parquet(f"{tmpdir_new}/benchmark.parquet")
    labels.write.parquet(f"{tmpdir_new}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, odd, tmpdir_new)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
    ids = sorted(str(r.doc_id) for r in out.collect())
    if stage == "exact dedup":  # the largest id of equal texts; a repeated row once
        assert ids == sorted(["2", "4", "6", "None"])
    if stage == "n-gram Jaccard join":  # the smallest id of a component, rows without id as they are
        assert ids == sorted(["1", "1", "3", "4", "5", "None", "None"])
    if stage == "benchmark decontamination":
        assert ids == sorted(["3", "4", "5", "6", "None", "None"])
    assert run(spark, nothing, tmpdir_new).collect() == []
