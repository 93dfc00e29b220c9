"""The pipeline on given tables: each stage's decisions against brute force over its own input."""

from __future__ import annotations

from test_llm_brute import SF01, a_z, brute_components, check_packing, direct_ids

import corpus_pipeline
from sonotable.llm import decontam
from sonotable.llm.common import documents, written


def test_stages_equal_brute_force(spark):
    docs = documents(spark, SF01)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF01), "test-stage")
        if name != "best-fit packing":
            assert docs.columns == before.columns
        left[name] = ({r.doc_id: r for r in before.collect()}, docs.collect())

    before, after = left["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    gone = before.keys() - {r.doc_id for r in after}
    assert gone and sum(labels.get(i) == 0 for i in gone) == 0  # no document labelled clean goes

    before, after = left["exact dedup"]
    want = {}
    for i in sorted(before):
        want[a_z(before[i].text)] = i
    assert {r.doc_id for r in after} == set(want.values())

    before, after = left["n-gram Jaccard join"]
    components = brute_components([(i, r.text) for i, r in before.items()])
    assert {r.doc_id for r in after} == {i for i, _, c in components if i == c} != before.keys()

    before, after = left["benchmark decontamination"]
    items = [" ".join(decontam.words_of(r.text)) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    leaks = {i for i, r in before.items() if any(t in " ".join(decontam.words_of(r.text)) for t in items)}
    assert leaks and {r.doc_id for r in after} == before.keys() - leaks

    before, after = left["best-fit packing"]
    ids = dict(zip(before, direct_ids([r.text for r in before.values()])))
    assert {r.doc_id for r in after} == before.keys()
    check_packing(after, {i: x + [0] for i, x in ids.items()})


def test_run_gives_the_last_stage_over_the_whole_table(spark):
    from __spark_entry__ import oracle_sql, queries

    rows = queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 50
    assert "pipeline" not in oracle_sql() and {f"op{k}" for k in range(1, 11)} <= {q.split("_")[0] for q in queries()}
