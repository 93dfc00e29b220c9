"""Byte ranges of foreign JSON arrays: whatever the cut, the elements of one parse; whole files are rejected."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sonotable.sources.interchange import read_annotation_arrays, read_annotations
from sonotable.sources.json_arrays import INSIDE, OUTSIDE, read_json_arrays, summary

ODD = ['a "quoted" \\ back', "br{ack]ets,", "\\", '\\"', "ünï 🙂 漢", "", "line\nbreak", "tab\t", "}{][", "\\\\\\"]


def objects(n, seed=1):
    rng = random.Random(seed)
    return [{"speaker": rng.choice(ODD), "start": k * 1.5, "end": k * 1.5 + 1, "emotion": rng.choice(ODD), "extra": {"deep": [1, {"x": rng.choice(ODD)}, [[]]]}} for k in range(n)]


BAD = {"object": '{"a": 1}', "scalars": "[1, 2]", "open": '[{"a": 1}', "cut": '[{"a": 1}, {"b": ', "behind": '[{"a": 1}] x', "two": '[{"a": 1}][]', "comma": '[{"a": 1},]',
       "spaces": "   ", "text": "hello", "mixed": '[{"a": 1}, "b"]'}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("arrays")
    texts = {"plain": json.dumps(objects(40)), "indented": json.dumps(objects(30, 2), indent=2, ensure_ascii=False), "none": " [ \n ] ", "one": '\n[\n{"speaker":"S"}\n]\n',
             "spaced": "[" + " ,\n\n ".join(map(json.dumps, objects(5, 3))) + "]" + "\n" * 400, **BAD}
    for name, text in texts.items():
        with open(root / f"{name}.json", "wb") as f:
            f.write(text.encode())
    (root / "latin.json").write_bytes('[{"speaker": "é"}]'.encode("latin-1"))
    return root, texts


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_elements_equal_one_parse_whatever_the_ranges(spark, folder, chunk):
    root, texts = folder
    got, rejects = read_json_arrays(spark, str(root), chunk_bytes=chunk)
    by_file = {}
    for r in got.collect():
        by_file.setdefault(os.path.basename(r.path)[:-5], {})[r.idx] = json.loads(r.element)
    want = {name: dict(enumerate(json.loads(t))) for name, t in texts.items() if name not in BAD}
    assert by_file == {name: v for name, v in want.items() if v}
    assert sorted(os.path.basename(r.path)[:-5] for r in rejects.collect()) == sorted([*BAD, "latin"])


def test_a_large_array_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps(objects(4000), indent=1))
    got, rejects = read_json_arrays(spark, str(tmp_path), chunk_bytes=20_000)
    assert rejects.count() == 0
    stats = got.agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("top"), F.count_distinct("idx").alias("ids")).first()
    assert tuple(stats) == (4000, 3999, 4000)
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_an_element_beyond_the_bound_is_a_reject(spark, tmp_path):
    (tmp_path / "huge.json").write_text(json.dumps([{"speaker": "x" * 400_000}]))
    got, rejects = read_json_arrays(spark, str(tmp_path), chunk_bytes=1000, max_element_bytes=100_000)
    assert got.count() == 0 and "more than 100000 bytes" in rejects.first().error


def test_summaries_compose():
    text = json.dumps(objects(6)).encode()
    for cut in range(1, len(text)):
        a, da = summary(text[:cut], OUTSIDE)
        b, db = summary(text[cut:], a)
        assert (b, da + db) == (OUTSIDE, 0)
    assert summary(b'x" [', INSIDE) == (OUTSIDE, 1)


def test_segments_equal_the_reader_of_whole_files(spark, folder):
    root, _ = folder
    got, rejects = read_annotation_arrays(spark, str(root), chunk_bytes=100)
    want, _ = read_annotations(spark, f"{root}/*.json")
    good = want.join(got.select("file_id").distinct(), "file_id", "left_semi")
    assert sorted(map(tuple, got.select(good.columns).collect()), key=str) == sorted(map(tuple, good.collect()), key=str)
    assert rejects.count() == len(BAD) + 1
