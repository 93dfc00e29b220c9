"""Ids equal a fresh ``Tokenizer`` of the library: all of Unicode, special strings, long runs, the vocabulary."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sonotable.llm import packing, rans, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = ["<|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b ", "<|endoftext|", "|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    code = tokens.coder(PATH)
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    return [t for t, ids in zip(texts, want) if code.encode(t).tolist() != ids]


def test_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        assert same(library, [f"ab{chr(c)}c1{chr(c)} {chr(c)}{chr(c)} 9 " for c in points[at:at + 100_000]]) == []


def test_special_strings_and_mixtures(library):
    rng = random.Random(5)
    bits = list(" \n\t\r  aAbz019'.,-_<|>\u0085 　\x1c") + ["'s", "'ll", " the", "é", "ß", "漢", "🙂", "<|endoftext|>", "\n\n"]
    assert same(library, SPECIAL + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(20_000)]) == []


def test_long_runs_and_the_vocabulary(library):
    assert same(library, ["a" * 300_000, " " * 100_000, "\n" * 100_000 + "x", "^" * 100_000, "é" * 100_000]) == []
    assert same(library, [library.decode([i]) for i in range(library.get_vocab_size())]) == []


def test_another_kind_of_file_goes_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    code = tokens.coder(path)
    assert code.fast is None
    assert code.encode("Some words.").tolist() == Tokenizer.from_file(path).encode("Some words.", add_special_tokens=False).ids


def test_queries_hold_the_ids_of_special_strings(spark, library, tmpdir_new):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(SPECIAL)}
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs).collect()}
    assert packed == {i: (len(ids) + 1, crc([*ids, 0])) for i, ids in want.items()}
    rans.write_tokens(docs, f"{tmpdir_new}/t")
    read = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rans.read_tokens(spark, f"{tmpdir_new}/t").collect()}
    assert read == {i: (len(ids) + 1, crc([*ids, 2])) for i, ids in want.items()}
