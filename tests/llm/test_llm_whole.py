"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from sonotable.llm import decontam, hashing, ngram_join, packing, substring, suffix_dedup


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- packing ----------------------------------------------------------------------------------------

def used_up(patterns, counts, size):
    used = np.zeros(len(counts), dtype=int)
    for pattern, times in patterns:
        assert sum(pattern) <= size
        for n in pattern:
            used[n] += times
    return (used == counts).all()


def test_thousands_of_pieces_of_the_least_lengths():
    for small in ({1: 5000}, {1: 700, 2: 700}, {1: 3000, 2: 3000, 3: 3000}):
        counts = np.zeros(packing.SIZE + 1, dtype=int)
        counts[[1500, 900]] = 1
        for n, c in small.items():
            counts[n] = c
        patterns = packing.plan(counts, packing.SIZE)
        assert used_up(patterns, counts, packing.SIZE)
        assert sum(t for _, t in patterns) == packing.lower_bound(counts, packing.SIZE)


def test_packing_of_thousands_of_empty_texts(spark):
    rows = packing.pack(docs_of(spark, [(k, "" if k % 2 else None) for k in range(5000)] + [(9000, "some words " * 300)])).collect()
    assert len({r.doc_id for r in rows}) == 5001 and sum(r.length for r in rows if r.doc_id < 9000) == 5000
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    assert len(places) == -(-sum(r.length for r in rows) // packing.SIZE)


# ---- n-gram join ------------------------------------------------------------------------------------

@pytest.mark.parametrize("others", [[], [(4, "x0 x1 x2 x3 x4 x5"), (3, "X0 x1 x2 x3 x4 x5"), (8, "alone " * 9)]])
def test_tasks_that_read_the_same_rows(spark, others):
    words = [f"w{k}" for k in range(60)]
    rows, part = [(5, " ".join(words)), *others], spark.sparkContext.parallelize
    # twice the same partition, and a near copy of a repeated row in one of its own
    tasks = part(rows, 1).union(part(rows, 1)).union(part([(7, " ".join([*words[:-1], "end"]))], 1))
    got = ngram_join.jaccard_components(spark.createDataFrame(tasks, "doc_id long, text string")).collect()
    want = [(5, 5), (5, 5), (7, 5)] + [(i, 3 if i < 5 else i) for i, _ in others] * 2
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(want)


# ---- suffix dedup -----------------------------------------------------------------------------------

def later_strings(texts, length=suffix_dedup.LENGTH):
    """(document, start) of the strings that an earlier document or place has."""
    seen, out = set(), set()
    for i, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                out.add((i, p))
            seen.add(b[p:p + length])
    return out


def matched(texts):
    live = suffix_dedup.blob(np.unique(np.concatenate([suffix_dedup.anchors(t)[0][suffix_dedup.anchors(t)[2]] for t in texts])))
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": [t.decode("latin-1") for t in texts], "live": [[live]] * len(texts)})
    dealt = pd.concat(list(suffix_dedup._deal_contexts(1)(iter([docs]))))
    tracemalloc.start()
    replies = suffix_dedup._match_contexts(dealt)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = set()
    for r in replies.itertuples(index=False):
        ids = np.frombuffer(r.docs, dtype=np.int64).reshape(-1, 2)[:, 0]
        for owner, start, count in zip(*[np.frombuffer(x, dtype=np.int32).tolist() for x in (r.owners, r.starts, r.counts)]):
            found |= {(int(ids[owner]), p) for p in range(start, start + count)}
    return found, peak


def test_many_different_contexts_of_one_anchor_take_bounded_memory():
    rng = random.Random(7)
    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,"
    passage = bytes(rng.choices(letters, k=130))
    own = lambda n: bytes(rng.choices(letters, k=n))
    texts = [own(90) + passage + own(90) for _ in range(6000)]
    found, peak = matched(texts)
    assert found == later_strings(texts)
    assert peak < 150 << 20  # with 66 letters, 4 bytes a letter and byte of the contexts would be over 270 MB


def test_strings_around_one_anchor_equal_brute_force(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 0)  # every anchor by its places
    rng = random.Random(8)
    for _ in range(40):
        base = bytes(rng.choices(b"ab", k=rng.choice([1, 3, 400])))
        base = (base * 400)[:rng.randrange(150, 400)]
        texts = []
        for _ in range(rng.randrange(2, 8)):
            t = bytearray(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(b"abc")
            texts.append(bytes(t[rng.randrange(40):]))
        assert matched(texts)[0] == later_strings(texts)


# ---- decontamination --------------------------------------------------------------------------------

def test_trimmed_and_edited_items_are_found(spark):
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    question, long = words("q", 40), words("long", 192)
    items = [(1, " ".join(question) + ". Er."), (2, " ".join(words("p", 30)) + ". " + " ".join(words("r", 12)) + "."), (3, " ".join(long) + ". Yes it is.")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    fill = words("fill", 200)
    texts = {
        1: (question, {1}),                                    # without the answer of one word
        2: ([*question, "Other"], {1}),                        # with another one
        3: ([*question[:20], "edit", *question[21:], "Er"], {1}),
        4: (words("p", 30), {2}),                              # the question without a long answer
        5: (decontam.parts_of(decontam.words_of(items[2][1]))[1], {3}),  # one part of a long item
        6: (question[:12], set()), 7: (words("p", 8) + words("r", 3), set()), 8: (["er"], set()), 9: (long[:20], set()),
        10: (question[::-1], set()),                           # all words, no 3-gram
        11: ([*question, "er"], {1}),
    }
    docs = docs_of(spark, [(k, " ".join(fill[:90] + t + fill[90:])) for k, (t, _) in texts.items()])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()}
    assert got == {(k, i) for k, (_, want) in texts.items() for i in want}
    assert sorted(r.doc_id for r in decontam.without_contaminated(docs, benchmark).collect()) == [k for k, (_, want) in texts.items() if not want]


# ---- packed exchange --------------------------------------------------------------------------------

def sent(deal, rows, buckets):
    """Bytes of all packed rows, each blob lz4 as in a shuffle, and how many rows."""
    import pyarrow as pa

    size, count = 0, 0
    for pdf in deal(buckets)(iter([rows])):
        for r in pdf.itertuples(index=False):
            size += sum(len(pa.compress(x, codec="lz4", asbytes=True)) if isinstance(x, bytes) and x else 8 for x in r)
            count += 1
    return size, count


def test_packed_rows_follow_the_text_and_not_the_buckets():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = pd.DataFrame({"doc_id": rng.sample(range(200_000), 4500), "text": [" ".join(rng.choices(words, k=240)) for _ in range(4500)]})
    deals = {"windows": lambda b: substring._deal(b, "text", substring._of_text), "shingles": lambda b: ngram_join._deal(b, True), "tokens": lambda b: ngram_join._deal(b, False)}
    figures = {}
    for name, deal in deals.items():
        figures[name] = sent(deal, rows, 31), sent(deal, rows, 1789)
    # which set has a 32-bit token costs about a byte where buckets hold few tokens of a set, a few bits where they hold many
    bound = {"windows": 1.2, "shingles": 1.3, "tokens": 1.2}
    assert all(many[0] < bound[name] * few[0] for name, (few, many) in figures.items()), figures


def test_planes_give_back_any_integers():
    for values in ([], [0], [255, 256], [0, 65535, 1], [2**40, 3, 0], [2**64 - 1, 0]):
        a = np.array(values, dtype=np.uint64)
        assert hashing.unplanes(hashing.planes(a), len(a)).tolist() == values


def test_windows_of_any_ids_keep_their_documents():
    text = " ".join(f"x{i}" for i in range(20))
    rows = pd.DataFrame({"doc_id": [-2**63, 2**63 - 1, -5, 7], "text": [text, text + " a", "b " + text, "none"]})
    dealt = pd.concat(list(substring._deal(3, "text", substring._of_text)(iter([rows]))))
    found = pd.concat([substring._match(g) for _, g in dealt.groupby("bucket")])
    by = substring._by_document(found).set_index("doc_id")
    assert sorted(by.index) == [-2**63, -5, 2**63 - 1]
    assert len(by["first"][-2**63]) == 8 * 8 and not by["later"][-2**63]
    assert len(by["later"][-5]) == len(by["later"][2**63 - 1]) == 8 * 8
