"""Removal of byte strings that occur earlier, from Burrows-Wheeler transforms of candidate contexts.

A string of ``LENGTH`` bytes that occurs twice has the same *anchor* in both places: the
smallest hash among the ``GRAM``-byte grams inside it. That splits one huge suffix array
into small ones, without a miss:

1. Anchors of all texts are dealt to buckets (the packed exchange of ``substring``); an
   anchor hash that occurs once in the corpus rules out every string it is the anchor of.
2. Around each repeated anchor its text gives a context: all strings of ``LENGTH`` bytes
   that it is the anchor of, as one stretch of bytes. Contexts meet by anchor hash. Equal
   contexts count once, all but the first occurrence being repeats as a whole; that
   happens within a task's flush already, so copies and frequent passages stay small.
3. Different contexts of an anchor go into a Burrows-Wheeler transform, ``CHUNK`` bytes of
   contexts at a time. Breadth-first backward extension derives common prefixes by
   increasing value and stops at ``LENGTH`` (``bwt.string_classes``). Of each class of
   equal strings the first occurrence stays and the others are repeats. Bytes are
   compared, so the result holds whatever the hashes do. An anchor whose different contexts
   exceed ``CHUNK`` on their own has its strings compared at each place of the anchor in
   them instead, byte by byte outwards from the anchor: that takes a few integers a context.
4. Replies go back to the flush, then to the document, which drops the covered bytes.

An anchor beside a very frequent passage can have a context of its own in every document
that has the passage. Above ``HOT`` occurrences of an anchor its strings are matched one
by one instead, by a 128-bit fingerprint in a grouped shuffle that combines map-side.

Texts that equal one with a smaller ``doc_id`` are settled before and take no part.
Defined results: null text counts as empty; a null ``doc_id`` takes no part and the text
stays whole; rows with equal id and text are one document; rows with equal ids and
different texts are ordered by a hash of the text; other columns are ignored; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonotable.llm.bwt import string_classes
from sonotable.llm.common import anti_join_small, probed, release, select_plain, text_bytes, written
from sonotable.llm.hashing import MULTIPLIERS, blob, bucket_of, mixed, unblob
from sonotable.llm.substring import per_document, repeated_windows

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1      # grams in a string
CHUNK = 128 << 10             # bytes of contexts in one transform
FLUSH = 8 << 20               # bytes of contexts gathered before a task sends packed rows
BUCKET_BYTES = 16 << 20
CONTEXT_BYTES = 4 << 20       # text whose contexts make a bucket: several times as many bytes as the text
HOT = 200_000                 # documents with an anchor, above which its strings are matched one by one

_BYTE = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BYTES = "doc_id long, version long, n_bytes long, sha binary"
CONTEXTS = ("bucket int, flush binary, docs binary, keys binary, texts binary, sizes binary, shifts binary, owners binary, starts binary, "
            "later_owners binary, later_starts binary, later_counts binary")
REPLIES = "flush binary, docs binary, owners binary, starts binary, counts binary"


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def version(data: bytes) -> int:
    """Tells texts that share an id apart."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of every gram, by doubling: 1, 2, 4, 8, 16 bytes, then 16 + 8."""
    h = _BYTE[np.frombuffer(data, dtype=np.uint8)]
    parts, size = {}, 1
    while size <= GRAM:
        parts[size] = h
        if size * 2 > GRAM:
            break
        h = h[:len(h) - size] + h[size:] * MULTIPLIERS[size]
        size *= 2
    n = len(data) - GRAM + 1
    return mixed(parts[16][:n] + parts[8][16:16 + n] * MULTIPLIERS[40])


def _sliding(a: np.ndarray, span: int, best) -> np.ndarray:
    """``best`` over every window of ``span`` values."""
    size = 1
    while size * 2 <= span:
        a = best(a[:-size], a[size:])
        size *= 2
    rest = span - size
    return best(a[:len(a) - rest], a[rest:]) if rest else a


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, that of the anchor of each string of ``LENGTH`` bytes, and the places of the anchors.

    What is smallest is decided before the last mixing: hashes of anchors would else be
    small, and nearly all of them fall into the first buckets.
    """
    if len(data) < LENGTH:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, np.zeros(0, dtype=np.int64)
    h = gram_hashes(data)
    least = _sliding(h, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, dtype=np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum)
    return mixed(h), mixed(least), np.flatnonzero(most == h)


def anchor_hashes(text: str | None) -> np.ndarray:
    h, _, at = anchors(utf8(text))
    return h[at]


def contexts(data: bytes, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor in ``live``: hash, place, first string start and number of strings that it is the anchor of."""
    h, least, at = anchors(data)
    at = at[np.isin(h[at], live)]
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, none
    starts = at[:, None] - np.arange(SPAN - 1, -1, -1)
    inside = (starts >= 0) & (starts < len(least))
    own = inside & (least[np.clip(starts, 0, len(least) - 1)] == h[at][:, None])
    return h[at], at, starts[np.arange(len(at)), own.argmax(axis=1)], own.sum(axis=1)


# ---- exchange of contexts --------------------------------------------------------------------------

def _byte_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        data = [utf8(t) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "version": [version(d) for d in data], "n_bytes": [len(d) for d in data],
                            "sha": [hashlib.sha256(d).digest() for d in data]})


def _deal_contexts(n_buckets: int):
    def packed(held: dict[tuple[int, int], list]) -> Iterator[pd.DataFrame]:
        """held: (doc_id, version) to its contexts (hash, bytes, shift, start, count), all of one flush."""
        docs = sorted(held)
        first: dict[tuple[int, int, bytes], int] = {}
        rows: list[list[list]] = [[[], [], [], [], [], [], [], []] for _ in range(n_buckets)]
        for owner, doc in enumerate(docs):
            hashes, items = held[doc]
            for b, (key, text, shift, start, count) in zip(bucket_of(hashes, n_buckets).tolist(), items):
                r = rows[b]
                if (key, shift, text) in first:  # an earlier document of this flush, or an earlier place of this one, has it all
                    for column, x in zip(r[5:], (owner, start, count)):
                        column.append(x)
                else:
                    first[(key, shift, text)] = owner
                    for column, x in zip(r[:5], (key, text, shift, owner, start)):
                        column.append(x)
        every = np.array(docs, dtype=np.int64).reshape(-1, 2)
        name = xxhash.xxh3_128_digest(blob(every))
        out = []
        for b, (keys, texts, shifts, owners, starts, later_owners, later_starts, later_counts) in enumerate(rows):
            if keys or later_owners:
                # a row holds its own documents only, so what is sent does not grow with the buckets
                own, local = np.unique(np.array(owners + later_owners, dtype=np.int64), return_inverse=True)
                owners, later_owners = local[:len(owners)], local[len(owners):]
                out.append((b, name, blob(every[own]), blob(np.array(keys, dtype=np.uint64)), b"".join(texts), blob(np.array([len(t) for t in texts], dtype=np.int32)),
                            blob(np.array(shifts, dtype=np.uint8)), *[blob(np.array(x, dtype=np.int32)) for x in (owners, starts, later_owners, later_starts, later_counts)]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXTS.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        size = 0
        for pdf in batches:
            for doc_id, text, live in zip(pdf["doc_id"], pdf["text"], pdf["live"]):
                data = utf8(text)
                doc = (int(doc_id), version(data))
                if doc in held:
                    continue
                hashes, at, starts, counts = contexts(data, unblob(live, np.uint64))
                if len(at):
                    held[doc] = (hashes, [(k, data[s:s + c + LENGTH - 1], a - s, s, c)
                                          for k, a, s, c in zip(hashes.tolist(), at.tolist(), starts.tolist(), counts.tolist())])
                    size += int(counts.sum()) + (LENGTH - 1) * len(at)
                if size >= FLUSH:
                    yield from packed(held)
                    held, size = {}, 0
        if held:
            yield from packed(held)
    return run


def _later_strings(items: list[tuple[bytes, tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(context number, offset) of the strings that occur earlier; items: different contexts and their first (doc_id, version, start)."""
    sizes = np.array([len(t) for t, _ in items], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.frombuffer(b"\0".join(t for t, _ in items) + b"\0", dtype=np.uint8).astype(np.uint16) + 1
    symbols[begin + sizes] = 0
    classes = string_classes(symbols, LENGTH)
    counts = sizes - LENGTH + 1
    item = np.repeat(np.arange(len(items)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    c = classes[begin[item] + offset]
    several = np.bincount(c)[c] > 1
    item, offset, c = item[several], offset[several], c[several]
    place = np.array([p for _, p in items], dtype=np.int64)
    doc_id, ver, start = place[item, 0], place[item, 1], place[item, 2] + offset
    order = np.lexsort((start, ver, doc_id, c))
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = c[order][1:] != c[order][:-1]
    # equal places are one occurrence, met through two rows of one document
    at = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    same = (doc_id[order] == doc_id[at]) & (ver[order] == ver[at]) & (start[order] == start[at])
    later = order[~same]
    return item[later], offset[later]


def _joint(c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each pair (c, x), and which classes have several members; c is less than its length, x less than 2^32."""
    _, of, n = np.unique(c.astype(np.int64) << 32 | x.astype(np.int64), return_inverse=True, return_counts=True)
    return of, n[of] > 1


def _later_runs(items: list[tuple[bytes, int, tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, offset, count) of the strings that occur earlier, for many contexts (text, shift, first place) of one anchor.

    Equal strings have the anchor at the same place ``d``: they share the class of their
    ``d`` bytes before it and that of the bytes from it on. Contexts that are alone in a
    class stay alone when it grows by a byte and drop out.
    """
    n = len(items)
    data = np.frombuffer(b"".join(t for t, _, _ in items), dtype=np.uint8)
    sizes, shift = np.array([len(t) for t, _, _ in items], dtype=np.int64), np.array([s for _, s, _ in items], dtype=np.int64)
    anchor = np.cumsum(sizes) - sizes + shift
    place = np.array([p for _, _, p in items], dtype=np.int64)
    keys = (place[:, 2] + shift, place[:, 1], place[:, 0])
    by_place = np.lexsort(keys)
    rank = np.zeros(n, dtype=np.int64)
    rank[by_place[1:]] = np.cumsum(np.any([k[by_place][1:] != k[by_place][:-1] for k in keys], axis=0))

    at, of = np.arange(n), np.zeros(n, dtype=np.int64)
    right = []  # contexts and their classes, by bytes after the gram
    for m in range(GRAM + SPAN - 1):
        inside = sizes[at] - shift[at] > m
        at, of = at[inside], of[inside]
        of, several = _joint(of, data[anchor[at] + m])
        at, of = at[several], of[several]
        if m >= GRAM - 1:
            right.append((at.astype(np.int32), of.astype(np.int32)))
    later = np.zeros((n, SPAN + 2), dtype=bool)  # column offset + 1
    at, of = np.arange(n), np.zeros(n, dtype=np.int64)
    behind = np.empty(n, dtype=np.int64)
    for d in range(SPAN):
        if d:
            inside = shift[at] >= d
            at, of = at[inside], of[inside]
            of, several = _joint(of, data[anchor[at] - d])
            at, of = at[several], of[several]
        behind[:] = -1
        behind[right[-1 - d][0]] = right[-1 - d][1]
        both = behind[at] >= 0
        member = at[both]
        c, _ = _joint(of[both], behind[member])
        order = np.lexsort((rank[member], c))
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = c[order][1:] != c[order][:-1]
        first = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
        again = member[order[rank[member[order]] != rank[member[first]]]]
        later[again, shift[again] - d + 1] = True
    item, start = np.nonzero(later[:, 1:] & ~later[:, :-1])
    _, end = np.nonzero(later[:, :-1] & ~later[:, 1:])
    return item, start, end - start


def _match_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which strings of the flushes' contexts in this bucket are later than an equal one.

    Contexts stay in the rows' bytes and are met in the order of their anchors, so beside
    arrays of a few integers a context only those of one anchor and of one transform are held.
    """
    rows = list(pdf.itertuples(index=False))
    docs = [np.frombuffer(r.docs, dtype=np.int64).reshape(-1, 2) for r in rows]
    sizes = [np.frombuffer(r.sizes, dtype=np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(n) for n in sizes])
    begin = np.concatenate([np.zeros(0, dtype=np.int64), *[np.cumsum(n, dtype=np.int64) - n for n in sizes]])
    size, key, shift = np.concatenate([np.zeros(0, dtype=np.int32), *sizes]), unblob(pdf["keys"], np.uint64), unblob(pdf["shifts"], np.uint8)
    owner, start = unblob(pdf["owners"], np.int32), unblob(pdf["starts"], np.int32)
    order = np.argsort(key, kind="stable").astype(np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]]).tolist()
    replies = array("i")  # row, owner, start, count
    chunk: list[tuple[bytes, tuple, int, int]] = []
    held = 0

    def settle() -> None:
        item, offset = _later_strings([(t, p) for t, p, _, _ in chunk])
        order = np.lexsort((offset, item))
        item, offset = item[order], offset[order]
        lead = np.ones(len(order) + 1, dtype=bool)
        lead[1:-1] = (item[1:] != item[:-1]) | (offset[1:] != offset[:-1] + 1)
        cuts = np.flatnonzero(lead)
        for i, first, count in zip(*[x.tolist() for x in (item[lead[:-1]], offset[lead[:-1]], np.diff(cuts))]):
            _, place, k, owner = chunk[i]
            replies.extend((k, owner, place[2] + first, count))

    for first, last in zip(cuts, cuts[1:]):
        by_text: dict[tuple[int, bytes], list] = {}
        at = order[first:last]
        for k, at_byte, n, own_shift, o, s in zip(*[x[at].tolist() for x in (row, begin, size, shift, owner, start)]):
            by_text.setdefault((own_shift, rows[k].texts[at_byte:at_byte + n]), []).append(((*docs[k][o].tolist(), s), k, o))
        for (_, text), places in by_text.items():
            places.sort()
            for place, k, o in places:
                if place != places[0][0]:
                    replies.extend((k, o, place[2], len(text) - LENGTH + 1))
        total = sum(len(t) for _, t in by_text)
        if total > CHUNK:
            several = [(text, own_shift, *places[0]) for (own_shift, text), places in by_text.items()]
            for i, offset, count in zip(*[x.tolist() for x in _later_runs([x[:3] for x in several])]):
                _, _, place, k, o = several[i]
                replies.extend((k, o, place[2] + offset, count))
        elif len(by_text) > 1:  # the strings of one context differ in their place around the anchor
            if held + total > CHUNK:
                settle()
                chunk, held = [], 0
            chunk += [(text, *places[0]) for (_, text), places in by_text.items()]
            held += total
    if chunk:
        settle()
    reply = np.frombuffer(replies, dtype=np.int32).reshape(-1, 4)
    within = np.searchsorted(reply[by_row := np.argsort(reply[:, 0], kind="stable"), 0], np.arange(len(rows) + 1))
    out = []
    for k, r in enumerate(rows):
        later = [np.frombuffer(x, dtype=np.int32) for x in (r.later_owners, r.later_starts, r.later_counts)]
        a = np.concatenate([reply[by_row[within[k]:within[k + 1]], 1:], np.stack(later, axis=1)])
        if len(a):
            a = a[np.lexsort(a.T[::-1])]
            out.append((r.flush, r.docs, *[blob(a[:, i]) for i in range(3)]))
    return pd.DataFrame(out, columns=["flush", "docs", "owners", "starts", "counts"])


def _ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    docs, place = np.unique(unblob(pdf["docs"], np.int64).reshape(-1, 2), axis=0, return_inverse=True)
    before = np.concatenate([[0], np.cumsum([len(d) // 16 for d in pdf["docs"]])])
    owner, start, count = (unblob(pdf[c], np.int32) for c in ("owners", "starts", "counts"))
    owner = place.ravel()[owner + np.repeat(before[:-1], [len(o) // 4 for o in pdf["owners"]])]
    order = np.lexsort((start, owner))
    owner, start, count = owner[order], start[order], count[order]
    ids, cuts = np.unique(owner, return_index=True)
    ends = [*cuts[1:], len(owner)]
    return pd.DataFrame({"doc_id": docs[ids, 0], "version": docs[ids, 1], "starts": [blob(start[a:z]) for a, z in zip(cuts, ends)],
                         "counts": [blob(count[a:z]) for a, z in zip(cuts, ends)]})


def _hot_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fingerprint and place of every string whose anchor is hot."""
    for pdf in batches:
        for doc_id, text, hot in zip(pdf["doc_id"], pdf["text"], pdf["hot"]):
            data = utf8(text)
            _, _, starts, counts = contexts(data, unblob(hot, np.uint64))
            places = np.unique(np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts)] or [np.zeros(0, np.int64)])).tolist()
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[p:p + LENGTH]) for p in places), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"f0": prints[:, 0], "f1": prints[:, 1], "doc_id": int(doc_id), "version": version(data), "start": np.array(places, dtype=np.int32)})


def _hot_ranges(texts: DataFrame) -> DataFrame:
    """Strings of hot anchors that occur earlier, in the form of ``_ranges``; a string may occur in any share of the documents."""
    at = texts.where(F.exists("hot", lambda b: F.length(b) > 0)).select("doc_id", "text", "hot").mapInPandas(
        _hot_strings, "f0 long, f1 long, doc_id long, version long, start int").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    place = F.struct("doc_id", "version", "start")
    salted = at.groupBy("f0", "f1", "salt").agg(F.min(place).alias("p"))
    least = salted.select("f0", "f1", "salt").join(salted.groupBy("f0", "f1").agg(F.min("p").alias("least")), ["f0", "f1"])
    later = at.join(least, ["f0", "f1", "salt"]).where(place > F.col("least"))
    return later.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("start")).alias("at")).mapInPandas(
        _as_blobs, "doc_id long, version long, starts binary, counts binary")


def _as_blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "version": pdf["version"], "starts": [blob(np.asarray(a, dtype=np.int32)) for a in pdf["at"]],
                            "counts": [blob(np.ones(len(a), dtype=np.int32)) for a in pdf["at"]]})


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text, ver, starts, counts in zip(pdf["doc_id"], pdf["text"], pdf["version"], pdf["starts"], pdf["counts"]):
            data = utf8(text)
            if version(data) != ver:
                continue
            start, count = unblob(starts, np.int32).astype(np.int64), unblob(counts, np.int32).astype(np.int64)
            edge = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count + LENGTH - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            out.append((doc_id, ver, len(data), int(gone.sum()), spans, hashlib.sha256(kept).digest()))
        yield pd.DataFrame(out, columns=["doc_id", "version", "n_bytes", "n_removed", "n_spans", "sha"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spark = docs.sparkSession
    rows = select_plain(docs, "doc_id", "text")
    n_bytes = text_bytes(rows)
    n_buckets = max(8, -(-n_bytes // BUCKET_BYTES))
    sizes = written(rows.mapInPandas(_byte_rows, BYTES), "suffix-bytes")

    # texts that a smaller doc_id has as well
    salted = sizes.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = salted.groupBy("sha", "salt").agg(F.min("doc_id").alias("m"))
    first = first.select("sha", "salt").join(first.groupBy("sha").agg(F.min("m").alias("least")), "sha")
    copies = salted.join(first, ["sha", "salt"]).where("doc_id > least").select("doc_id", "version").distinct()
    several = sizes.groupBy("doc_id").agg(F.count_distinct("version").alias("n")).where("n > 1").select("doc_id")
    copies = written(copies.join(several, "doc_id", "left_anti"), "suffix-copies")
    single = anti_join_small(rows.where("doc_id is not null"), copies.select("doc_id"), "doc_id")

    repeated = repeated_windows(single, "text", anchor_hashes, n_buckets, "suffix-anchors", self_repeats=True, hot=hot)
    release(spark)
    live = per_document(repeated).select("doc_id", F.concat("later", "first").alias("live"), "hot")
    ids = written(repeated.select("doc_id").distinct(), "suffix-ids")
    texts = probed(single, ids, "doc_id").where("_maybe").drop("_maybe").join(live, "doc_id")
    replies = texts.mapInPandas(_deal_contexts(max(8, -(-n_bytes // CONTEXT_BYTES))), CONTEXTS).groupBy("bucket").applyInPandas(_match_contexts, REPLIES)
    ranges = replies.groupBy("flush").applyInPandas(_ranges, "doc_id long, version long, starts binary, counts binary")
    if not repeated.where(F.length("hot") > 0).isEmpty():
        ranges = ranges.unionByName(_hot_ranges(texts))
    ranges = written(ranges, "suffix-ranges")
    release(spark)

    ranges = ranges.groupBy("doc_id", "version").agg(F.collect_list("starts").alias("starts"), F.collect_list("counts").alias("counts"))
    ranges = written(ranges, "suffix-removed")
    cut = probed(single, ranges.select("doc_id").distinct(), "doc_id").where("_maybe").drop("_maybe").join(ranges, "doc_id")
    stripped = written(cut.mapInPandas(_strip, "doc_id long, version long, n_bytes long, n_removed long, n_spans long, sha binary"), "suffix-stripped")

    zero = F.lit(0).cast("long")
    copied = sizes.join(copies, ["doc_id", "version"], "left_semi").select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    settled = copies.union(ranges.select("doc_id", "version"))
    rest = sizes.join(settled, ["doc_id", "version"], "left_anti").select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"))
    return rest.unionByName(copied).unionByName(stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("sha")).alias("kept_sha256")))
