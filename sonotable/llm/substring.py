"""Removal of repeated word passages by level-wise doubling of repeated windows.

Level 0 has every window of ``LENGTH`` words of every document. A window that occurs in
two or more documents survives; two survivors that follow each other in a document make
a window of twice the length on the next level, and so on until no candidates are left.
A window is *later* in a document if it also starts in one with a smaller ``doc_id``;
words covered by later windows are removed. A window of a higher level is made of two of
the level below, so level 0 decides what is removed, and the higher levels tell how long
the repeated passages are (``longest``: words of the longest doubled window that is later).

Documents whose word sequences are equal are settled before: all but the smallest
``doc_id`` are later as a whole, so they take no part.

One level is a packed exchange. Tasks gather ``FLUSH`` windows, settle repeats among them
(only the smallest document of a window is sent on, so a passage of a third of all
documents costs a row per flush), and deal the windows to buckets by hash. A bucket
sorts its hashes; replies go back to the flush, then to the document. A row to a bucket
holds its own windows and their documents, as offsets from the flush's smallest id, and
nothing that other rows of the flush hold too: what is sent follows the windows, however
many buckets there are. Documents with no repeated window never shuffle their text.

Windows are compared by 64-bit hashes: over n different windows, a chance of about
n**2 / 2**65 that any two are taken for equal.

Defined results: null or short texts have nothing removed; rows with a null ``doc_id``
have no order, take no part and stay whole; rows that share a ``doc_id`` are one document
in all comparisons; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import anti_join_small, probed, release, select_plain, text_bytes, written
from sonotable.llm.hashing import MULTIPLIERS, blob, bucket_of, mixed, planes, run_hashes, unblob, unplanes, word_hashes, word_list

LENGTH = 13
FLUSH = 1 << 20          # windows gathered before a task sends packed rows
BUCKET_BYTES = 16 << 20  # text per bucket

WORDS = "doc_id long, n_words long, sha binary"
DEALT = "bucket int, flush binary, least long, hashes binary, owners binary, many binary, later_hashes binary, later_owners binary"
FOUND = "flush binary, least long, hashes binary, owners binary, later binary"
REPEATED = "doc_id long, later binary, first binary, hot binary"


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [word_list(t, lower=False) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": [len(w) for w in words],
                            "sha": [hashlib.sha256(b" ".join(w)).digest() for w in words]})


def window_hashes(text: str | None, length: int = LENGTH) -> np.ndarray:
    return run_hashes(word_hashes(word_list(text, lower=False)), length)


def _of_text(value) -> np.ndarray:
    return window_hashes(value)


def _of_blob(value) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint64)


def _deal(n_buckets: int, column: str, hashes_of, self_repeats: bool = False):
    """Packed windows by bucket: of each flush, the smallest document of each hash, and the later ones apart.

    With ``self_repeats``, a hash that a document has twice counts as repeated.
    """
    def packed(docs: list[int], found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        ids = np.array(docs, dtype=np.int64)
        least = ids.min()
        owner = np.repeat(ids.view(np.uint64) - least.view(np.uint64), [len(h) for h in found])  # offsets, in the order of the ids
        h = np.concatenate(found)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        twice = np.zeros(len(h), dtype=bool)
        twice[:-1] = ~new[1:]
        h, owner, twice = h[new], owner[new], twice[new]
        first = np.ones(len(h), dtype=bool)
        first[1:] = h[1:] != h[:-1]
        many = np.zeros(len(h), dtype=bool)
        many[:-1] = ~first[1:]
        if self_repeats:
            many |= twice
        bucket = bucket_of(h, n_buckets)  # ascending, as h is
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
        name = xxhash.xxh3_128_digest(ids.tobytes() + h.tobytes())
        rows = []
        for b in range(n_buckets):
            at = slice(cuts[b], cuts[b + 1])
            f = first[at]
            if len(f):
                rows.append((b, name, int(least), blob(h[at][f]), planes(owner[at][f]), blob(np.packbits(many[at][f])), blob(h[at][~f]), planes(owner[at][~f])))
        yield pd.DataFrame(rows, columns=["bucket", "flush", "least", "hashes", "owners", "many", "later_hashes", "later_owners"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[int] = []
        found: list[np.ndarray] = []
        held = 0
        for pdf in batches:
            for doc_id, value in zip(pdf["doc_id"], pdf[column]):
                h = hashes_of(value)
                if len(h):
                    docs.append(int(doc_id))
                    found.append(h)
                    held += len(h)
                if held >= FLUSH:
                    yield from packed(docs, found)
                    docs, found, held = [], [], 0
        if found:
            yield from packed(docs, found)
    return run


def _owners(least: int, owners: bytes, hashes: bytes) -> np.ndarray:
    """The documents of a row's hashes."""
    return (unplanes(owners, len(hashes) // 8) + np.int64(least).view(np.uint64)).view(np.int64)


LATER, HOT = 1, 2  # bits of a reply


def _match(pdf: pd.DataFrame, hot: int | None = None) -> pd.DataFrame:
    """Windows of a bucket that occur in two or more documents, whether they are later there, and whether more than ``hot`` have them."""
    h = unblob(pdf["hashes"], np.uint64)
    sizes = [len(b) // 8 for b in pdf["hashes"]]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.concatenate([_owners(r.least, r.owners, r.hashes) for r in pdf.itertuples(index=False)])
    many = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(pdf["many"], sizes)]).astype(bool)
    order = np.lexsort((doc, h))
    hs, ds = h[order], doc[order]
    start = np.ones(len(hs), dtype=bool)
    start[1:] = hs[1:] != hs[:-1]
    group = np.cumsum(start) - 1
    least = ds[start]
    later = ds > least[group]
    more = np.zeros(len(least), dtype=bool)  # in two or more documents
    np.logical_or.at(more, group, later | many[order])
    is_later, is_repeated = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    is_later[order], is_repeated[order] = later, more[group]
    if hot is not None:
        every, n = np.unique(np.concatenate([h, unblob(pdf["later_hashes"], np.uint64)]), return_counts=True)
        often = every[n > hot]
    rows = []
    for r, a, z in zip(pdf.itertuples(index=False), cuts, cuts[1:]):
        keep = is_repeated[a:z]
        hashes = np.concatenate([h[a:z][keep], np.frombuffer(r.later_hashes, dtype=np.uint64)])
        owners = np.concatenate([unplanes(r.owners, z - a)[keep], unplanes(r.later_owners, len(r.later_hashes) // 8)])
        if len(hashes):
            flags = np.concatenate([is_later[a:z][keep], np.ones(len(r.later_hashes) // 8, dtype=bool)]).astype(np.uint8) * LATER
            if hot is not None:
                flags |= np.isin(hashes, often).astype(np.uint8) * np.uint8(HOT)
            rows.append((r.flush, r.least, blob(hashes), planes(owners), blob(flags)))
    return pd.DataFrame(rows, columns=["flush", "least", "hashes", "owners", "later"])


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    h, flags = unblob(pdf["hashes"], np.uint64), unblob(pdf["later"], np.uint8)
    owner = np.concatenate([_owners(*r) for r in zip(pdf["least"], pdf["owners"], pdf["hashes"])])
    order = np.lexsort((h, owner))
    h, owner, flags = h[order], owner[order], flags[order]
    hot, later = flags & HOT > 0, flags & LATER > 0
    ids, cuts = np.unique(owner, return_index=True)
    ends = [*cuts[1:], len(owner)]
    pick = lambda which: [blob(h[a:z][which[a:z]]) for a, z in zip(cuts, ends)]
    return pd.DataFrame({"doc_id": ids, "later": pick(later & ~hot), "first": pick(~later & ~hot), "hot": pick(hot)})


def repeated_windows(rows: DataFrame, column: str, hashes_of, n_buckets: int, name: str, self_repeats: bool = False, hot: int | None = None) -> DataFrame:
    """(doc_id, later, first, hot): blobs of the hashes of a document's windows that other documents have too.

    Those that more than ``hot`` documents have are listed apart, whether later or not.
    """
    dealt = rows.select("doc_id", column).mapInPandas(_deal(n_buckets, column, hashes_of, self_repeats), DEALT)
    found = dealt.groupBy("bucket").applyInPandas(lambda pdf: _match(pdf, hot), FOUND)
    return written(found.groupBy("flush").applyInPandas(_by_document, REPEATED), name)


# ---- levels ----------------------------------------------------------------------------------------

def _doubled(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of twice the length from survivors (hashes ``h`` at ascending positions ``at``)."""
    k = np.searchsorted(at, at + length)
    ok = k < len(at)
    ok[ok] = at[k[ok]] == at[ok] + length
    i, j = np.flatnonzero(ok), k[ok]
    return mixed(h[i] * MULTIPLIERS[0] + h[j] * MULTIPLIERS[1] + np.uint64(length)), at[i]


def _strip(length: int):
    """Remove covered words; the doubled windows of the document are the next level's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, later, first in zip(pdf["doc_id"], pdf["text"], pdf["later"], pdf["first"]):
                words = word_list(text, lower=False)
                h = run_hashes(word_hashes(words), length)
                later, first = unblob([] if later is None else later, np.uint64), unblob([] if first is None else first, np.uint64)
                is_later = np.isin(h, later)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, np.flatnonzero(is_later), 1)
                np.add.at(edge, np.flatnonzero(is_later) + length, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept = [w for w, c in zip(words, covered) if not c]
                at = np.flatnonzero(is_later | np.isin(h, first))
                hashes, places = _doubled(h[at], at, length)
                out.append((doc_id, len(words), int(covered.sum()), hashlib.sha256(b" ".join(kept)).digest(),
                            length if is_later.any() else 0, blob(hashes), blob(places.astype(np.int32))))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "sha", "longest", "hashes", "places"])
    return run


def _extend(length: int):
    """Survivors of this level, doubled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                h, at = np.frombuffer(r.hashes, dtype=np.uint64), np.frombuffer(r.places, dtype=np.int32).astype(np.int64)
                later, first = unblob(r.later, np.uint64), unblob(r.first, np.uint64)
                is_later = np.isin(h, later)
                live = is_later | np.isin(h, first)
                hashes, places = _doubled(h[live], at[live], length)
                out.append((r.doc_id, length if is_later.any() else 0, blob(hashes), blob(places.astype(np.int32))))
            yield pd.DataFrame(out, columns=["doc_id", "longest", "hashes", "places"])
    return run


def per_document(repeated: DataFrame) -> DataFrame:
    return repeated.groupBy("doc_id").agg(F.collect_list("later").alias("later"), F.collect_list("first").alias("first"), F.collect_list("hot").alias("hot"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, longest of every document."""
    spark = docs.sparkSession
    rows = select_plain(docs, "doc_id", "text")
    n_buckets = max(8, -(-text_bytes(rows) // BUCKET_BYTES))
    words = written(rows.mapInPandas(_word_rows, WORDS), "substring-words")

    # documents whose word sequence a smaller doc_id has as well
    long = words.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
    salted = long.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = salted.groupBy("sha", "salt").agg(F.min("doc_id").alias("m"))
    first = first.select("sha", "salt").join(first.groupBy("sha").agg(F.min("m").alias("least")), "sha")
    copies = written(salted.join(first, ["sha", "salt"]).where("doc_id > least").select("doc_id", "sha", "n_words").distinct(), "substring-copies")
    copy_ids = copies.select("doc_id").distinct()

    # rows that share their id with a copy but not its text are told apart by their own sequence below
    known = rows.where("doc_id is not null")
    several = words.groupBy("doc_id").agg(F.count_distinct("sha").alias("n")).where("n > 1").select("doc_id")
    copy_ids = copy_ids.join(several, "doc_id", "left_anti")
    copy_ids = written(copy_ids, "substring-copy-ids")
    single = anti_join_small(known, copy_ids, "doc_id")
    repeated = repeated_windows(single, "text", _of_text, n_buckets, "substring-level0")
    release(spark)

    ids = written(repeated.select("doc_id").distinct(), "substring-affected")
    texts = probed(single, ids, "doc_id").where("_maybe").drop("_maybe").join(per_document(repeated), "doc_id")
    state = written(texts.mapInPandas(_strip(length), "doc_id long, n_words long, n_removed long, sha binary, longest int, hashes binary, places binary"), "substring-stripped")
    release(spark)

    longest = [state.select("doc_id", "longest")]
    level, at = state.select("doc_id", "hashes", "places").where(F.length("hashes") > 0), length
    while not level.isEmpty():
        at *= 2
        found = repeated_windows(level, "hashes", _of_blob, n_buckets, f"substring-level{at}")
        nxt = level.join(per_document(found), "doc_id").mapInPandas(_extend(at), "doc_id long, longest int, hashes binary, places binary")
        nxt = written(nxt, f"substring-state{at}")
        longest.append(nxt.select("doc_id", "longest"))
        level = nxt.select("doc_id", "hashes", "places").where(F.length("hashes") > 0)
        release(spark)
    found = longest[0]
    for more in longest[1:]:
        found = found.unionByName(more)
    found = found.groupBy("doc_id").agg(F.max("longest").cast("long").alias("longest"))

    # copies are gone as a whole; documents without repeats stay whole; the others come from the stripped texts
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = copies.join(copy_ids, "doc_id", "left_semi")
    copied = words.join(whole.select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), empty.alias("kept_sha256"), F.col("n_words").alias("longest"))
    stripped = state.join(found, "doc_id").select("doc_id", "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"), found["longest"])
    settled = copy_ids.union(ids)
    rest = words.join(settled.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left_anti")
    rest = rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"), F.lit(0).cast("long").alias("longest"))
    return rest.unionByName(copied).unionByName(stripped)
