"""N-gram Jaccard self-join of documents by token-combination prefixes, down to its connected components.

Tokens are a document's distinct word 5-shingles (64-bit hashes), in one global order:
rarest first. If two sets overlap in at least ``a`` tokens, their prefixes of
``size - a + k`` tokens share at least ``k``. With ``k = 2`` the shared prefix tokens
hold a token of the rare class, or two of the frequent class; so rare tokens of the
prefix are indexed alone and frequent ones in combinations of two. That keeps texts
apart that share one frequent passage and little else.

Steps, all of them shuffles of packed rows or of narrow ones:

1. Equal sets become one class, represented by its smallest ``doc_id``; only narrow rows
   (doc_id, size, 128-bit signature of the set) are kept of all documents.
2. Every token of every set is dealt to a bucket by hash. A token that occurs in one set
   only can't be shared, so a set with less than 75 % shared tokens can't have a partner
   and drops out. This needs 32 bits of the hash: a collision only keeps a set longer.
3. The sets left are dealt out with whole hashes, their document frequencies come back,
   prefixes are cut and indexed. Each signature links its sets to the smallest of them
   (a star, so a signature costs as many rows as it has sets); connected candidates form
   a group, which holds every pair that shares a signature.
4. Sets of a group meet and are verified by their exact overlap. A set is compared with
   members of every component found so far until it is linked to it, so what comes out
   is a spanning forest, not all pairs. Groups above ``BLOCK`` sets are split into pairs
   of blocks, one task each, which verify all that single tasks would.

Defined results: null or wordless texts have an empty set, link with nothing and are
their own component; rows with a null ``doc_id`` take no part in links (null component);
repeated ids count as one document with links of each of their texts; other columns are
ignored or passed on; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import anti_join_small, connected, release, select_plain, semi_join_small, text_bytes, written
from sonotable.llm.hashing import blob, bucket_of, mixed, planes, run_hashes, unblob, unplanes, word_hashes, word_list

WORDS = 5
NUM, DEN = 75, 100       # link when DEN * intersection >= NUM * union
RARE_DF = 2000           # tokens of more sets than this are of the frequent class
K = 2                    # size of a combination
FLUSH = 1 << 20          # tokens gathered before a task sends packed rows
BUCKET_BYTES = 16 << 20  # text per bucket
BLOCK = 1024            # sets verified in one task against each other


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-shingles; with fewer words, of the whole sequence."""
    words = word_hashes(word_list(text, lower=True))
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(run_hashes(words, WORDS) if len(words) >= WORDS else mixed(run_hashes(words, len(words)) + np.uint64(len(words))))


def least_overlap(n):
    """Smallest overlap that a set of ``n`` tokens can have with any partner."""
    return -(-NUM * n // DEN)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(np.frombuffer(d, dtype="<i8").tolist())


def _set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_set(t) for t in pdf["text"]]
        sigs = [_signature(s) for s in sets]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "s0": [a for a, _ in sigs], "s1": [b for _, b in sigs]})


# ---- packed exchange of tokens ---------------------------------------------------------------------

DEALT = "bucket int, flush binary, held int, keys binary, owners binary, counts binary, ids binary"


def _deal(n_buckets: int, narrow: bool):
    """Packed rows, one per bucket and flush: keys of the sets' tokens in the bucket, set by set.

    A row lists the ``held`` sets that have tokens in it (``owners``, as steps from one to the
    next) and how many each has, so what is sent follows the tokens, however many buckets
    there are. The rows of bucket 0 also hold what identifies the sets: (s0, s1, id, size). A flush is
    named by a hash of its sets, so that a task that runs again sends the same rows. Tasks
    that read the same rows send flushes of one name and content; a bucket keeps one of them.
    """
    def packed(sets: dict) -> Iterator[pd.DataFrame]:
        tokens = np.concatenate([t for t, _ in sets.values()])
        sizes = np.array([len(t) for t, _ in sets.values()], dtype=np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bucket = bucket_of(tokens, n_buckets)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
        ids = blob(np.array([(*sig, doc_id, len(t)) for sig, (t, doc_id) in sets.items()], dtype=np.int64))
        name = xxhash.xxh3_128_digest(ids)
        rows = []
        for b in range(n_buckets):
            a, z = ends[b], ends[b + 1]
            keys = tokens[a:z].astype(np.uint32) if narrow else tokens[a:z]
            if z > a or b == 0:
                own, counts = np.unique(owner[a:z], return_counts=True)
                rows.append((b, name, len(own), blob(keys), planes(np.diff(own, prepend=0)), planes(counts), ids if b == 0 else None))
        yield pd.DataFrame(rows, columns=["bucket", "flush", "held", "keys", "owners", "counts", "ids"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict = {}
        held = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                tokens = shingle_set(text)
                if len(tokens):
                    sig = _signature(tokens)
                    if sig not in sets:  # copies within a flush count once
                        sets[sig] = (tokens, int(doc_id))
                        held += len(tokens)
                if held >= FLUSH:
                    yield from packed(sets)
                    sets, held = {}, 0
        if sets:
            yield from packed(sets)
    return run


def _owner_of(row) -> np.ndarray:
    """The set, by its place in the flush, of every key of a row."""
    return np.repeat(np.cumsum(unplanes(row.owners, row.held).astype(np.int64)), unplanes(row.counts, row.held).astype(np.int64))


def _shared_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the sets in each flush, how many of their tokens in this bucket other sets have as well."""
    pdf = pdf.drop_duplicates("flush")
    keys = unblob(pdf["keys"], np.uint32)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.zeros(len(k), dtype=bool)
    if len(k) > 1:
        same = k[1:] == k[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    shared = np.zeros(len(k), dtype=bool)
    shared[order] = twin
    out, at = [], 0
    for row in pdf.itertuples(index=False):
        owner = _owner_of(row)
        own, n = np.unique(owner[shared[at:at + len(owner)]], return_counts=True)
        at += len(owner)
        if len(own) or row.ids is not None:
            out.append((row.flush, len(own), planes(np.diff(own, prepend=0)), planes(n), row.ids))
    return pd.DataFrame(out, columns=["flush", "held", "owners", "counts", "ids"])


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sets of a flush that may have a partner."""
    ids = unblob([b for b in pdf["ids"] if b is not None], np.int64).reshape(-1, 4)
    shared = np.bincount(np.concatenate([_owner_of(r) for r in pdf.itertuples(index=False)]), minlength=len(ids))
    keep = ids[shared >= least_overlap(ids[:, 3])]
    return pd.DataFrame({"s0": keep[:, 0], "s1": keep[:, 1]})


def _with_df(pdf: pd.DataFrame) -> pd.DataFrame:
    """Keys of a bucket and the number of sets that have each."""
    pdf = pdf.drop_duplicates("flush")
    keys = unblob(pdf["keys"], np.uint64)
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    df = n[inverse].astype(np.uint32)
    sizes = [len(k) // 8 for k in pdf["keys"]]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return pd.DataFrame({"bucket": pdf["bucket"], "flush": pdf["flush"], "held": pdf["held"], "keys": pdf["keys"], "owners": pdf["owners"], "counts": pdf["counts"], "ids": pdf["ids"],
                         "df": [blob(df[a:b]) for a, b in zip(cuts, cuts[1:])]})


def signatures(tokens: np.ndarray, df: np.ndarray, rare_df: int = RARE_DF) -> np.ndarray:
    """What a set is indexed under: rare tokens of its extended prefix, and pairs of frequent ones."""
    n = len(tokens)
    order = np.lexsort((tokens, df))[:n - int(least_overlap(n)) + K]
    tokens, df = tokens[order], df[order]
    single = tokens[(df > 1) & (df <= rare_df)]
    often = np.sort(tokens[df > rare_df])
    i, j = np.triu_indices(len(often), 1)
    return np.concatenate([single, mixed(often[i] * np.uint64(0x9E3779B97F4A7C15) + often[j])])


def _indexed(rare_df: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole sets of a flush with their signatures."""
        pdf = pdf.sort_values("bucket")
        ids = unblob([b for b in pdf["ids"] if b is not None], np.int64).reshape(-1, 4)
        keys, df = unblob(pdf["keys"], np.uint64), unblob(pdf["df"], np.uint32)
        owner = np.concatenate([_owner_of(r) for r in pdf.itertuples(index=False)])
        order = np.argsort(owner, kind="stable")  # buckets ascend with the hash, so each set is sorted again
        keys, df = keys[order], df[order]
        cuts = np.concatenate([[0], np.cumsum(ids[:, 3])])
        out = [(int(i[2]), blob(keys[a:b]), signatures(keys[a:b], df[a:b], rare_df).astype(np.int64).tolist()) for i, a, b in zip(ids, cuts, cuts[1:])]
        return pd.DataFrame(out, columns=["id", "tokens", "signatures"])
    return run


# ---- verification ----------------------------------------------------------------------------------

def linked(x: np.ndarray, y: np.ndarray) -> bool:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * n >= NUM * (len(x) + len(y) - n)


def forest(ids: list[int], sets: list[np.ndarray], keys: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components among ``sets``; with ``side``, only links between sides count.

    Sets come in by size. A set's candidates are those before it that share one of its
    signatures (``keys``) and are not in its component yet: of a component with many, the
    latest few are tried first, and all that then remain are verified by lookup.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets, keys = [ids[i] for i in order], [sets[i] for i in order], [keys[i] for i in order]
    side = None if side is None else side[order]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    # postings of each signature, in the order in which the sets come in
    flat = np.concatenate(keys)
    _, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    by_code = np.argsort(code, kind="stable")
    posting = owner[by_code]
    start = np.searchsorted(code[by_code], np.arange(int(code.max()) + 2 if len(code) else 1))
    seen = np.zeros(len(start), dtype=np.int64)
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    home = np.arange(len(sets))
    edges: list[tuple[int, int]] = []

    def merge(i: int, j: int) -> None:
        edges.append((ids[i], ids[j]))
        home[home == home[i]] = home[j]

    for i, x in enumerate(sets):
        near = np.zeros(i, dtype=bool)
        for c in np.unique(code[cuts[i]:cuts[i + 1]]):
            near[posting[start[c]:start[c] + seen[c]]] = True
            seen[c] += 1
        near &= DEN * size[:i] >= NUM * size[i]
        if side is not None:
            near &= side[:i] != side[i]
        rest = np.flatnonzero(near)
        homes, n = np.unique(home[rest], return_counts=True)
        for h in homes[n > 8]:
            for j in rest[home[rest] == h][-1:-9:-1]:
                if home[j] != home[i] and linked(x, sets[j]):
                    merge(i, j)
                    break
        rest = rest[home[rest] != home[i]]
        for at in range(0, len(rest), 256):
            part = rest[at:at + 256]
            part = part[home[part] != home[i]]
            if not len(part):
                continue
            tokens = np.concatenate([sets[j] for j in part])
            where = np.minimum(np.searchsorted(x, tokens), len(x) - 1)
            n = np.add.reduceat((x[where] == tokens).astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
            for j in part[DEN * n >= NUM * (size[i] + size[part] - n)]:
                if home[j] != home[i]:
                    merge(i, j)
    return edges


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = [np.frombuffer(b, dtype=np.uint64) for b in pdf["tokens"]]
    cross = bool(pdf["i"].iloc[0] != pdf["j"].iloc[0])
    return pd.DataFrame(forest(pdf["id"].tolist(), sets, [np.asarray(s) for s in pdf["signatures"]], pdf["block"].to_numpy() if cross else None), columns=["a", "b"])


# ---- the join --------------------------------------------------------------------------------------

def jaccard_components(docs: DataFrame, rare_df: int = RARE_DF, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    rows = select_plain(docs, "doc_id", "text")
    n_buckets = max(8, -(-text_bytes(rows) // BUCKET_BYTES))
    sets = written(rows.mapInPandas(_set_rows, "doc_id long, n long, s0 long, s1 long"), "ngram-sets")
    known = sets.where("n > 0 and doc_id is not null")
    classes = known.groupBy("s0", "s1").agg(F.min("doc_id").alias("id"))

    dealt = rows.where("doc_id is not null").mapInPandas(_deal(n_buckets, True), DEALT)
    shared = dealt.groupBy("bucket").applyInPandas(_shared_counts, "flush binary, held int, owners binary, counts binary, ids binary")
    left = shared.groupBy("flush").applyInPandas(_survivors, "s0 long, s1 long").distinct()
    chosen = written(left.join(classes, ["s0", "s1"]).select(F.col("id").alias("doc_id")).distinct(), "ngram-chosen")
    del dealt, shared, left
    release(spark)
    texts = semi_join_small(rows, chosen, "doc_id")

    freq = texts.mapInPandas(_deal(n_buckets, False), DEALT).groupBy("bucket").applyInPandas(_with_df, DEALT + ", df binary")
    indexed = written(freq.groupBy("flush").applyInPandas(_indexed(rare_df), "id long, tokens binary, signatures array<long>"), "ngram-indexed")
    entries = indexed.select("id", F.explode("signatures").alias("signature"))
    first = entries.groupBy("signature").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = entries.join(first, "signature").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    groups = connected(stars, "ngram-candidates")

    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    member = groups.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block b meets itself and every other block: tasks (i, j) with i <= j
    tasks = member.select("root", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("root", F.col("node").alias("id"), "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = tasks.join(indexed, "id")
    links = met.groupBy("root", "i", "j").applyInPandas(_verify, "a long, b long")
    # texts that share an id are one document
    repeated = known.select("doc_id", "s0", "s1").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    tied = known.join(repeated, "doc_id", "left_semi").join(classes, ["s0", "s1"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    roots = connected(links.union(tied), "ngram-links")
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("s0", "s1", F.coalesce("root", "id").alias("component"))
    return _named(sets, named)


def _named(sets: DataFrame, named: DataFrame, salts: int = 64) -> DataFrame:
    """Each document with its class's component; classes may hold a third of all rows, so they meet by (class, salt)."""
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    known = sets.where("n > 0 and doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    salted = known.select("s0", "s1", "salt").distinct().join(named, ["s0", "s1"])
    out = known.join(salted, ["s0", "s1", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a smaller ``doc_id`` of their component stands for."""
    names = docs.columns
    gone = written(jaccard_components(docs, **options).where("doc_id != component_id").select(F.col("doc_id").alias("_id")).distinct(), "ngram-gone")
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))]).withColumn("_id", F.col(f"_c{names.index('doc_id')}"))
    return anti_join_small(inner, gone, "_id").drop("_id").toDF(*names)
