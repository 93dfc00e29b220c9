"""Merkle manifest of a dataset as a content-addressed DAG, and proofs by descent from its root.

Leaves are digests of rows, a tree per group (``lang``), trees in the order of their group
below one root. Every two nodes in a row become one, a last node alone becomes its own
digest, until one is left. What is stored is not nodes but *records*: the digest of a node
``SEGMENT`` levels up, and the digests of the nodes below it (256 at most); the levels in
between follow from those by hashing.

A proof descends: a request starts with the root's digest, looks the digest up among the
records, takes the child that the next digit of its rank (base 256) names, and collects what
it did not take on the way, level by level; the segments are reversed at the end. Requests
that follow the same path are one row until they part, so a step has a row per record, not
per leaf, and only the last one, which has the leaves' own rows beside it, yields a row per
request. No path is shuffled.

Ranks come from a range partitioning of narrow rows (``sequence.ranged_index``), so a group
with most of the rows is spread; a record's task holds 256 children. Everything is written
to the shared folder before it is used again.

Defined results: rows without group come first; rows with equal group and ``doc_id`` are
ordered by their leaf; a null value is hashed as ``-``, an empty text as ``0:``; one row
alone is its own subroot and, if it is the only one, the root; an empty table gives no
rows. Of other columns nothing is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import select_plain, written
from sonotable.operators.sequence import ranged, ranged_index, ranged_ranks

SEGMENT = 8  # levels of a record
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
RECORD_T = "tree long, pos long, digest string, depth int, children array<string>"
STEP_T = "tree long, pos long, digest string, path string"
ANSWER_T = "tree long, doc_id string, claimed string, digest string, path string"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (hex) of the values one after the other: ``-`` for null, else UTF-8 bytes, a colon, the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(children: list[str], depth: int) -> list[list[str]]:
    """The children and the ``depth`` levels above them; the last one is the record's own digest."""
    levels = [children]
    for _ in range(depth):
        low = levels[-1]
        levels.append([_digest(low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def segment(levels: list[list[str]], digit: int) -> list[str]:
    """What is not taken on the way down to child ``digit``, top first: L or R and the digest, ``-`` where there is none."""
    out = []
    for k in reversed(range(len(levels) - 1)):
        other = digit >> k ^ 1
        out.append(("LR"[other & 1] + levels[k][other]) if other < len(levels[k]) else "-")
    return out


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        roots = [levels_above(list(c), d)[-1][0] for c, d in zip(pdf["children"], pdf["depth"])]
        yield pdf.assign(digest=roots)[["tree", "pos", "digest", "depth", "children"]]


def build(nodes: DataFrame, heights: DataFrame, name: str) -> tuple[DataFrame | None, list[DataFrame]]:
    """Records of trees over ``nodes`` (tree, pos, digest), by segment from below, and (tree, digest) of their roots.

    ``heights`` (tree, height) has the levels of every tree: the bits of its size less one.
    """
    tall = heights.agg(F.max("height")).first()[0]
    if tall is None:
        return None, []
    roots = nodes.join(heights.where("height = 0"), "tree").select("tree", "digest")
    stored = []
    for low in range(0, tall, SEGMENT):
        above = nodes.join(heights.where(F.col("height") > low), "tree")
        blocks = above.groupBy("tree", F.shiftright("pos", SEGMENT).alias("pos"), F.least(F.lit(SEGMENT), F.col("height") - low).cast("int").alias("depth")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "digest")))["digest"].alias("children"))  # 2 ** SEGMENT at most
        stored.append(written(blocks.mapInPandas(_records, RECORD_T), f"{name}-records"))
        nodes = stored[-1].select("tree", "pos", "digest")
        roots = roots.unionByName(nodes.join(heights.where(F.col("height").between(low + 1, low + SEGMENT)), "tree").select("tree", "digest"))
    return roots, stored


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            levels = levels_above(list(r.children), r.depth)
            for digit in map(int, r.digits):
                rows.append((r.tree, (r.pos << SEGMENT) + digit, levels[0][digit], ",".join(([r.path] if r.path else []) + segment(levels, digit))))
        yield pd.DataFrame(rows, columns=["tree", "pos", "digest", "path"])


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            levels = levels_above(list(r.children), r.depth)
            for digit, doc_id, claimed in zip(r.digits, r.doc_ids, r.claims):
                path = ([r.path] if r.path else []) + segment(levels, int(digit))
                rows.append((r.tree, doc_id, claimed, levels[0][int(digit)], ",".join(path)))
        yield pd.DataFrame(rows, columns=["tree", "doc_id", "claimed", "digest", "path"])


def _found(state: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of ``state`` with the record that their digest names."""
    store = records.select("digest", "depth", "children").dropDuplicates(["digest"])  # equal digests, equal children
    return state.join(store, "digest")


def descend(state: DataFrame, records: list[DataFrame], heights: DataFrame, wanted: DataFrame, low: int) -> DataFrame:
    """``state`` (tree, pos, digest, path) at the roots, taken down to the nodes of ``wanted`` (tree, pos) above segment ``low``."""
    for b in reversed(range(low, len(records))):
        digits = wanted.select("tree", F.shiftright("pos", SEGMENT * (b - low)).alias("pos")).distinct()
        asked = digits.groupBy("tree", F.shiftright("pos", SEGMENT).alias("pos")).agg(F.collect_list(F.col("pos").bitwiseAND((1 << SEGMENT) - 1)).alias("digits"))
        tall = heights.where(F.col("height") > SEGMENT * b).select("tree")
        moved = _found(state.join(tall, "tree", "left_semi").join(asked, ["tree", "pos"]), records[b]).mapInPandas(_steps, STEP_T)
        state = written(moved.unionByName(state.join(tall, "tree", "left_anti").select("tree", "pos", "digest", "path")), "merkle-state")
    return state


def _height(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def proofs(leaves: DataFrame) -> DataFrame:
    """Every leaf's way to the root: doc_id, leaf, claimed, subroot, root, siblings.

    ``leaves`` (doc_id, lang, leaf, claimed) is a written table; ``claimed`` is any digest
    whose place is asked for and is handed on. ``siblings`` goes from the leaf to the root:
    ``L`` or ``R`` (the side it is on) and a digest, or ``-`` for a node that is alone.
    """
    spark = leaves.sparkSession
    ranked = written(ranged_index(leaves, "lang", ["doc_id", "leaf"], name="pos"), "merkle-ranked")
    sizes = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    trees = written(ranged_ranks(ranged(sizes, "lang", []), "tree").select("lang", "tree", "n", _height(F.col("n")).alias("height")), "merkle-trees")
    heights = trees.select("tree", "height")
    numbered = ranked.withColumnRenamed("lang", "_lang").join(trees.select("lang", "tree"), F.col("_lang").eqNullSafe(F.col("lang"))).drop("_lang", "lang")

    subroots, records = build(numbered.select("tree", "pos", F.col("leaf").alias("digest")), heights, "merkle")
    if subroots is None:
        return spark.createDataFrame([], "doc_id long, leaf string, claimed string, subroot string, root string, siblings array<string>")
    # the tree of the subroots, number 0 of its own; written, so that its joins stay joins on keys
    subroots = written(subroots, "merkle-subroots")
    zero = F.lit(0).cast("long")
    top = written(trees.agg(F.count(F.lit(1)).alias("n")).select(zero.alias("tree"), _height(F.col("n")).alias("height")), "merkle-top-height")
    upper = written(subroots.select(zero.alias("tree"), F.col("tree").alias("pos"), "digest"), "merkle-top-nodes")
    roots, top_records = build(upper, top, "merkle-top")
    root = roots.first()["digest"]

    state = written(spark.range(1).select(zero.alias("tree"), zero.alias("pos"), F.lit(root).alias("digest"), F.lit("").alias("path")), "merkle-state")
    state = descend(state, top_records, top, upper.select("tree", "pos"), 0)
    state = state.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "digest", "path")
    state = descend(state, records, heights, numbered.select("tree", F.shiftright("pos", SEGMENT).alias("pos")).distinct(), 1)

    asked = numbered.select("tree", F.shiftright("pos", SEGMENT).alias("pos"), F.struct(
        F.col("pos").bitwiseAND((1 << SEGMENT) - 1).alias("digit"), F.col("doc_id").cast("string").alias("doc_id"), "claimed").alias("r"))
    asked = asked.groupBy("tree", "pos").agg(F.collect_list("r").alias("r")).select(  # 2 ** SEGMENT requests at most
        "tree", "pos", F.col("r.digit").alias("digits"), F.col("r.doc_id").alias("doc_ids"), F.col("r.claimed").alias("claims"))
    met = state.join(asked, ["tree", "pos"])
    alone = met.join(heights.where("height = 0"), "tree").select("tree", F.get("doc_ids", F.lit(0)).alias("doc_id"), F.get("claims", F.lit(0)).alias("claimed"), "digest", "path")
    found = alone
    if records:
        found = _found(met.join(heights.where("height > 0"), "tree"), records[0]).mapInPandas(_answers, ANSWER_T).unionByName(alone)
    out = found.join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    way = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split("path", ",")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("digest").alias("leaf"), "claimed", "subroot", F.lit(root).alias("root"), way.alias("siblings"))


def folded(claimed: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    def step(at: Column, s: Column) -> Column:
        side, other = F.substring(s, 1, 1), F.substring(s, 2, 64)
        return F.sha2(F.when(side == "-", at).when(side == "L", F.concat(other, at)).otherwise(F.concat(at, other)).cast("binary"), 256)
    return F.aggregate(siblings, claimed, step)


def proof_digest(siblings: Column) -> Column:
    """One digest of all siblings, from the leaf to the root."""
    there = F.filter(siblings, lambda s: s != "-")
    return F.sha2(F.concat_ws("", F.transform(there, lambda s: F.substring(s, 2, 64))).cast("binary"), 256)


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf and claimed of every row: the leaf, or where ``tampered`` holds that of a row with ``n_chars`` one higher."""
    rows = select_plain(docs, *COLUMNS)
    whole = leaf_digest([F.col(c) for c in COLUMNS])
    more = leaf_digest([(F.col(c).cast("decimal(20,0)") + 1).cast("decimal(21,0)") if c == "n_chars" else F.col(c) for c in COLUMNS])
    claimed = whole if tampered is None else F.when(tampered, more).otherwise(whole)
    return written(rows.select("doc_id", "lang", whole.alias("leaf"), claimed.alias("claimed")), "merkle-leaves")


def audited(docs: DataFrame, every: int = 7) -> DataFrame:
    """Proofs of all rows, checked against rows of which some are changed (``every`` divides the CRC-32 of the id)."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    way = proofs(leaves_of(docs, changed))
    found = way.withColumn("folded_root", folded(F.col("claimed"), F.col("siblings")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
