r"""Secret scan with multipart credential linking (DataFrame functions only).

Base findings come from three patterns and stand alone. Weak candidates are parts of a
credential that mean little alone: an access identifier, a key-like run, an endpoint.
They are reported only when complementary parts co-occur in a scope, that is when their
starts are at most ``scope`` characters apart: a key-like run beside an identifier or an
endpoint, an identifier or an endpoint beside a key-like run.

The interval join is an equi join on (text, cell), a cell being ``scope`` characters
long. Per cell and kind only the first and the last start are kept, and a part looks
into its own cell and the two beside it, so pairs of parts are never listed and a text
full of parts costs no more than their number.

Positions: ``regexp_extract_all`` gives each match and the text before it (``\G`` ties a
match to the end of the last one, so a text is read once); running sums of their lengths
are offsets in code points.

Defined results: null text counts as empty; rows with equal (doc_id, text), null ids
included, get equal results; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import select_plain, written

# Patterns of the base findings. A run that is greedy and as long as it can be needs no later
# check of its length; the value of an assignment does, because a short one still uses up its characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}()"
HEX = r"[0-9a-f]{24,}()"
ASSIGN_VALUE = 6
# Parts of a credential.
KEY_ID = r"(?:AKIA|ASIA|AIDA|AGPA)[A-Z0-9]{8,}()"
KEY_RUN = r"([A-Za-z0-9+/_-]{20,})"
ENDPOINT = r"(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:@/-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})()"
KINDS = ("assign", "access", "hex", "linked_id", "linked_key", "linked_endpoint")


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches whose last group passes ``keep``."""
    found = F.lit(rf"\G(?s:(.*?))({pattern})")
    gaps, wholes, values = (F.regexp_extract_all(text, found, F.lit(g)) for g in (1, 2, 3))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["g"])
        end = start + F.length(m["w"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), m["v"].alias("value")))).alias("out"))

    matches = F.zip_with(F.zip_with(gaps, wholes, lambda g, w: F.struct(g.alias("g"), w.alias("w"))), values,
                         lambda a, v: F.struct(a["g"].alias("g"), a["w"].alias("w"), v.alias("v")))
    spans = F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    if keep is not None:
        spans = F.filter(spans, keep)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _named(kind: str) -> Column:
    """The spans of column ``kind`` as (kind, start, end)."""
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _if_any(text: Column, test: str, spans: Column) -> Column:
    """Most texts have no match: a plain search spares them the walk over captures."""
    return F.when(text.rlike(test), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text, and per kind the spans of base findings and of parts."""
    text = F.col("text")
    key_like = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~x["value"].rlike("^(?:AKIA|ASIA|AIDA|AGPA)[A-Z0-9]+$")
    return select_plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.length("text").alias("text_len"),
        _if_any(text, "(?i:password|passwd|secret|token|api_?key)", _spans(text, ASSIGN, lambda x: F.length(x["value"]) >= ASSIGN_VALUE)).alias("assign"),
        _if_any(text, "AKIA", _spans(text, ACCESS)).alias("access"),
        _if_any(text, "[0-9a-f]{24}", _spans(text, HEX)).alias("hex"),
        _if_any(text, "(?:AKIA|ASIA|AIDA|AGPA)", _spans(text, KEY_ID)).alias("linked_id"),
        _if_any(text, "[A-Za-z0-9+/_-]{20}", _spans(text, KEY_RUN, key_like)).alias("linked_key"),
        _if_any(text, r"://|[0-9]\.[0-9]", _spans(text, ENDPOINT)).alias("linked_endpoint"))


def link_parts(found: DataFrame, scope: int) -> DataFrame:
    """Parts of ``found`` with a complementary part in scope: doc_id, text_key, text_len, linked (kind, start, end)."""
    key = ["doc_id", "text_key", "text_len"]
    listed = F.concat(*[_named(k) for k in KINDS[3:]])
    parts = found.where((F.size("linked_key") > 0) & ((F.size("linked_id") > 0) | (F.size("linked_endpoint") > 0)))
    parts = parts.select(*key, F.explode(listed).alias("p")).select(*key, "p.*").distinct()
    parts = parts.withColumn("cell", F.floor(F.col("start") / scope)).withColumn("is_key", F.col("kind") == "linked_key")
    cells = parts.groupBy(*key, "is_key", "cell").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    reach = cells.select(*[F.col(c).alias(f"r_{c}") for c in key], (~F.col("is_key")).alias("r_for_key"),
                         F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("r_cell"), F.col("cell").alias("r_of"), "first", "last")
    near = parts.join(reach, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in key] + [F.col("is_key") == F.col("r_for_key"), F.col("cell") == F.col("r_cell")])
    # in the part's own cell all starts are in scope; in a cell beside it, the start nearest to it decides
    near = near.where((F.col("r_of") == F.col("cell")) | ((F.col("r_of") < F.col("cell")) & (F.col("start") - F.col("last") <= scope))
                      | ((F.col("r_of") > F.col("cell")) & (F.col("first") - F.col("start") <= scope)))
    return near.groupBy(*key).agg(F.collect_set(F.struct("kind", "start", "end")).alias("linked"))


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id and ``spans``: array of (start, rank, kind, end), by start, then kind as in ``KINDS``."""
    found = written(candidates(docs), "secret-candidates")
    linked = link_parts(found, scope)
    key = ["doc_id", "text_key", "text_len"]
    right = linked.select(*[F.col(c).alias(f"r_{c}") for c in key], "linked")
    out = found.join(right, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in key], "left")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    base = F.concat(*[_named(k) for k in KINDS[:3]])
    every = F.concat(base, F.coalesce("linked", none))
    spans = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return out.select("doc_id", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
