"""Label handling: sentinels, top-1 selection, lookups, error triage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonotable import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_label(col, drop=(S.TOO_SHORT, S.ERROR)) -> Column:
    """True for a real value: not null and not one of the dropped sentinels.

    Dominant-value metrics drop ``too_short``/``error`` but keep ``unknown``;
    the language list of a file also drops ``unknown``.
    """
    c = _c(col)
    return c.isNotNull() & ~c.isin(*drop)


def ranked_scores(scores) -> Column:
    """Sort an ``ARRAY<STRUCT<label, score>>`` best first; equal scores keep list order."""
    indexed = F.transform(_c(scores), lambda s, i: F.struct(s["label"].alias("label"), s["score"].alias("score"), i.alias("pos")))
    ordered = F.array_sort(
        indexed,
        lambda a, b: F.when(a["score"] > b["score"], -1)
        .when(a["score"] < b["score"], 1)
        .when(a["pos"] < b["pos"], -1)
        .when(a["pos"] > b["pos"], 1)
        .otherwise(0),
    )
    return F.transform(ordered, lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))


def top_label(scores) -> Column:
    """Best entry of a score list: struct(label, score rounded to 3)."""
    best = F.get(ranked_scores(scores), 0)
    return F.struct(best["label"].alias("label"), F.round(best["score"], 3).alias("score"))


def argmax_map(probs) -> Column:
    """Key with the largest value of a ``MAP<STRING, DOUBLE>``; the first of equal maxima wins."""
    entries = F.map_entries(_c(probs))
    first = F.get(entries, 0)
    best = F.aggregate(
        entries,
        first,
        lambda acc, e: F.when(e["value"] > acc["value"], e).otherwise(acc),
    )
    return F.struct(best["key"].alias("label"), best["value"].alias("score"))


def _lookup(mapping: dict, col, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(col)), F.lit(default))


def emotion_color(emotion) -> Column:
    return F.coalesce(_lookup(S.EMOTION_COLORS, F.coalesce(_c(emotion), F.lit("")), S.DEFAULT_COLOR))


def stage_progress(stage) -> Column:
    """Progress fraction reached when ``stage`` reports (unknown stage -> 0.0)."""
    return _lookup(S.STAGE_WEIGHTS, F.coalesce(_c(stage), F.lit("")), 0).cast("double") / F.lit(100.0)


def classify_error(text) -> Column:
    """Error category: memory / auth / tool / other, first matching rule wins."""
    t = _c(text)
    low = F.lower(t)
    out = None
    for name, ci_needles, cs_needles in S.ERROR_RULES:
        cond = None
        for n in ci_needles:
            c = low.contains(n)
            cond = c if cond is None else cond | c
        for n in cs_needles:
            c = t.contains(n)
            cond = c if cond is None else cond | c
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("other"))
