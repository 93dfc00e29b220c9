"""Time and number formatting as column expressions (no UDFs).

Times are integer milliseconds. Seconds as doubles are made only here, so
the three engines that touch the data never disagree on rounding a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ms_to_seconds(ms) -> Column:
    """Exact seconds as a double (ms values are whole milliseconds)."""
    return _c(ms).cast("double") / F.lit(1000.0)


def round_ms_2(ms) -> Column:
    """Seconds rounded to 2 places, half up on the exact millisecond value."""
    return F.floor((_c(ms) + F.lit(5)) / F.lit(10)).cast("double") / F.lit(100.0)


def format_time(ms) -> Column:
    """``m:ss`` or ``h:mm:ss`` of a millisecond count; truncates; negative -> ``0:00``."""
    ms = _c(ms)
    total = F.when(ms < 0, F.lit(0)).otherwise(F.floor(ms / F.lit(1000))).cast("long")
    h = (total / 3600).cast("long")
    m = (F.pmod(total, F.lit(3600)) / 60).cast("long")
    s = F.pmod(total, F.lit(60))
    ss = F.lpad(s.cast("string"), 2, "0")
    return F.when(
        h > 0,
        F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0"), ss),
    ).otherwise(F.concat_ws(":", m.cast("string"), ss))


def format_seconds_time(seconds) -> Column:
    """``format_time`` of a seconds double (truncation toward zero)."""
    sec = _c(seconds)
    return F.when(sec < 0, F.lit("0:00")).otherwise(format_time(F.floor(sec).cast("long") * 1000))


def format_confidence(value) -> Column:
    """A 0-1 score as a percent with one decimal, e.g. ``84.7%``."""
    return F.format_string("%.1f%%", _c(value).cast("double") * F.lit(100.0))


def seconds_text(ms) -> Column:
    """Shortest decimal text of ms/1000, as a float prints: ``7.0``, ``7.25``, ``-0.075``.

    Built from integers; the JVM's double-to-string is not always shortest.
    """
    ms = _c(ms).cast("long")
    a = F.abs(ms)
    whole = (a / 1000).cast("long").cast("string")
    frac = F.regexp_replace(F.lpad(F.pmod(a, F.lit(1000)).cast("string"), 3, "0"), "0+$", "")
    frac = F.when(frac == "", F.lit("0")).otherwise(frac)
    sign = F.when(ms < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), frac)


def half_even_div(num, den) -> Column:
    """Round num/den to a whole number, ties to even, exactly in integers (den > 0)."""
    num, den = _c(num).cast("long"), _c(den).cast("long")
    q = F.floor(num / den).cast("long")  # exact for |num| < 2**53
    r = num - q * den
    up = (r * 2 > den) | ((r * 2 == den) & (F.pmod(q, F.lit(2)) == 1))
    return F.when(up, q + 1).otherwise(q)


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(ts, type_name: str = "timestamp") -> Column:
    """Epoch microseconds of a timestamp column, independent of the session time zone.

    A ``timestamp_ntz`` is read as UTC wall-clock time (as the stored values are);
    a ``timestamp`` is an instant already.
    """
    if type_name == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", _epoch_ntz(), _c(ts))
    return F.unix_micros(_c(ts))


def utc_wall_clock(us) -> Column:
    """UTC wall-clock ``timestamp_ntz`` of epoch microseconds (formatting it applies no zone)."""
    return F.timestamp_add("MICROSECOND", _c(us), _epoch_ntz())


def clock_text(us) -> Column:
    """``HH:MM:SS`` (UTC) of epoch microseconds."""
    return F.date_format(utc_wall_clock(us), "HH:mm:ss")


def iso_text(us) -> Column:
    """ISO-8601 UTC text of epoch microseconds, e.g. ``2024-01-01T00:00:07.179575+00:00``."""
    return F.concat(F.date_format(utc_wall_clock(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
