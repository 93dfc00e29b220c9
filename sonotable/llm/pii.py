r"""Format-preserving pseudonyms of personal values by keyed Feistel networks (DataFrame functions only).

Values are found by one pattern, validated, and permuted within their format, so equal
values get equal pseudonyms in every document and different ones stay different:

* card numbers (13-19 digits that pass the Luhn check): all but the first digit are
  permuted, the check digit is made to fit;
* phone numbers: the ten national digits; a country code and all punctuation stay;
* social security numbers with a valid area, group and serial: among all valid ones;
* IPv4 addresses: among all 2**32;
* calendar dates, year or day first: among the 73,170 days from 1900-01-01 on, the same
  day being the same pseudonym in either notation. ``dd/mm/yyyy`` and ``mm/dd/yyyy`` look
  alike: a value that can be read day first is; one that cannot (its day is above 12) is
  read month first, if of the years 1900 to 2099, and permuted among such dates alone, so
  that its pseudonym is read month first, too: days 13 to 28, the ends of months, and 29
  February each among themselves;
* e-mail addresses: runs of up to ten letters and digits of the local part, in lower case.
  Of addresses joined by a sign, each is one.

The network is unbalanced over a domain of a * b values: ``ROUNDS`` times, one half is
shifted by a keyed SHA-256 of the other, modulo its own size. Every round can be undone,
so the whole is a permutation of the domain, without cycle walking. ``reveal`` runs it
backwards. Numbers that fail their validation are left as they are, and so are phone
numbers of other shapes than 3-3-4 digits. The key is the caller's: who has it can undo
the pseudonyms.

Defined results: a null text stays null; an empty one stays empty; rows are mapped one by
one, so repeated rows and null ids need no rule; other columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonotable.llm.common import select_plain

ROUNDS = 10
EPOCH = "1900-01-01"
DAYS = (270, 271)  # 1900-01-01 to 2100-05-01

# Shapes of the values, tried in this order.
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# an address begins after another sign or where the last match ended; its domain is not the local part of the next
EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@(?:{DOMAIN}(?![A-Za-z0-9@])|{DOMAIN})"
DATE = r"(?<![0-9.\-/])(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![0-9\-/]|\.[0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"
VALUE = "|".join((EMAIL, DATE, IP, SSN, PHONE, CARD))
KINDS = ("email", "date", "ip", "ssn", "phone", "card")


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of non-negative longs, exact beyond 2**53."""
    return ((x - F.pmod(x, y)).cast("decimal(19,0)") / y.cast("decimal(19,0)")).cast("long")


def _shift(key: str, kind: Column, i: Column, half: Column) -> Column:
    """Keyed round function: 60 bits of a SHA-256."""
    said = F.concat_ws("|", F.lit(key), kind, i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a, b, key: str, kind: Column, backwards: bool = False) -> Column:
    """The image of ``value`` (0 <= value < a * b) under the keyed permutation of ``kind``, or the value of an image."""
    a, b = _long(a), _long(b)
    sign = F.lit(-1 if backwards else 1).cast("long")
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    rest = F.pmod(value, b)
    start = F.struct(_div(value, b).alias("l"), rest.alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(acc["l"] + sign * F.pmod(_shift(key, kind, i, acc["r"]), a), a)).otherwise(acc["l"])
        right = F.when(i % 2 == 1, F.pmod(acc["r"] + sign * F.pmod(_shift(key, kind, i, acc["l"]), b), b)).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(rounds, start, step, lambda acc: acc["l"] * b + acc["r"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _padded(x: Column, n: Column) -> Column:
    return F.call_function("lpad", x.cast("string"), n, F.lit("0"))


def _power(base: int, n: Column) -> Column:
    """base ** n for 0 <= n <= 10, exactly."""
    return F.element_at(F.array(*[F.lit(base ** k).cast("long") for k in range(11)]), n.cast("int") + 1)


def _decimal(digits: Column, key: str, kind: str, backwards: bool) -> Column:
    """A permutation of the digit strings of one length (2 to 18)."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    name = F.concat(F.lit(kind), n.cast("string"))
    return _padded(feistel(digits.cast("long"), _power(10, left), _power(10, n - left), key, name, backwards), n)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(acc["rest"], 1, 1)).otherwise(c)).alias("out"),
                        F.when(is_digit, acc["rest"].substr(F.lit(2), F.lit(99))).otherwise(acc["rest"]).alias("rest"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), digits.alias("rest")), step, lambda acc: acc["out"])


def _card(x: Column, key: str, back: bool) -> Column:
    d = _digits(x)
    n = F.length(d)
    body = F.concat(F.substring(d, 1, 1), _decimal(d.substr(F.lit(2), n - 2), key, "card", back))
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(body, c.cast("string"))))
    return _refill(x, F.concat(body, F.element_at(check, 1).cast("string")))


def _phone(x: Column, key: str, back: bool) -> Column:
    d = _digits(x)
    n = F.length(d)
    return _refill(x, F.concat(d.substr(F.lit(1), n - 10), _decimal(d.substr(n - 9, F.lit(10)), key, "phone", back)))


def _ssn(x: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.split(x, "-")[i].cast("long") for i in range(3))
    # areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999
    at = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    to = feistel(at, 898 * 11, 9 * 9999, key, F.lit("ssn"), back)
    area = _div(to, _long(99 * 9999)) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    group, serial = F.pmod(_div(to, _long(9999)), F.lit(99)) + 1, F.pmod(to, F.lit(9999)) + 1
    return F.concat_ws("-", _padded(area, F.lit(3)), _padded(group, F.lit(2)), _padded(serial, F.lit(4)))


def _ip(x: Column, key: str, back: bool) -> Column:
    at = F.aggregate(F.split(x, r"\."), _long(0), lambda acc, p: acc * 256 + p.cast("long"))
    to = feistel(at, 1 << 16, 1 << 16, key, F.lit("ip"), back)
    return F.concat_ws(".", *[F.pmod(F.shiftright(to, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def _day(x: Column) -> Column:
    iso = F.when(x.rlike("^[0-9]{4}"), F.regexp_replace(x, r"^(....).(..).(..)$", "$1-$2-$3")).otherwise(F.regexp_replace(x, r"^(..).(..).(....)$", "$3-$2-$1"))
    return F.datediff(F.call_function("try_to_date", iso, F.lit("yyyy-MM-dd")), F.lit(EPOCH).cast("date")).cast("long")


def _date(x: Column, key: str, back: bool) -> Column:
    day = F.date_add(F.lit(EPOCH).cast("date"), feistel(_day(x), *DAYS, key, F.lit("date"), back).cast("int"))
    return _refill(x, F.when(x.rlike("^[0-9]{4}"), F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "ddMMyyyy")))


# Days behind the 28th of the months other than February.
MONTH_ENDS = [f"{m:02d}{d}" for m in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) for d in (29, 30, 31) if d < 31 or m not in (4, 6, 9, 11)]


def _month_first(x: Column) -> Column:
    """Whether ``mm/dd/yyyy`` is a date of 1900 to 2099 whose day is above 12."""
    iso = F.regexp_replace(x, r"^(..).(..).(....)$", "$3-$1-$2")
    return (F.substring(x, 4, 2) > "12") & F.substring(x, 7, 4).between("1900", "2099") & F.call_function("try_to_date", iso, F.lit("yyyy-MM-dd")).isNotNull()


def _month_first_date(x: Column, key: str, back: bool) -> Column:
    d = _digits(x)
    month, day, year = (d.substr(a, n).cast("long") for a, n in ((1, 2), (3, 2), (5, 4)))
    two, four = (lambda c: _padded(c, F.lit(2))), (lambda c: c.cast("string"))
    mid = feistel(((year - 1900) * 12 + month - 1) * 16 + day - 13, 240, 160, key, F.lit("month-first-mid"), back)
    mid = F.concat(two(F.pmod(_div(mid, _long(16)), F.lit(12)) + 1), two(F.pmod(mid, F.lit(16)) + 13), four(_div(mid, _long(192)) + 1900))
    ends = F.array(*[F.lit(e) for e in MONTH_ENDS])
    n = len(MONTH_ENDS)
    end = feistel((year - 1900) * n + F.array_position(ends, F.substring(d, 1, 4)) - 1, 200, n, key, F.lit("month-first-end"), back)
    end = F.concat(F.element_at(ends, (F.pmod(end, F.lit(n)) + 1).cast("int")), four(_div(end, _long(n)) + 1900))
    leap = feistel(_div(year - 1904, _long(4)), 7, 7, key, F.lit("month-first-leap"), back)  # 1904 to 2096
    leap = F.concat(F.lit("0229"), four(leap * 4 + 1904))
    return _refill(x, F.when(day <= 28, mid).when(month == 2, leap).otherwise(end))


def _email(x: Column, key: str, back: bool) -> Column:
    local = F.lower(F.substring_index(x, "@", 1))
    runs, gaps = (F.regexp_extract_all(local, F.lit("([a-z0-9]{0,10})([^a-z0-9]*)"), F.lit(g)) for g in (1, 2))

    def run(r: Column) -> Column:
        n = F.length(r)
        left = F.floor(n / 2).cast("int")
        value = F.conv(r, 36, 10).cast("long")
        to = feistel(value, _power(36, left), _power(36, n - left), key, F.concat(F.lit("email"), n.cast("string")), back)
        return F.when(n == 0, r).otherwise(F.call_function("lpad", F.lower(F.conv(to.cast("string"), 10, 36)), n, F.lit("0")))

    return F.concat(F.array_join(F.zip_with(runs, gaps, lambda r, g: F.concat(run(r), g)), ""), x.substr(F.length(local) + 1, F.length(x)))


def _kind(x: Column) -> Column:
    """The kind of a found value, or null if it does not validate."""
    whole = lambda p: x.rlike(rf"^(?:{p})$")
    octets = F.forall(F.split(x, r"\."), lambda p: p.cast("int") <= 255)
    day = _day(x)
    area, group, serial = (F.split(x, "-")[i] for i in range(3))
    return (F.when(whole(EMAIL), "email")
            .when(whole(DATE), F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), "date").when(~x.rlike("^[0-9]{4}") & _month_first(x), "month_first"))
            .when(whole(IP), F.when(octets, "ip"))
            .when(whole(SSN), F.when(~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"), "ssn"))
            .when(whole(PHONE), "phone")
            .when(F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x)), "card"))


def _replaced(text: Column, key: str, backwards: bool) -> Column:
    """The matches of a text in order: the text before each, the value, its kind and its pseudonym."""
    found = F.lit(rf"\G(?s:(.*?))({VALUE})")
    gaps, values = (F.regexp_extract_all(text, found, F.lit(g)) for g in (1, 2))
    to = {"email": _email, "date": _date, "month_first": _month_first_date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}

    def one(gap: Column, x: Column) -> Column:
        kind = _kind(x)
        out = F.coalesce(*[F.when(kind == k, f(x, key, backwards)) for k, f in to.items()], x)
        kind = F.when(kind == "month_first", "date").otherwise(kind)
        return F.struct(gap.alias("gap"), x.alias("value"), kind.alias("kind"), out.alias("out"))

    return F.zip_with(gaps, values, one)


def pseudonymise(docs: DataFrame, key: str, backwards: bool = False) -> DataFrame:
    """doc_id, text with its personal values replaced, and the number of values of each kind (``n_<kind>``)."""
    text = F.col("text")
    none = F.array().cast("array<struct<gap:string,value:string,kind:string,out:string>>")
    rows = select_plain(docs, "doc_id", "text").withColumn(
        "found", F.when(text.rlike("[0-9@]"), _replaced(text, key, backwards)).otherwise(none))
    length = F.aggregate("found", F.lit(0), lambda n, m: n + F.length(m["gap"]) + F.length(m["value"]))
    body = F.array_join(F.transform("found", lambda m: F.concat(m["gap"], m["out"])), "")
    return rows.select("doc_id", F.when(F.size("found") == 0, text).otherwise(F.concat(body, text.substr(length + 1, F.length(text)))).alias("text"),
                       *[_count(k) for k in KINDS])


def _count(kind: str) -> Column:
    return F.coalesce(F.size(F.filter("found", lambda m: m["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")


def reveal(docs: DataFrame, key: str) -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key (local parts of addresses in lower case)."""
    return pseudonymise(docs, key, backwards=True)
