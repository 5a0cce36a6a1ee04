"""Format-preserving pseudonyms for personal data, with SQL functions only.

Numbers and dates that pass validation (check digit, calendar, ranges) are
permuted within their format by a keyed Feistel network: the same value has the
same pseudonym in every document, two values never share one, and the key's
owner can undo it. Mail addresses and secret tokens, which are no numbers, get a
keyed digest of their own form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8
#: Ranges of dates, each permuted in itself: the first day, and two numbers whose product is the number of days.
#: Together they are all days of the years 1000 to 9999; those of 1900-01-01 to 2100-05-01 stay among themselves.
DATE_RANGES = [("1000-01-01", 538, 611), ("1900-01-01", 270, 271), ("2100-05-02", 538, 5363)]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# What each kind looks like, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-@])[\p{L}\p{N}._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+1[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}|\+[1-9][0-9]{0,2}(?:[ .\-][0-9]{2,4}){2,4}|\+[1-9][0-9]{6,14}|[0-9]{3} [0-9]{3} [0-9]{4}|(?:1[.\-])?[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    # the usual groups first, so that a short number beside them is left out
    "card": r"(?<![0-9])(?:[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|(?!(?:[0-9]{1,6}[ \-]){1,3}[0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9]))[0-9](?:[ \-]?[0-9]){12,18})(?![0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,}|AKIA[0-9A-Z]{16}|sk-[0-9A-Za-z_\-]{20,}|gh[pousr]_[0-9A-Za-z]{36,})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: an array of one element names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _noise(key: str, tweak: Column, r: Column, half: Column, side: Column) -> Column:
    """A keyed number below `side` from one half."""
    h = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % side


def feistel(a: Column, b: Column, a_side: Column, b_side: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """The keyed permutation of the pairs (a, b) below (a_side, b_side), or its inverse, as a struct."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = F.lit(-1 if inverse else 1)

    def turn(s: Column, r: Column) -> Column:
        return F.when(
            r % 2 == 0,
            F.struct(F.pmod(s["a"] + sign * _noise(key, tweak, r, s["b"], a_side), a_side).alias("a"), s["b"].alias("b")),
        ).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * _noise(key, tweak, r, s["a"], b_side), b_side).alias("b")))

    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def digits(d: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """The permutation of the digit strings of d's length, 2 to 18 digits, taken in two halves."""
    n = F.length(d)
    high = F.ceil(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    tweak = F.concat_ws("/", F.lit(kind), n.cast("string"))
    both = feistel(F.substring(d, F.lit(1), high), F.substring(d, high + 1, n), ten(high), ten(n - high), key, tweak, inverse)
    return _let(both, lambda x: F.concat(F.lpad(x["a"].cast("string"), high, F.lit("0")), F.lpad(x["b"].cast("string"), n - high, F.lit("0"))))


def luhn(body: Column) -> Column:
    """The check digit that follows a string of digits."""
    n = F.length(body)
    at = lambda i: F.substring(body, n - i + 1, F.lit(1)).cast("int")
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(at(i))).otherwise(at(i)))
    return ((10 - total % 10) % 10).cast("string")


def _refill(m: Column, new: Column) -> Column:
    """m with its digits replaced, in order, by those of `new`."""
    char = lambda i: F.substring(m, i, F.lit(1))
    place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9]", ""))
    put = lambda d: lambda i: F.when(char(i).rlike("[0-9]"), F.substring(d, place(i), F.lit(1))).otherwise(char(i))
    return _let(new, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), put(d)), ""))


def _card(m: Column, key: str, inverse: bool) -> Column:
    def renew(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = (luhn(body) == F.right(d, F.lit(1))) & ~d.rlike(r"^(.)\1*$")
        return F.when(valid, _let(digits(body, key, "card", inverse), lambda x: _refill(m, F.concat(x, luhn(x)))))

    return _let(F.regexp_replace(m, "[^0-9]", ""), renew)


def _mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and letters, of which A is 10 and Z is 35."""
    add = lambda n, c: F.when(c.rlike("[0-9]"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.regexp_extract_all(s, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), add)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """The account's digits, letters as they are, and the check digits that belong to them."""
    rest = lambda x: F.substring(x, F.lit(5), F.length(x))
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = _mod97(F.concat(rest(plain(m)), F.substring(m, 1, 4))) == 1

    def renew(d: Column) -> Column:
        checked = lambda x: F.lpad((98 - _mod97(F.concat(rest(plain(_refill(m, F.concat(F.lit("00"), x)))), F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        new = _let(digits(d, key, "iban", inverse), lambda x: _refill(m, F.concat(checked(x), x)))
        return F.when(valid & (F.length(d) >= 2), new)

    return _let(F.regexp_replace(rest(m), "[^0-9]", ""), renew)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """The digits after the first of an international number, else all."""
    kept = F.when(m.startswith("+"), 1).otherwise(0)

    def renew(d: Column) -> Column:
        return _refill(m, F.concat(F.substring(d, F.lit(1), kept), _let(F.substring(d, kept + 1, F.length(d)), lambda x: digits(x, key, "phone", inverse))))

    return _let(F.regexp_replace(m, "[^0-9]", ""), renew)


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    """Each of the three groups keeps to its valid range: 898 areas (without 666), 99 and 9,999 numbers."""
    area, group, serial = (F.substring(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    both = feistel(area, (group - 1) * 9_999 + serial - 1, F.lit(898), F.lit(99 * 9_999), key, F.lit("ssn"), inverse)
    out = lambda x: x["a"] + 1 + F.when(x["a"] + 1 >= 666, 1).otherwise(0)
    return _let(both, lambda x: F.format_string("%03d-%02d-%04d", out(x), F.floor(x["b"] / 9_999).cast("long") + 1, x["b"] % 9_999 + 1))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    o = F.split(m, r"\.")
    half = lambda i: F.get(o, F.lit(i)).cast("long") * 256 + F.get(o, F.lit(i + 1)).cast("long")
    both = feistel(half(0), half(2), F.lit(65_536), F.lit(65_536), key, F.lit("ip"), inverse)
    return _let(both, lambda x: F.concat_ws(".", *[(F.shiftright(x[k], n) % 256).cast("string") for k, n in (("a", 8), ("a", 0), ("b", 8), ("b", 0))]))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Year-first dates, else day-month-year, else month-day-year, which comes out day first; two places each if both had them."""
    mark = F.regexp_extract(m, "[./-]", 0)
    part = F.split(m, "[./-]")
    p = [F.get(part, F.lit(i)) for i in range(3)]
    year_first = F.length(p[0]) == 4
    month_first = ~year_first & (p[1].cast("int") > 12)
    year, month, day = F.when(year_first, p[0]).otherwise(p[2]), F.when(month_first, p[0]).otherwise(p[1]), F.when(year_first, p[2]).when(month_first, p[1]).otherwise(p[0])
    days = F.datediff(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date"), F.lit(DATE_RANGES[0][0]).cast("date")).cast("long")
    starts, upto = [], 0
    for _, x, y in DATE_RANGES:
        starts.append(upto)
        upto += x * y
    full = (F.length(month) == 2) & (F.length(day) == 2)

    def written(new: Column) -> Column:
        m2, d2 = (F.when(full, F.date_format(new, f * 2)).otherwise(F.date_format(new, f)) for f in "Md")
        y2 = F.date_format(new, "yyyy")
        ymd = F.when(year_first, F.concat_ws("-", y2, m2, d2)).otherwise(F.concat_ws("-", d2, m2, y2))
        return F.regexp_replace(ymd, "-", mark)

    def renew(n: Column) -> Column:
        of = F.lit(None)
        for at, (day, x, y) in zip(starts, DATE_RANGES):
            of = F.when(n >= at, F.struct(F.lit(day).cast("date").alias("day"), (n - at).alias("n"), F.lit(x).alias("x"), F.lit(y).alias("y"))) if at == 0 else F.when(
                n >= at, F.struct(F.lit(day).cast("date").alias("day"), (n - at).alias("n"), F.lit(x).alias("x"), F.lit(y).alias("y"))
            ).otherwise(of)

        def move(r: Column) -> Column:
            both = feistel(F.floor(r["n"] / r["y"]), r["n"] % r["y"], r["x"], r["y"], key, F.lit("date"), inverse)
            return _let(both, lambda x: F.date_add(r["day"], (x["a"] * r["y"] + x["b"]).cast("int")))

        return F.when((n >= 0) & (n < upto), _let(_let(of, move), written))

    return _let(days, renew)


def _email(m: Column, key: str) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("user"), F.substring(h, 1, 16), F.lit("@mail"), F.substring(h, 17, 4), F.lit(".invalid"))


def _secret(m: Column, key: str) -> Column:
    """A digest of the secret's length, after the mark that names its issuer."""
    h = lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), k.cast("string"), F.lower(m)), 256)
    mark = F.regexp_extract(m, "^(?:AKIA|sk-|gh[pousr]_)", 0)
    long = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(m) / 64).cast("int")), h), "")
    new = F.substring(long, F.lit(1), F.length(m) - F.length(mark))
    return F.concat(mark, F.when(m == F.upper(m), F.upper(new)).otherwise(new))


def kind_of(m: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in PATTERNS.items():
        out = out.when(m.rlike(f"^(?:{pattern})$"), kind)
    return out


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a found value; the value itself if it fails validation."""
    return _let(kind_of(m), lambda kind: _renewed(m, kind, key, inverse))


def _renewed(m: Column, kind: Column, key: str, inverse: bool) -> Column:
    new = (
        F.when(kind == "email", m if inverse else _email(m, key))
        .when(kind == "ip", _ip(m, key, inverse))
        .when(kind == "date", _date(m, key, inverse))
        .when(kind == "ssn", _ssn(m, key, inverse))
        .when(kind == "iban", _iban(m, key, inverse))
        .when(kind == "phone", _phone(m, key, inverse))
        .when(kind == "card", _card(m, key, inverse))
        .when(kind == "secret", m if inverse else _secret(m, key))
    )
    return F.coalesce(new, m)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None, inverse: bool = False) -> DataFrame:
    """docs with the values in its texts replaced, all other columns as they are.

    found_col, if given, names a new column: an array of (kind, pseudonym) of
    the values that were replaced, in the text's order. inverse undoes numbers
    and dates (mail addresses and secrets stay). A null text stays null, and is
    found to hold nothing; a text without values is unchanged, to the byte. No
    shuffle: each row is worked on alone, and long texts in one pass. Equal rows
    give equal rows; an empty table gives none; other columns may have any name
    but found_col, whose place it would take. Who has the key can undo the
    pseudonyms, so there is no default for it.
    """
    held = unused(docs, "__found")
    text = F.col(text_col)
    none = F.array().cast("array<struct<value:string,kind:string,pseudonym:string>>")
    values = F.when(text.rlike("[0-9@]|[0-9A-Fa-f]{32}|AKIA|sk-|gh[pousr]_"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))

    def renewed(m: Column) -> Column:
        return _let(kind_of(m), lambda kind: F.struct(m.alias("value"), kind.alias("kind"), _renewed(m, kind, key, inverse).alias("pseudonym")))

    # worked out once a row, as what follows reads it more than once
    rows = docs.withColumn(held, F.coalesce(F.transform(values, renewed), none))
    pieces = F.zip_with(F.split(text, ANY, -1), held, lambda a, x: F.concat(a, F.coalesce(x["pseudonym"], F.lit(""))))
    new = F.when(F.size(held) > 0, F.array_join(pieces, "")).otherwise(text)
    out = {c: F.col(c) for c in docs.columns} | {text_col: new}
    if found_col:
        changed = F.filter(held, lambda x: x["value"] != x["pseudonym"])
        out[found_col] = F.transform(changed, lambda x: F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym")))
    return rows.select(*[x.alias(c) for c, x in out.items()])
