"""Operator 2: format-preserving pseudonyms of personal data, in DataFrame functions only.

Values are found by one pattern with a branch for each kind, validated, and permuted within their
own format by a keyed Feistel network, so equal values get equal pseudonyms in every document:

* payment card (13 to 19 digits in one run, in groups of four, or 4-6-5; Luhn digit right): all digits but
  the last are permuted, the last is set so that the Luhn check holds again;
* phone in North American form: numbers with area code and exchange from 200 to 999 are permuted among the
  6.4 * 10^9 such numbers, others of that form (which cannot be dialled but may still be meant) among the 3.6 * 10^9 others;
* IPv4 address (each part 0-255): the 32-bit number is permuted;
* date (YYYY-MM-DD, DD.MM.YYYY or MM/DD/YYYY, valid, 1900-2099): the day's number is permuted among
  the 73,049 days of those years;
* social security number ddd-dd-dddd (area not 000, 666 or 9dd, group not 00, serial not 0000): permuted among the
  888,931,098 such numbers;
* e-mail (local part of at most 64 characters): the local part is a keyed tag of 20 letters (80 bits), the domain's name
  becomes ``example`` (domains have no numeric format; equal addresses stay equal).

IBANs, IPv6 addresses and names are not searched for. The network works on a number below a*b split in two halves
(x div b, x mod b) with SHA-256 of key, kind, round and half; numbers outside a domain that isn't a*b walk the cycle until they
are inside. The chance that a value maps to itself is one in the size of its domain (1e-12 for cards, 1e-5 for dates). The key is
the caller's secret and has no default.

Defined cases: null text stays null, empty text stays empty; a text without values is returned as
it is; values that fail validation stay; extra columns pass through, whatever their names
(``pseudonymised``, ``pii_kinds`` and the counts replace columns of the same name). Every pattern's start is fixed and its repeats are
bounded or possessive, so very long unbroken texts take linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds' patterns, tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
PHONE = r"(?<!\w)(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w-])"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
ANY = "|".join((EMAIL, IPV4, PHONE, SSN, DATE, CARD))
QUICK = r"@|\d[\d.)( /-]{5}"
KINDS = ("email", "ipv4", "phone", "ssn", "date", "card")
ROUNDS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _round(key: Column, kind: str, i: int, half: Column) -> Column:
    """A number of 60 bits from SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), F.lit(str(i)), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: int, b: int, key: Column, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1. Each round adds to one half a function of the other."""
    state = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))

    def step(i: int, s: Column) -> Column:
        if i % 2 == 0:
            return F.struct(((s.l + _round(key, kind, i, s.r) % a) % a).alias("l"), s.r.alias("r"))
        return F.struct(s.l.alias("l"), ((s.r + _round(key, kind, i, s.l) % b) % b).alias("r"))

    for i in range(ROUNDS):
        state = _let(state, partial(step, i))
    return _let(state, lambda s: s.l * b + s.r)


def _div(x: Column, b: int) -> Column:
    """x div b, also beyond a double's 53 bits: the decimal quotient of an exact multiple."""
    return ((x - x % b).cast("decimal(20,0)") / F.lit(b).cast("decimal(20,0)")).cast("long")


def _walk(x: Column, size: int, permute: Callable[[Column], Column], walks: int = 12) -> Column:
    """Permute until the number is below ``size``. Every a*b here is ``size`` itself or, for dates, 0.2 %
    more, so the chance that 12 steps do not suffice is below 10^-30 (then the remainder is taken)."""
    done = lambda v: v < size
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), F.struct(x.alias("v"), F.lit(False).alias("ok")), lambda s, _: F.when(s.ok, s).otherwise(
        _let(permute(s.v), lambda v: F.struct(v.alias("v"), done(v).alias("ok")))), lambda s: F.when(s.ok, s.v).otherwise(F.pmod(s.v, F.lit(size))))
    return walked


def _digits(n: int, x: Column, key: Column, kind: str) -> Column:
    """Permute a decimal number of n digits; result with leading zeros."""
    a, b = 10 ** (n // 2), 10 ** (n - n // 2)
    return F.lpad(_walk(x, 10**n, lambda v: feistel(v, a, b, key, kind)).cast("string"), n, "0")


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _luhn_sum(digits: Column, last_single: bool) -> Column:
    """Luhn sum from the right; the rightmost digit counts once if ``last_single``, else doubled."""
    cells = F.reverse(F.split(digits, ""))
    shift = 1 if last_single else 0
    cost = F.transform(cells, lambda c, i: F.when((i + shift) % 2 == 0, _let(c.cast("int") * 2, lambda d: d - F.when(d > 9, 9).otherwise(0))).otherwise(c.cast("int")))
    return F.aggregate(cost, F.lit(0), lambda s, x: s + x)


def _refill(shape: Column, digits: Column) -> Column:
    """Put digits, from the left, in place of the digits of ``shape``."""
    folded = F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), lambda s, c: F.when(
        c.rlike(r"^\d$"), F.struct(F.concat(s.out, F.substring(digits, s.i, F.lit(1))).alias("out"), (s.i + 1).alias("i"))).otherwise(
        F.struct(F.concat(s.out, c).alias("out"), s.i.alias("i"))), lambda s: s.out)
    return folded


def _card(v: Column, key: Column) -> Column:
    def changed(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        number = body.cast("long")
        options = F.lit(None).cast("string")
        for n in range(13, 20):
            options = F.when(F.length(d) == n, _digits(n - 1, number, key, "card")).otherwise(options)
        return _let(options, lambda p: _refill(v, F.concat(p, ((F.lit(10) - _luhn_sum(p, False) % 10) % 10).cast("string"))))

    return _let(_only_digits(v), changed)


def _ipv4(v: Column, key: Column) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.expr("0L"), lambda s, p: s * 256 + p)
    moved = _walk(number, 2**32, lambda x: feistel(x, 65536, 65536, key, "ipv4"))
    return _let(moved, lambda m: F.concat_ws(".", *((F.shiftright(m, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0))))


def _at(d: Column, start: int, n: int) -> Column:
    return F.substring(d, start, n).cast("long")


def _padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _phone(v: Column, key: Column) -> Column:
    """The last ten digits move, valid numbers among valid ones and others among others; a +1 stays."""
    def changed(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        area, exchange, line = _at(ten, 1, 3), _at(ten, 4, 3), _at(ten, 7, 4)
        low = 2_000_000_000  # numbers of an area code below 200
        good = feistel(((area - 200) * 800 + (exchange - 200)) * 10_000 + line, 80_000, 80_000, key, "phone")
        bad = feistel(F.when(area < 200, (area * 1000 + exchange) * 10_000 + line).otherwise(((area - 200) * 200 + exchange) * 10_000 + line + low), 60_000, 60_000, key, "other phone")
        join = lambda a, e, m: F.concat(_padded(a, 3), _padded(e, 3), _padded(m % 10_000, 4))
        valid = lambda m: join(_div(m, 8_000_000) + 200, _div(m, 10_000) % 800 + 200, m)
        other = lambda m: F.when(m < low, join(_div(m, 10_000_000), _div(m, 10_000) % 1000, m)).otherwise(_let(m - low, lambda x: join(_div(x, 2_000_000) + 200, _div(x, 10_000) % 200, x)))
        return _refill(v, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.when((area >= 200) & (exchange >= 200), _let(good, valid)).otherwise(_let(bad, other))))

    return _let(_only_digits(v), changed)


def _ssn(v: Column, key: Column) -> Column:
    def changed(d: Column) -> Column:
        area = _at(d, 1, 3)
        number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + _at(d, 4, 2) - 1) * 9_999 + _at(d, 6, 4) - 1
        moved = feistel(number, 88_902, 9_999, key, "ssn")

        def digits(m: Column) -> Column:
            place = _div(m, 989_901) + 1
            return F.concat(_padded(place + F.when(place >= 666, 1).otherwise(0), 3), _padded(_div(m, 9_999) % 99 + 1, 2), _padded(m % 9_999 + 1, 4))

        return _refill(v, _let(moved, digits))

    return _let(_only_digits(v), changed)


FIRST_DAY, DAYS = "1900-01-01", 73_049


def _as_date(v: Column) -> Column:
    iso = F.when(v.contains("."), F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))).when(
        v.contains("/"), F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 1, 2), F.substring(v, 4, 2))).otherwise(v)
    return F.try_to_date(iso, "yyyy-MM-dd")


def _date(v: Column, key: Column) -> Column:
    number = F.datediff(_as_date(v), F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = _walk(number, DAYS, lambda x: feistel(x, 271, 270, key, "date"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int"))
    return F.when(v.contains("."), F.date_format(day, "dd.MM.yyyy")).when(v.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def _email(v: Column, key: Column) -> Column:
    tag = F.translate(F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(v)), 256), 1, 20), "0123456789", "ghijklmnop")
    return F.concat(tag, F.lit("@example."), F.element_at(F.split(v, r"\."), -1))


def kind_of(v: Column) -> Column:
    """The kind of a matched value if it is valid, else null."""
    digits = _only_digits(v)
    card = F.when(_luhn_sum(digits, True) % 10 == 0, F.lit("card"))
    date = F.when(_as_date(v).between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.lit("date"))
    area = F.substring(v, 1, 3)
    return (
        F.when(v.contains("@"), F.lit("email"))
        .when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(F.split(v, r"\."), lambda p: p.cast("int") <= 255), F.lit("ipv4")))
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~area.isin("000", "666") & ~area.startswith("9") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000"), F.lit("ssn")))
        .when(v.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), date)
        .when(F.length(digits) >= 13, card)
        .otherwise(F.lit("phone"))
    )


def _replacement(m: Column, key: Column) -> Column:
    v = m.v
    return (
        F.when(m.k == "email", _email(v, key)).when(m.k == "ipv4", _ipv4(v, key)).when(m.k == "phone", _phone(v, key))
        .when(m.k == "ssn", _ssn(v, key)).when(m.k == "date", _date(v, key)).when(m.k == "card", _card(v, key)).otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with ``pseudonymised`` (the text with every valid value replaced), one count for each
    kind (n_email ...) and ``pii_kinds``, the kinds in text order."""
    if not key:
        raise ValueError("a secret key is needed")
    secret = F.lit(key)
    names = docs.columns
    rows = docs.select(F.struct(*(docs[f"`{c}`"].alias(f"f{i}") for i, c in enumerate(names))).alias("row"))
    t = F.col(f"row.f{names.index(text)}")
    matches = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    found = F.when(t.rlike(QUICK), F.transform(matches, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))))
    none = F.array().cast("array<struct<v:string,k:string>>")
    out = rows.withColumn("found", F.coalesce(found, none))
    parts = F.split(t, ANY, -1)
    new = F.transform(F.col("found"), lambda m: _replacement(m, secret))
    glued = F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size("found")), new, lambda a, b: F.concat(a, b)), ""), F.element_at(parts, -1))
    out = out.withColumn("valid", F.transform(F.filter("found", lambda m: m.k.isNotNull()), lambda m: m.k))
    made = {"pseudonymised": F.when(F.size("valid") == 0, t).otherwise(glued), **{f"n_{k}": F.size(F.filter("valid", partial(_is, k))).cast("long") for k in KINDS}, "pii_kinds": F.array_join("valid", ",")}
    return out.select(*(F.col(f"row.f{i}").alias(c) for i, c in enumerate(names) if c not in made), *(v.alias(c) for c, v in made.items()))


def _is(kind: str, x: Column) -> Column:
    return x == kind


#: The key of the registered report, stated here as its results are compared from run to run; real keys come from the caller.
REPORT_KEY = "report"


def report(docs: DataFrame, key: str = REPORT_KEY) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"), key).drop("text")
