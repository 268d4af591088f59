"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated: card numbers by their check digit, addresses by
their octets, social security numbers by their numbering rules, dates by the calendar, telephone
numbers by the first digits of area and exchange (2 to 9 without a country code or with 1; else
the number doesn't begin with 0).  A keyed Feistel network permutes each value within its format, so the
pseudonym of a card has a right check digit, of a date is a date, and equal values get equal
pseudonyms in every document.  Letters and digits of the name in a mail address, and of
access tokens, are permuted likewise.  Numbers that fail validation stay as they are.

The network alternates x += f(y) and y += f(x) over two moduli whose product is exactly the
number of values of the format, so no value leaves it.  f is a SHA-256 of the key, the format,
the round and the other half.  Whoever has the key can invert the pseudonyms, so it has no default.
A date with slashes is read as day and month where that is a date, else as month and day; the
latter, whose day is over 12, are permuted among themselves, so no two dates share a pseudonym.

Null texts stay null; other texts without a value stay the same, byte for byte.  Only column
expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import let

ROUNDS = 8

MAIL = r"(?<![\w.+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}(?![\w\-])"
TOKEN = r"(?<=(?i:token|secret|passw(?:or)?d|api_?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[0-9A-Fa-f]{32,64}(?!\w)"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
DATE = r"(?<![\w/.\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w]|[/.\-]\d)"
SOCIAL = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?![\w]|-\d)|(?<![\w+])\+\d{1,3}[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w]|-\d)"
CARD = r"(?<![\w\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4})(?![\w]|-\d)"
KINDS = {"mail": MAIL, "token": TOKEN, "date": DATE, "social": SOCIAL, "address": ADDRESS, "phone": PHONE, "card": CARD}
#: Card numbers name a group, so they come last.
ANY = "|".join(KINDS.values())
#: No text without this holds a value.
MAYBE = r"@|\d{4}|\d\.\d|[0-9A-Fa-f]{32}"

#: Days from 1800-01-01 to 2199-12-31: one cycle of the Gregorian calendar, 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
WALK = 64


def feistel(value: Column, a: int | Column, b: int | Column, tweak: str | Column, key: str) -> Column:
    """A keyed permutation of the integers from 0 to a * b - 1."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def f(r: Column, other: Column, modulus: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long"), modulus)

    def turn(s: Column, r: Column) -> Column:
        x = F.when(r % 2 == 1, F.pmod(s["x"] + f(r, s["y"], a), a)).otherwise(s["x"])
        y = F.when(r % 2 == 1, s["y"]).otherwise(F.pmod(s["y"] + f(r, s["x"], b), b))
        return F.struct(x.alias("x"), y.alias("y"))

    start = let(value, lambda v: F.struct(_quotient(v, b).alias("x"), F.pmod(v, b).alias("y")))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda s: s["x"] * b + s["y"])


def _quotient(v: Column, b: Column) -> Column:
    """Whole quotient of two long columns, without a detour by doubles."""
    return F.call_function("floor", (v - F.pmod(v, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _decimal(d: Column, n: Column, tweak: str, key: str) -> Column:
    """A string of ``n`` digits, at most 18, permuted."""
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    return F.lpad(feistel(d.cast("long"), power(n - half), power(half), F.concat(F.lit(tweak), n.cast("string")), key).cast("string"), n, "0")


def _sum_of_luhn(d: Column, doubled: int) -> Column:
    """The check sum of a digit string; digits at odd distance (``doubled`` 1) or even distance (0) from the end count double."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def is_card(d: Column) -> Column:
    return _sum_of_luhn(d, 1) % 10 == 0


def _fill(shape: Column, d: Column) -> Column:
    """The digits of ``shape`` replaced by those of ``d`` in order, the rest as it is."""
    at = F.expr("0")
    out = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), at.alias("at")),
        lambda s, c: F.when(c.rlike(r"\d"), F.struct(F.concat(s["out"], F.substring(d, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return out["out"]


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = _decimal(F.substring(d, F.lit(1), F.length(d) - 1), F.length(d) - 1, "card", key)
        return let(body, lambda p: F.concat(p, F.pmod(10 - _sum_of_luhn(p, 0) % 10, F.lit(10)).cast("string")))

    return let(digits(m), lambda d: F.when(is_card(d), _fill(m, made(d))).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}[ .\-]?(?=\(?\d{3})", 0)

    def made(s: Column) -> Column:
        number = lambda at, n: F.substring(s["d"], at, n).cast("long")
        american = s["c"].rlike(r"^(\+1\D?)?$")
        value = ((number(1, 3) - 200) * 800 + (number(4, 3) - 200)) * 10_000 + number(7, 4)

        def shown(v: Column) -> Column:
            part = lambda x, n: F.lpad(x.cast("string"), n, "0")
            line, rest = F.pmod(v, F.lit(10_000)), _quotient(v, F.lit(10_000).cast("long"))
            return F.concat(part(_quotient(rest, F.lit(800).cast("long")) + 200, 3), part(F.pmod(rest, F.lit(800)) + 200, 3), part(line, 4))

        here = let(feistel(value, 80_000, 80_000, "phone", key), shown)
        abroad = (feistel(s["d"].cast("long") - 1_000_000_000, 90_000, 100_000, "phone abroad", key) + 1_000_000_000).cast("string")
        return (
            F.when(american & s["d"].rlike(r"^[2-9]\d\d[2-9]"), F.concat(s["c"], _fill(s["n"], here)))
            .when(~american & ~s["d"].startswith("0"), F.concat(s["c"], _fill(s["n"], abroad)))
            .otherwise(m)
        )

    split = let(country, lambda c: F.struct(c.alias("c"), F.substring(m, F.length(c) + 1, F.lit(64)).alias("n")))
    return let(split, lambda s: let(F.struct(s["c"].alias("c"), s["n"].alias("n"), digits(s["n"]).alias("d")), made))


def _address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))

    def made(o: Column) -> Column:
        number = F.aggregate(o, F.expr("0L"), lambda a, x: a * 256 + x)
        return let(feistel(number, 65536, 65536, "address", key), lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]))

    return let(octets, lambda o: F.when(F.array_max(o) <= 255, made(o)).otherwise(m))


def _social(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""

    def made(s: Column) -> Column:
        area = s[0] - 1 - F.when(s[0] > 666, 1).otherwise(0)
        value = (area * 99 + (s[1] - 1)) * 9999 + (s[2] - 1)

        def shown(v: Column) -> Column:
            top = _quotient(v, F.lit(99 * 9999).cast("long")) + 1
            middle = _quotient(F.pmod(v, F.lit(99 * 9999)), F.lit(9999).cast("long")) + 1
            return F.concat_ws("-", F.lpad((top + F.when(top >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad(middle.cast("string"), 2, "0"), F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))

        return let(feistel(value, 898, 99 * 9999, "social", key), shown)

    parts = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    return let(parts, lambda s: F.when(s[0].between(1, 899) & (s[0] != 666) & (s[1] > 0) & (s[2] > 0), made(s)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    day_of = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def late(n: Column) -> Column:
        """A permutation of the days after the 12th of a month: on until it comes to one; that it takes ``WALK`` steps has a chance of 1e-25."""
        step = lambda n: feistel(n, *DAYS, "month and day", key)
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(n), lambda s, _: F.when(F.day(day_of(s)) > 12, s).otherwise(step(s)))

    def by(pattern: str, otherwise: Column) -> Column:
        day = F.try_to_timestamp(m, F.lit(pattern)).cast("date")

        def made(d: Column) -> Column:
            n = F.date_diff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
            moved = late(n) if pattern == "MM/dd/yyyy" else feistel(n, *DAYS, "date", key)
            return F.when(F.year(d).between(1800, 2199), F.date_format(day_of(moved), pattern)).otherwise(m)

        return let(day, lambda d: F.when(d.isNotNull(), made(d)).otherwise(otherwise))

    dotted, slashed = by("dd.MM.yyyy", m), by("dd/MM/yyyy", by("MM/dd/yyyy", m))
    return F.when(m.rlike("^....-"), by("yyyy-MM-dd", m)).when(m.rlike("^..../"), by("yyyy/MM/dd", m)).when(m.contains("."), dotted).otherwise(slashed)


def _alphabet(text: Column, base: int, block: int, tweak: Column, key: str) -> Column:
    """A string over the first ``base`` digits (0-9, a-z), permuted block by block within its length."""

    def one(part: Column, at: Column) -> Column:
        n = F.length(part)
        half = F.floor(n / 2).cast("int")
        power = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.expr("1L"), lambda a, i: F.when(i == 0, a).otherwise(a * base))
        moved = feistel(F.conv(part, base, 10).cast("long"), power(n - half), power(half), F.concat(tweak, F.lit("|"), at.cast("string"), F.lit("|"), n.cast("string")), key)
        return F.lpad(F.lower(F.conv(moved.cast("string"), 10, base)), n, "0")

    starts = F.sequence(F.lit(1), F.length(text), F.lit(block))
    return F.array_join(F.transform(starts, lambda i: let(F.substring(text, i, F.lit(block)), lambda part: one(part, i))), "")


def _token(m: Column, key: str) -> Column:
    made = _alphabet(F.lower(m), 16, 12, F.lit("token"), key)
    return F.when(m == F.upper(m), F.upper(made)).otherwise(made)


def _mail(m: Column, key: str) -> Column:
    """The letters and digits of the name are permuted, its punctuation and the domain stay."""

    def refilled(name: Column, plain: Column) -> Column:
        step = lambda s, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(s["out"], F.substring(plain, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
        return F.aggregate(F.split(name, ""), F.struct(F.lit("").alias("out"), F.expr("0").alias("at")), step)["out"]

    def made(s: Column) -> Column:
        plain = F.regexp_replace(F.lower(s["name"]), "[^a-z0-9]", "")
        moved = F.when(F.length(plain) > 0, _alphabet(plain, 36, 10, F.concat(F.lit("mail|"), F.lower(s["domain"])), key)).otherwise(plain)
        return F.concat(let(moved, lambda p: refilled(s["name"], p)), F.lit("@"), s["domain"])

    return let(F.struct(F.substring_index(m, "@", 1).alias("name"), F.substring_index(m, "@", -1).alias("domain")), made)


def kind_of(m: Column) -> Column:
    """The kind of a value that the patterns found."""
    return (
        F.when(m.contains("@"), "mail")
        .when(m.rlike("^[0-9A-Fa-f]{32,64}$"), "token")
        .when(m.rlike(f"^(?:{DATE})$"), "date")
        .when(m.rlike(f"^(?:{SOCIAL})$"), "social")
        .when(m.rlike(f"^(?:{ADDRESS})$"), "address")
        .when(m.rlike(r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4})$"), "card")
        .otherwise("phone")
    )


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one value, or the value itself where it isn't valid."""
    made = {"mail": _mail, "token": _token, "date": _date, "social": _social, "address": _address, "card": _card}

    def chosen(kind: Column) -> Column:
        out = _phone(m, key)
        for name, make in made.items():
            out = F.when(kind == name, make(m, key)).otherwise(out)
        return out

    return let(kind_of(m), chosen)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the values in its texts replaced by pseudonyms; ``count`` names a column for how many changed."""
    text = F.col(text_col)

    def done(found: Column) -> Column:
        return F.transform(found, lambda m: pseudonym(m, key))

    found = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("__found", found)
    out = out.withColumn("__made", F.when(F.size("__found") > 0, done(F.col("__found"))).otherwise(F.array().cast("array<string>")))
    pieces = F.zip_with(F.split(text, ANY), "__made", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = out.withColumn(text_col, F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(text))
    if count:
        out = out.withColumn(count, F.coalesce(F.size(F.filter(F.arrays_zip("__found", "__made"), lambda z: z["__found"] != z["__made"])), F.lit(0)).cast("long"))
    return out.drop("__found", "__made")
