"""Pseudonyms that keep their format, by a keyed Feistel network, built from DataFrame functions only.

Found and validated: e-mail addresses, phone numbers, IPv4 addresses (octets to 255), payment cards
(13 to 19 digits with a Luhn check digit), US social security numbers (assigned ranges), IBANs (mod
97), dates (in the calendar, 1800 to 2199) and hex secrets of 32 to 64 digits.  What looks like one
of these and isn't valid stays as it is.

A value becomes a vector of small numbers, each with its radix: a digit has 10, a letter 26 of its
case, an octet 256, a date is a day of the 400-year calendar cycle (189 x 773), and so on.  The
vector's halves are shifted in turn by a keyed function of the other half.  This permutes the
vectors of each shape, so that equal values stay equal, different ones stay different, the format
stays and ``restore`` with the same key gives the text back.  Check digits are computed anew.

The keyed function is an HMAC-SHA256.  The key comes from a one-row table that the plan names but
doesn't show: it is no literal of the query, so neither plans nor event logs hold it.

An e-mail address keeps its domain, a phone number its country code, separators stay.

Defined results: a null text stays null; an empty text stays empty; texts without finds are returned
unchanged; repeated rows get the same pseudonyms; empty tables give empty results; further columns
are passed on, less any that are named like a count; texts may have any length.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import bind, fresh

#: The usual groupings of card numbers, tried before any other, so that digits beside one don't hide it.
_GROUPED = r"(?:\d{4} ){3}\d{4}|(?:\d{4}-){3}\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19}"
#: What a candidate of each kind looks like, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": rf"(?<!\d)(?:{_GROUPED})(?!\d)|(?<!\d)(?!\d{{1,6}}[ -](?:{_GROUPED})(?!\d))\d(?:[ -]?\d){{12,18}}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must have to be searched at all: each kind has one of these.
HINT = r"[@]|\d[\d ./()-]{6}|[0-9a-fA-F]{32}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}"
KINDS = list(PATTERNS)
ROUNDS = 8
#: A day of the 400-year cycle that 1800-01-01 begins is a pair of these radices: 189 * 773 = 146097 days.
_DAYS = (189, 773)
_EPOCH = "1800-01-01"


def _permute(values: Column, radices: Column, kind: str, key: Column, inverse: bool) -> Column:
    """The vector after all rounds; odd rounds shift the first half by the second, even ones the second by the first."""
    half = F.floor(F.size(radices) / 2).cast("int")
    order = list(range(1, ROUNDS + 1))
    rounds = F.array(*[F.lit(r) for r in (order[::-1] if inverse else order)])
    sign = -1 if inverse else 1

    def one(x: Column, r: Column) -> Column:
        odd = r % 2 == 1
        other = F.when(odd, F.slice(x, half + 1, F.size(x))).otherwise(F.slice(x, 1, half))
        message = F.concat_ws("|", F.lit(kind), r.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
        seed = F.sha2(F.concat(key["outer"], F.unhex(F.sha2(F.concat(key["inner"], message.cast("binary")), 256))), 256)
        return bind(
            seed,
            lambda s: F.transform(
                x, lambda v, j: F.when((j < half) == odd, F.pmod(v + sign * F.pmod(F.xxhash64(s, j), F.get(radices, j)).cast("int"), F.get(radices, j))).otherwise(v)
            ),
        )

    return F.aggregate(rounds, values, one)


def _int(c: Column) -> Column:
    return c.cast("int")


def _letters(value: Column, kind: str, key: Column, inverse: bool, hexadecimal: bool = False) -> Column:
    """The string with digits, and letters of each case, permuted in place."""
    size = 6 if hexadecimal else 26
    code = lambda c: F.ascii(c)
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("A", "Z"), 65).when(c.between("a", "z"), 97)
    radix = lambda c: F.when(c.between("0", "9"), 10).when(c.between("A", "Z") | c.between("a", "z"), size).otherwise(1)

    def spelled(chars: Column) -> Column:
        values = F.transform(chars, lambda c: F.coalesce(code(c) - base(c), F.lit(0)))
        radices = F.transform(chars, radix)
        moved = _permute(values, radices, kind, key, inverse)
        return bind(moved, lambda y: F.array_join(F.transform(chars, lambda c, j: F.coalesce(F.char(F.get(y, j) + base(c)), c)), ""))

    return F.when(F.length(value) == 0, value).otherwise(bind(F.split(value, ""), spelled))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, each second one doubled from the given place (0: the last) on."""
    worth = lambda d, i: F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(F.reverse(F.transform(F.split(digits, ""), _int)), worth), F.lit(0), lambda a, b: a + b)


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _is_card(value: Column) -> Column:
    return _luhn_sum(_plain(value), 1) % 10 == 0


def _card(value: Column, key: Column, inverse: bool) -> Column:
    """All but the check digit is permuted; the check digit follows from it."""
    moved = _letters(F.substring(value, F.lit(1), F.length(value) - 1), "card", key, inverse)
    return bind(moved, lambda m: F.concat(m, F.pmod(-_luhn_sum(_plain(m), 0), F.lit(10)).cast("string")))


def _mod97(text: Column) -> Column:
    """The rest by 97 of the number that an IBAN's rearranged letters and digits spell, spaces apart."""
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), F.lit(0), step)


def _is_iban(value: Column) -> Column:
    return _mod97(F.concat(F.substring(value, 5, 50), F.substring(value, 1, 4))) == 1


def _iban(value: Column, key: Column, inverse: bool) -> Column:
    moved = _letters(F.substring(value, 5, 50), "iban", key, inverse)
    country = F.substring(value, 1, 2)
    return bind(moved, lambda m: F.concat(country, F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), _int)


def _ip(value: Column, key: Column, inverse: bool) -> Column:
    moved = _permute(_octets(value), F.array(*[F.lit(256)] * 4), "ip", key, inverse)
    return F.array_join(F.transform(moved, lambda o: o.cast("string")), ".")


def _phone(value: Column, key: Column, inverse: bool) -> Column:
    """The country code, up to the first separator after a plus sign, stays."""
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-]))?", 1)
    return F.concat(code, _letters(F.substring(value, F.length(code) + 1, F.length(value)), "phone", key, inverse))


def _date_parts(value: Column) -> tuple[Column, Column]:
    """The date, and the pattern that writes it alike: year first; else month first if that is a date; else day first."""
    iso = F.substring(value, 5, 1) == "-"
    patterns = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"]
    dates = [F.when(iso if p == patterns[0] else ~iso, F.try_to_date(value, p)) for p in patterns]
    which = F.when(dates[0].isNotNull(), patterns[0]).when(dates[1].isNotNull(), patterns[1]).when(dates[2].isNotNull(), patterns[2])
    return F.coalesce(*dates), which


def _day(value: Column) -> Column:
    return F.datediff(_date_parts(value)[0], F.lit(_EPOCH).cast("date"))


def _date(value: Column, key: Column, inverse: bool) -> Column:
    """The date moved within the calendar; one that can only be read day first stays such a date."""
    day, pattern = _day(value), _date_parts(value)[1]
    a, b = _DAYS
    moved = _permute(F.array(_int(F.floor(day / b)), _int(day % b)), F.array(F.lit(a), F.lit(b)), "date", key, inverse)
    new = bind(moved, lambda y: F.date_add(F.lit(_EPOCH).cast("date"), F.get(y, 0) * b + F.get(y, 1)))
    # day first: the day stays if few months have it, and 29 February moves among leap years
    year, month, dom = (part(_date_parts(value)[0]) for part in (F.year, F.month, F.dayofmonth))

    def moves(years: list[int], months: list[int], days: list[int]) -> Column:
        lists = [F.array(*[F.lit(x) for x in xs]) for xs in (years, months, days)]
        places = F.array(*[_int(F.array_position(xs, x)) - 1 for xs, x in zip(lists, (year, month, dom))])
        late = _permute(places, F.array(*[F.lit(len(xs)) for xs in (years, months, days)]), "late date", key, inverse)
        return bind(late, lambda x: F.format_string("%02d/%02d/%04d", F.get(lists[2], F.get(x, 2)), F.get(lists[1], F.get(x, 1)), F.get(lists[0], F.get(x, 0))))

    years, leap = list(range(1800, 2200)), [y for y in range(1800, 2200) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
    late = F.when(dom < 29, moves(years, list(range(1, 13)), list(range(13, 29)))).when((month == 2) & (dom == 29), moves(leap, [2], [29]))
    for d, months in ((29, [1, *range(3, 13)]), (30, [1, *range(3, 13)]), (31, [1, 3, 5, 7, 8, 10, 12])):
        late = late.when(dom == d, moves(years, months, [d]))
    first = F.when(pattern == "yyyy-MM-dd", F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "MM/dd/yyyy"))
    return F.when(pattern != "dd/MM/yyyy", first).otherwise(late)


def _ssn_parts(value: Column) -> list[Column]:
    return [_int(x) for x in (F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4))]


def _is_ssn(value: Column) -> Column:
    area, group, serial = _ssn_parts(value)
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def _ssn(value: Column, key: Column, inverse: bool) -> Column:
    area, group, serial = _ssn_parts(value)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    moved = _permute(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, inverse)
    whole = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
    return bind(moved, lambda x: F.format_string("%03d-%02d-%04d", whole(F.get(x, 0)), F.get(x, 1) + 1, F.get(x, 2) + 1))


def _kind(value: Column) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    is_ = {name: value.rlike(f"^(?:{p})$") for name, p in PATTERNS.items()}
    octets_fit = F.forall(_octets(value), lambda o: o < 256)
    in_range = F.coalesce(_day(value).between(0, 189 * 773 - 1), F.lit(False))
    return (
        F.when(is_["email"], "email")
        .when(is_["iban"] & _is_iban(value), "iban")
        .when(is_["secret"], "secret")
        .when(is_["ip"], F.when(octets_fit, "ip"))
        .when(is_["phone"], "phone")
        .when(is_["date"], F.when(in_range, "date"))
        .when(is_["ssn"], F.when(_is_ssn(value), "ssn"))
        .when(is_["card"], F.when(_is_card(value), "card"))
    )


def _pseudonym(value: Column, kind: Column, key: Column, inverse: bool) -> Column:
    at = F.locate("@", value)
    email = F.concat(_letters(F.substring(value, F.lit(1), at - 1), "email", key, inverse), F.substring(value, at, F.length(value)))
    return (
        F.when(kind == "email", email)
        .when(kind == "iban", _iban(value, key, inverse))
        .when(kind == "secret", _letters(value, "secret", key, inverse, hexadecimal=True))
        .when(kind == "ip", _ip(value, key, inverse))
        .when(kind == "phone", _phone(value, key, inverse))
        .when(kind == "date", _date(value, key, inverse))
        .when(kind == "ssn", _ssn(value, key, inverse))
        .when(kind == "card", _card(value, key, inverse))
        .otherwise(value)
    )


def _key_table(spark: SparkSession, key: str) -> DataFrame:
    """One row with the two padded keys of HMAC-SHA256."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pads = tuple(bytearray(x ^ pad for x in block) for pad in (0x36, 0x5C))
    return spark.createDataFrame([(pads,)], "secret struct<inner:binary,outer:binary>")


def pseudonymize(df: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """``df`` with ``text`` rewritten, and a long column ``n_<kind>`` for each kind with the number of finds."""
    counts = [f"n_{k}" for k in KINDS]
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in counts or c == text])
    names = [c for c in plain.columns if c != text]
    result, held = fresh(plain, "pii_result"), fresh(plain, "pii_secret")
    # the key stands beside the text as a column, since no subquery may be asked inside a function of arrays
    keyed = plain.withColumn(held, _key_table(df.sparkSession, key).select("secret").scalar())
    whole, secret = F.col(f"`{text}`"), F.col(held)

    def rewritten(found: Column) -> Column:
        told = F.transform(found, lambda v: bind(_kind(v), lambda k: F.struct(k.alias("kind"), _pseudonym(v, k, secret, inverse).alias("new"))))
        gaps = F.split(whole, ANY)
        return bind(
            told,
            lambda t: F.struct(
                F.array_join(F.flatten(F.zip_with(gaps, t, lambda g, x: F.array(g, F.coalesce(x["new"], F.lit(""))))), "").alias("text"),
                F.transform(t, lambda x: x["kind"]).alias("kinds"),
            ),
        )

    unchanged = F.struct(whole.alias("text"), F.array().cast("array<string>").alias("kinds"))
    done = F.when(whole.rlike(HINT), bind(F.regexp_extract_all(whole, F.lit(f"({ANY})"), 1), lambda m: F.when(F.size(m) > 0, rewritten(m)).otherwise(unchanged))).otherwise(unchanged)
    out = keyed.select(*[F.col(f"`{c}`") for c in names], done.alias(result))
    found = lambda k: F.size(F.filter(f"{result}.kinds", lambda x: x == F.lit(k)))
    kinds = [found(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(*[F.col(f"{result}.text").alias(c) if c == text else F.col(f"`{c}`") for c in plain.columns], *kinds)


def restore(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The inverse of ``pseudonymize`` with the same key."""
    return pseudonymize(df, key, text, inverse=True)
