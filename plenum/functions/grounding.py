"""Whether one text says what another does: numbers, amounts and dates in normal form, contained in the other's; translations that keep them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of numbers, how they are spelled alike, sizes of amounts, patterns of values, and English that a translation left.
UNITS = (
    r"(?:(?:rentable|gross|net|usable|linear)\s+)?(?:sq\.?\s*ft\.?|square\s+(?:feet|foot)|sq\.?\s*mi\.?|square\s+miles?|feet|foot|ft\.?|miles?|mi\.?|acres?|ac\.?|homes?|units?|properties|parcels?|lots?|people|persons?|"
    r"residents?|jobs?|trees?|spaces?|stalls?|vehicles?|lanes?|bedrooms?|seats?|gallons?|years?|months?|weeks?|days?|hours?|minutes?)"
)
SAME_UNIT = {
    "foot": "foot", "feet": "foot", "ft": "foot", "sq ft": "square-foot", "square foot": "square-foot", "square feet": "square-foot", "sf": "square-foot", "mile": "mile", "miles": "mile", "mi": "mile",
    "sq mi": "square-mile", "square mile": "square-mile", "square miles": "square-mile", "acre": "acre", "acres": "acre", "ac": "acre",
}
SIZES = {"thousand": 1_000, "k": 1_000, "million": 1_000_000, "m": 1_000_000, "billion": 1_000_000_000, "bn": 1_000_000_000}
NUMBER = rf"\$?\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:million|billion|thousand|m|bn|k))?(?:\s*(?:%|percent)|\s+{UNITS})?"
NUMBER_PARTS = rf"^(\$)?\s*(\d[\d,]*(?:\.\d+)?)(?:\s*(million|billion|thousand|m|bn|k))?(?:\s*(%|percent)|\s+({UNITS}))?$"
DATE = (
    r"\b(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})\b"
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
CLAIM = r"[$€£¥]?\s*\d+(?:[.,]\d+)*(?:\s*%)?"
LEFT_IN_ENGLISH = (
    r"\b(?:the official|this item|motion and second|to approve|passed(?: unanimously)?|no action(?: taken)?|city council|public hearing|informational items?|regular meeting|approved minutes|staff report|"
    r"commissioners voted|council directed staff|linked staff report context|subject to the provisions)\b"
)
NUMERIC_VOTE = r"^\s*\d{1,2}(?:\s*[-–—]\s*\d{1,2}){1,2}\s*$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"((?i){pattern})"))


def numeric_values(text: Column) -> Column:
    """Distinct (amount, kind, unit) of the numbers in a text; kinds are currency, percent and number, and only numbers have units."""

    def value(said: Column) -> Column:
        part = lambda n: F.regexp_extract(F.trim(said), f"(?i){NUMBER_PARTS}", n)
        size = F.coalesce(*[F.when(F.lower(part(3)) == w, float(n)) for w, n in SIZES.items()], F.lit(1.0))
        kind = F.when(part(1) != "", "currency").when(part(4) != "", "percent").otherwise("number")
        word = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(part(5)), F.lit("."), F.lit("")), r"^(?:rentable|gross|net|usable|linear)\s+", ""), r"\s+", " "))
        plain = F.when(word.rlike("..ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
        unit = F.coalesce(*[F.when(word == w, u) for w, u in SAME_UNIT.items()], F.nullif(plain, F.lit("")))
        return F.struct((F.replace(part(2), F.lit(","), F.lit("")).try_cast("double") * size).alias("amount"), kind.alias("kind"), F.when(kind == "number", unit).alias("unit"))

    return F.array_distinct(F.filter(F.transform(_all(text, NUMBER), value), lambda v: v["amount"].isNotNull()))


def date_values(text: Column) -> Column:
    """Distinct days that a text names, as yyyy-MM-dd; what isn't a day of the calendar goes."""

    def day(said: Column) -> Column:
        named, slashed = r"(?i)^([a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
        month = F.coalesce(*[F.when(F.lower(said).startswith(m), f"{n + 1:02}") for n, m in enumerate(MONTHS)], F.lpad(F.regexp_extract(said, slashed, 1), 2, "0"))
        either = lambda n: F.when(said.rlike(slashed), F.regexp_extract(said, slashed, n)).otherwise(F.regexp_extract(said, named, n))
        return F.try_to_timestamp(F.concat_ws("-", either(3), month, F.lpad(either(2), 2, "0")), F.lit("yyyy-MM-dd")).cast("date").cast("string")

    return F.array_distinct(F.filter(F.transform(_all(text, DATE), day), lambda d: d.isNotNull()))


def ungrounded(summary: Column, source: Column) -> Column:
    """The values of a summary that its source doesn't state: days that it doesn't name, amounts of a kind that it doesn't have, units told apart where the summary gives one.

    The numbers inside days are no amounts.
    """
    without_days = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"(?i){DATE}", " ")
    alike = lambda a, b: (a["kind"] == b["kind"]) & (a["unit"].isNull() | a["unit"].eqNullSafe(b["unit"])) & (F.abs(a["amount"] - b["amount"]) <= F.greatest(F.lit(1.0), F.abs(a["amount"])) * 1e-12)
    told = lambda v: F.concat_ws(" ", v["kind"], v["amount"].cast("decimal(30,4)").cast("string"), v["unit"])
    sides = F.struct(numeric_values(without_days(summary)).alias("mine"), numeric_values(without_days(source)).alias("theirs"), date_values(summary).alias("days"), date_values(source).alias("their_days"))
    judge = lambda s: F.concat(F.transform(F.filter(s["mine"], lambda a: ~F.exists(s["theirs"], lambda b: alike(a, b))), told), F.array_except(s["days"], s["their_days"]))
    return F.transform(F.array(sides), judge)[0]


def numeric_claims(text: Column) -> Column:
    """The numbers of a text, sorted, each with its currency sign, its groups of digits and a percent sign; full-width digits are plain ones."""
    plain = F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９％＄．，", "0123456789%$.,")
    claim = lambda c: F.concat(F.regexp_extract(c, "([$€£¥])", 1), F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)")), ":"), F.when(F.contains(c, F.lit("%")), "%").otherwise(""))
    return F.array_sort(F.transform(_all(plain, CLAIM), claim))


def translation_issues(fields: dict[str, tuple[Column, Column]], votes: tuple[str, ...] = ("vote",)) -> Column:
    """What is wrong with a translation: field -> (source, translation) gives an array of issues in the order of the fields.

    A field that the source lacks stays empty; one that it has is there, keeps all numbers, isn't the source again (but for votes in numbers) and holds no English.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    found = []
    for name, (source, told) in fields.items():
        there = source.isNotNull() & told.isNotNull() & (F.trim(told) != "")
        same = norm(source) == norm(told)
        kept = same & ~(F.lit(name in votes) & source.rlike(NUMERIC_VOTE))
        found += [
            F.when(source.isNull() & told.isNotNull(), f"{name} changed a null source value"), F.when(source.isNotNull() & (told.isNull() | (F.trim(told) == "")), f"{name} was omitted"),
            F.when(there & (numeric_claims(source) != numeric_claims(told)), f"{name} changed numeric claims"), F.when(there & kept, f"{name} was left in English"),
            F.when(there & ~kept & told.rlike(f"(?i){LEFT_IN_ENGLISH}"), f"{name} contains untranslated English"),
        ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
