"""Text functions: token search, identity tokens, similarity, summary points, amounts, clean-up."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that one letter or nothing stands for once marks are off (NFKD, lower case), and Latin ones that several do."""
    one, more = {}, {}
    for n in [*range(0x80, 0xAC00), *range(0xF900, 0xFFF0)]:
        c = chr(n)
        if unicodedata.category(c).startswith("M"):
            one[c] = ""
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.category(x).startswith("M")).lower()
        if plain != c and len(plain) == 1:
            one[c] = plain
        elif plain != c.lower() and (n < 0x250 or 0xFB00 <= n <= 0xFB06):
            more[c] = plain
    return one, more


_ONE, _MORE = _plain_forms()
_TO_PLAIN = sorted(_ONE, key=lambda c: not _ONE[c])  # translate drops what the second string is too short for


def fold_marks(text: str) -> str:
    """Lower case without marks, compatibility forms as plain letters; what ``folded`` gives for a column."""
    return "".join(_MORE.get(c, _ONE.get(c, c)) for c in text.lower())


def folded(text: Column) -> Column:
    """``fold_marks`` of a text, in the JVM; empty for null."""
    # bound, so that the text is folded once, however often the result is looked at; what has no more bytes than characters has no marks
    lower = F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(_unmarked(t)))
    return F.transform(lower, spelled_out)[0]


def without_marks(text: Column) -> Column:
    """Lower case without marks, but for characters that several letters stand for; empty for null."""
    return _unmarked(F.lower(F.coalesce(text, F.lit(""))))


def _unmarked(lower: Column) -> Column:
    return F.translate(lower, "".join(_TO_PLAIN), "".join(_ONE[c] for c in _TO_PLAIN))


def spelled_out(lower: Column) -> Column:
    """``without_marks`` with the letters that its other characters stand for."""
    spelled = lower
    for c, letters in _MORE.items():
        spelled = F.replace(spelled, F.lit(c), F.lit(letters))
    # what has no more bytes than characters is plain already
    return F.when(F.octet_length(lower) == F.length(lower), lower).when(lower.rlike("[" + "".join(_MORE) + "]"), spelled).otherwise(lower)


def search_tokens(text: Column) -> Column:
    """Lower-case tokens of letters and digits, without marks."""
    return F.array_remove(F.split(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def token_match(text: Column, needle: str) -> Column:
    """Whether the needle's tokens stand in a row in the text: each within a token, numbers only as whole ones.

    A needle without tokens matches every text.
    """
    wanted = [t for t in re.split(r"[\W_]+", fold_marks(needle)) if t]
    if not wanted:
        return F.lit(True)
    fits = lambda have, want: have == want if want.isdigit() else F.contains(have, F.lit(want))

    def at(tokens: Column, i: Column) -> Column:
        found = None
        for k, want in enumerate(wanted):
            here = F.coalesce(fits(F.get(tokens, i + k), want), F.lit(False))
            found = here if found is None else found & here
        return found

    # the tokens are bound, so that they are made once per row
    with_places = lambda tokens: F.exists(F.sequence(F.lit(0), F.size(tokens)), lambda i: at(tokens, i))
    return F.transform(F.array(search_tokens(text)), with_places)[0]


def ilike_pattern(value: str) -> str:
    """A pattern for ILIKE that matches the trimmed value anywhere, with its wildcards taken literally."""
    text = " ".join(value.split())[:120]
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, most: int = 90) -> Column:
    """Lower-case letters and digits with single dashes between, of at most ``most`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def identity_tokens(text: Column, stop_words: list[str]) -> Column:
    """Sorted distinct tokens of a title, less stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_except(search_tokens(text), stop)))


def overlap(left: Column, right: Column) -> Column:
    """Shared tokens by the fewer tokens of either; 0 if one has none."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / least).otherwise(F.lit(0.0))


def number_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))


def numbers_conflict(left: Column, right: Column) -> Column:
    """Whether both have number tokens and the sets differ."""
    a, b = number_tokens(left), number_tokens(right)
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0))


def summary_points(text: Column) -> Column:
    """Points from a JSON array of strings, or else from lines; blank ones go, and a text that only looks like JSON stays one point."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    parsed = F.from_json(F.when(trimmed.startswith("["), trimmed), "array<string>")
    strings = F.when(trimmed.rlike(r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$'), parsed)
    points = F.coalesce(strings, F.split(trimmed, r"\r?\n"))
    return F.filter(F.transform(points, lambda p: F.trim(p)), lambda p: F.length(p) > 0)


#: Words for sizes of amounts.
SIZES = {"billion": 1e9, "b": 1e9, "million": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}


def largest_dollars(text: Column) -> Column:
    """The largest dollar amount that a text names, with its unit; 0 without any."""
    # a piece starts where a dollar sign ends: a number, and perhaps the word for its size
    pieces = F.slice(F.split(F.coalesce(text, F.lit("")), r"\$"), 2, F.greatest(F.lit(0), F.size(F.split(F.coalesce(text, F.lit("")), r"\$")) - 1))

    def dollars(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^\s?([0-9,]*[0-9](?:\.[0-9]+)?)", 1)
        word = F.lower(F.regexp_extract(piece, r"^\s?[0-9][0-9,.]*\s*([A-Za-z]+)", 1))
        times = F.coalesce(*[F.when(word == unit, size) for unit, size in SIZES.items()], F.lit(1.0))
        return F.coalesce(F.regexp_replace(number, ",", "").try_cast("double"), F.lit(0.0)) * times

    return F.coalesce(F.array_max(F.transform(pieces, dollars)), F.lit(0.0))


def money_score(text: Column) -> Column:
    """0 below 1,000 dollars, else 4 points and 4 for each factor of ten above, to 26."""
    amount = largest_dollars(text)
    return F.when(amount < 1000, 0).otherwise(F.least(F.lit(26), F.greatest(F.lit(0), F.floor((F.log10(amount) - 3) * 4 + 4.5)))).cast("int")


#: Elements whose content is no text, and the characters that references stand for.
_UNSEEN = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->"
_REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_to_text(html: Column) -> Column:
    """A page's text: unseen elements and tags go, block ends become line breaks, common references are decoded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol)\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in _REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\f\x{A0}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n{2,}", "\n"))


def classify(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first rule (label, pattern) that the text matches."""
    out = F
    for label, pattern in rules:
        out = out.when(text.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(other))


def redact(text: Column) -> Column:
    """A log line without e-mail addresses, bearer tokens and url queries."""
    text = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    text = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    return F.regexp_replace(text, r"(https?://[^\s?]+)\?\S+", "$1?[redacted]")
