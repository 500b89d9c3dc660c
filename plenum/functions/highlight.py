"""Where a text holds what was searched for, and an excerpt around it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import fold_marks, folded

ELLIPSIS = "…"


def _pattern(query: str) -> str | None:
    """The words of a query with anything but letters and digits between them; None without words."""
    words = [w for w in re.split(r"[\W_]+", fold_marks(query)) if w]
    return r"[^\p{L}\p{N}]+".join(re.escape(w) for w in words) if words else None


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def first_match(text: Column, query: str) -> Column:
    """(start, length) of the first place of a query, in characters from 0: as it is spelled, in any case, else by its words without marks; null for none."""
    needle = query.strip().lower()
    exact = F.instr(F.lower(text), needle)
    pattern = _pattern(query)
    hit = lambda exact: F.struct((exact - 1).alias("start"), F.lit(len(needle)).alias("length"))
    if not needle:
        return F.lit(None).cast("struct<start:int,length:int>")
    if pattern is None:
        return _bind(exact, lambda e: F.when(e > 0, hit(e)))

    def by_words(plain: Column) -> Column:
        found = lambda at: F.when(at > 0, F.struct((at - 1).alias("start"), F.length(F.regexp_extract(plain, f"({pattern})", 1)).alias("length")))
        return _bind(F.regexp_instr(plain, F.lit(pattern)), found)

    # a text that has the query as it is spelled is not folded at all; ligatures would move what stands behind them, so they stay
    whole = lambda told: F.when(F.length(told) == F.length(text), told).otherwise(F.lower(text))
    plain = _bind(folded(text), whole)
    return _bind(exact, lambda e: F.when(e > 0, hit(e)).otherwise(_bind(plain, by_words)))


def excerpt(text: Column, query: str, most: int = 180) -> Column:
    """So many characters of a text around the first place of a query, cut at spaces, two fifths of the room before it; null without a match, the whole of a short text."""
    # single spaces, which most are, stay as they are
    content = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s{2,}|[\t\n\x0B\f\r]", " "))

    def around(t: Column) -> Column:
        c, m, size = t["c"], t["m"], F.length(t["c"])
        match_end = m["start"] + m["length"]
        rough = F.greatest(F.lit(0), m["start"] - F.greatest(F.lit(0), F.floor((most - m["length"]) * 0.4).cast("int")))
        end = F.least(size, rough + most)
        start = F.when(end == size, F.greatest(F.lit(0), end - most)).otherwise(rough)
        # from the next word on, if that is before the match; up to the last space, if that is after it
        space = F.instr(F.substring(c, start + 1, size), " ")
        begin = F.when((start > 0) & (space > 0) & (start + space - 1 < m["start"]), start + space).otherwise(start)
        upto = F.substring(c, 1, end + 1)
        last = F.length(upto) - F.instr(F.reverse(upto), " ")
        stop = F.when((end < size) & (F.instr(upto, " ") > 0) & (last > match_end), last).otherwise(end)
        cut = F.concat(F.when(begin > 0, ELLIPSIS).otherwise(""), F.substring(c, begin + 1, stop - begin), F.when(stop < size, ELLIPSIS).otherwise(""))
        return F.when(m.isNotNull(), F.when(size <= most, c).otherwise(cut))

    return _bind(content, lambda c: _bind(F.struct(c.alias("c"), first_match(c, query).alias("m")), around))
