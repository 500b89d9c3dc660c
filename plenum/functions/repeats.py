"""Texts that repeat themselves, and summaries that only repeat their source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How often a sequence of so many words must stand in a row, and phrases of official boilerplate.
LEAST_REPEATS = {1: 6, 2: 4, 3: 4, 4: 4}
BOILERPLATE = r"official minutes record|motion and second|page\s+\d+\s+of\s+\d+|\baction\s*:"
LEAST_VERBATIM = 20


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def most_repeats(tokens: Column, size: int) -> Column:
    """How often, at most, a sequence of ``size`` words stands in a row: one pass over the words, in the JVM."""
    alike = lambda i: F.coalesce(F.get(tokens, i) == F.get(tokens, i + size), F.lit(False))
    # a stretch of n words that equal those size further on holds n / size further copies
    grown = lambda s, i: F.when(alike(i), s["now"] + 1).otherwise(0)
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, i: F.transform(F.array(grown(s, i)), lambda n: F.struct(n.alias("now"), F.greatest(s["most"], n).alias("most")))[0]
    places = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: i < F.size(tokens))
    most = F.aggregate(places, none, step, lambda s: s["most"])
    return F.when(F.size(tokens) >= size, F.floor(most / size) + 1).otherwise(0).cast("int")


def repeat_counts(text: Column, sizes=tuple(LEAST_REPEATS)) -> Column:
    """Struct of the most repeats of sequences of each size (``r1``, ``r2``, ...)."""
    return F.transform(F.array(word_tokens(text)), lambda t: F.struct(*[most_repeats(t, n).alias(f"r{n}") for n in sizes]))[0]


def repeats_itself(counts: Column) -> Column:
    """Whether a sequence of up to four words stands in a row so often that no one wrote it."""
    said = F.lit(False)
    for size, least in LEAST_REPEATS.items():
        said = said | (counts[f"r{size}"] >= least)
    return said


def near_verbatim(summary: Column, source: Column) -> Column:
    """Whether one of two texts, as words of a-z and digits, holds the other, both being longer than ``LEAST_VERBATIM``."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))
    pair = F.struct(norm(summary).alias("a"), norm(source).alias("b"))
    judge = lambda p: (F.length(p["a"]) > LEAST_VERBATIM) & (F.length(p["b"]) > LEAST_VERBATIM) & (F.contains(p["b"], p["a"]) | F.contains(p["a"], p["b"]))
    return F.transform(F.array(pair), judge)[0]


def is_boilerplate(summary: Column) -> Column:
    return F.coalesce(summary.rlike(f"(?i){BOILERPLATE}"), F.lit(False))
