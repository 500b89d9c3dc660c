"""Joins of the platform: overlays, neighbours, unique and guarded matches, anti-joins.

Matches by several rules and by the words of titles are in ``matching``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*cols: Column) -> Column:
    """A digest of the columns' white-space-normalised values; null and blank count alike."""
    norm = [F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")) for c in cols]
    return F.sha2(F.to_json(F.array(*norm)), 256)


def overlay_translation(base: DataFrame, translations: DataFrame, key: str, texts: Sequence[str], locale: str, base_locale: str = "en") -> DataFrame:
    """``base`` with the texts of its fresh translation; stale, unready or blank ones leave the base text.

    translations: key, locale, source_fingerprint, translation_status and the texts.
    """
    if locale == base_locale:
        return base.withColumn("is_translated", F.lit(False))
    ready = translations.where((F.col("locale") == locale) & F.col("translation_status").isin("machine", "reviewed"))
    ready = ready.select(F.col(key).alias("t_key"), F.col("source_fingerprint").alias("t_print"), *[F.col(c).alias(f"t_{c}") for c in texts])
    fresh = (F.col(key) == F.col("t_key")) & (fingerprint(*[F.col(c) for c in texts]) == F.col("t_print"))
    joined = base.join(ready, fresh, "left")
    pick = {c: F.coalesce(F.when(F.trim(f"t_{c}") != "", F.col(f"t_{c}")), F.col(c)) for c in texts}
    return joined.withColumns(pick | {"is_translated": F.col("t_key").isNotNull()}).select(*base.columns, "is_translated")


def stale_translations(base: DataFrame, translations: DataFrame, key: str, texts: Sequence[str], locale: str) -> DataFrame:
    """The rows of ``base`` that have no translation of their present texts."""
    known = translations.where(F.col("locale") == locale).select(F.col(key).alias("t_key"), F.col("source_fingerprint").alias("t_print"))
    fresh = (F.col(key) == F.col("t_key")) & (fingerprint(*[F.col(c) for c in texts]) == F.col("t_print"))
    return base.join(known, fresh, "left_anti")


def adjacent(df: DataFrame, group: Sequence[str], time: str, key: str) -> DataFrame:
    """``df`` with ``older`` and ``newer``: the keys of the nearest rows before and after in the group."""
    w = Window.partitionBy(*group).orderBy(time, key)
    return df.withColumns({"older": F.lag(key).over(w), "newer": F.lead(key).over(w)})


def nested_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: Sequence[str], name: str) -> DataFrame:
    """``parents`` with an array of its children's fields, in order; empty for none."""
    grouped = children.groupBy(F.col(child_key).alias("nest_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(grouped, F.col(key) == F.col("nest_key"), "left").drop("nest_key")
    return joined.withColumn(name, F.coalesce(name, F.expr(f"slice({name}, 1, 0)"), F.array().cast(grouped.schema[name].dataType)))


def unique_match(left: DataFrame, right: DataFrame, on: Sequence[str], right_key: str, name: str) -> DataFrame:
    """``left`` with the key of the only right row that has its values of ``on``; null if there are none or several, or several left rows share it."""
    only = right.groupBy(*on).agg(F.count("*").alias("n_right"), F.min(right_key).alias(name)).where("n_right = 1").drop("n_right")
    alone = left.groupBy(*on).agg(F.count("*").alias("n_left")).where("n_left = 1").select(*on)
    return left.join(only.join(alone, list(on), "left_semi"), list(on), "left")


#: Characters of the pieces by which titles meet that hold one another.
GRAM = 4


def _grams(title: str, sizes: Column) -> Column:
    """The distinct pieces of a title, of each of the sizes, with their size before them."""
    of_size = lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(title) - g + 1)), lambda i: F.concat(g.cast("string"), F.lit(":"), F.substring(F.col(title), i, g)))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda g: g <= F.length(title)), of_size)))


def duplicate_pairs(df: DataFrame, key: str, at: Sequence[str], title: str, is_malformed: Column) -> DataFrame:
    """(duplicate, canonical): each malformed row and the row of the same place and time whose title, the longest such, its title contains.

    A title that is contained has all of its pieces in the other, so it asks with the one that the fewest malformed titles of its block hold; one that has
    a piece no other title holds asks for nothing.  Titles are compared once, however many rows have them.
    """
    titled = df.select(*at, F.col(key).alias("key"), F.lower(F.col(title)).alias("plain"), is_malformed.alias("bad"))
    bad = titled.where("bad").select(*at, "key", F.col("plain").alias("long_title"))
    long = bad.select(*at, "long_title").distinct().withColumn("long_id", F.xxhash64("long_title"))
    short = titled.where("NOT bad AND plain <> ''").groupBy(*at, F.col("plain").alias("short_title")).agg(F.min("key").alias("canonical"))
    size = F.least(F.lit(GRAM), F.length("short_title"))
    wanted = short.groupBy(*at).agg(F.collect_set(size).alias("sizes"))  # four sizes at most
    held = long.join(wanted, list(at)).select(*at, "long_id", F.explode(_grams("long_title", F.col("sizes"))).alias("gram"))
    often = held.groupBy(*at, "gram").agg(F.count("*").alias("often"))
    asking = short.withColumn("own", _grams("short_title", F.array(size)))
    asked = asking.select(*at, "short_title", "canonical", F.size("own").alias("pieces"), F.explode("own").alias("gram")).join(often, [*at, "gram"])
    rarest = asked.groupBy(*at, "short_title", "canonical", "pieces").agg(F.count("*").alias("there"), F.min(F.struct("often", "gram")).alias("ask")).where("there = pieces")
    met = rarest.select(*at, "short_title", "canonical", F.col("ask.gram").alias("gram")).join(held, [*at, "gram"]).join(long, [*at, "long_id"])
    best = F.min(F.struct((-F.length("short_title")).alias("n"), F.col("canonical")))
    found = met.where(F.contains("long_title", "short_title")).groupBy(*at, "long_title").agg(best.alias("best"))
    return bad.join(found, [*at, "long_title"]).select(F.col("key").alias("duplicate"), F.col("best.canonical").alias("canonical"))


def protected(pairs: DataFrame, owned: Sequence[DataFrame], key: str = "duplicate") -> DataFrame:
    """The pairs, with whether any of the tables in ``owned`` (first column: owner) has rows of the duplicate."""
    owners = None
    for df in owned:
        one = df.select(F.col(df.columns[0]).alias("owner"))
        owners = one if owners is None else owners.union(one)
    return pairs.join(owners.distinct().withColumn("is_protected", F.lit(True)), F.col(key) == F.col("owner"), "left").drop("owner").na.fill(False, ["is_protected"])
