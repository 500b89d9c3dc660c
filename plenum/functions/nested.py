"""Nested JSON as VARIANT: objects inside texts and pages, lists of documents as rows, and a search through all levels.

All of it runs in the JVM; what isn't JSON gives null, and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep a search goes.
MOST_LEVELS = 12


def _bind(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def parsed(text: Column) -> Column:
    """The JSON value that a text holds: all of it, or what a code fence wraps, or from its first brace to its last; null for none."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.nullif(F.regexp_extract(bare, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(fenced), F.try_parse_json(braced))


def script_json(html: Column, name: str) -> Column:
    """The JSON that a page's script element with that id holds."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, rf"(?is)<script\b[^>]*\bid\s*=\s*[\"']?{name}\b[^>]*>(.*?)</script\s*>", 1), F.lit("")))


def children(value: Column) -> Column:
    """The elements of an array or the values of an object; none for anything else."""
    elements = F.try_variant_get(value, "$", "array<variant>")
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    return F.coalesce(elements, F.map_values(fields), F.array().cast("array<variant>"))


def anywhere(value: Column, found, levels: int = MOST_LEVELS) -> Column:
    """Whether ``found`` holds of the value or of anything inside it, so many levels deep; each level is made once from the one above."""

    def at(level: Column, depth: int) -> Column:
        here = F.exists(level, lambda v: F.coalesce(found(v), F.lit(False)))
        if depth == levels:
            return here
        return here | _bind(F.flatten(F.transform(level, children)), lambda below: F.when(F.size(below) > 0, at(below, depth + 1)).otherwise(F.lit(False)))

    return F.coalesce(at(F.array(value), 0), F.lit(False))


def rejected(value: Column, marker: str) -> Column:
    """Whether anything inside a value has a record ``marker`` with an issue that is more than a warning."""

    def has_issue(v: Column) -> Column:
        issues = F.try_variant_get(v, f"$.{marker}.issues", "array<variant>")
        # an issue is an object; without an outcome it is no warning
        return F.exists(issues, lambda i: F.try_variant_get(i, "$", "map<string,variant>").isNotNull() & ~F.coalesce(F.try_variant_get(i, "$.outcome", "string") == "warning", F.lit(False)))

    return anywhere(value, has_issue)


def raw_documents(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """(keep, nth, type, label, source_url): the documents listed in a raw meeting; one whose ``url`` is no text uses ``source_url``, and without either it goes."""
    listed = df.select(*keep, F.posexplode(F.try_variant_get(F.try_parse_json(F.col(raw)), "$.documents", "array<variant>")).alias("nth", "document"))
    field = lambda name: F.when(F.schema_of_variant(F.try_variant_get("document", f"$.{name}", "variant")) == "STRING", F.try_variant_get("document", f"$.{name}", "string"))
    url = F.coalesce(field("url"), field("source_url"))
    told = listed.select(*keep, "nth", field("type").alias("type"), field("label").alias("label"), url.alias("source_url"))
    return told.where("source_url <> ''")
