"""Queries that match cards with stored children and agenda items: claims in rounds, and the cascade with its stops.

Documents are the cards here; their first lines are the titles, and the copies among them contend for one another.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import civic_text as said
from plenum.operators import matching
from plenum.plans.registry import query
from plenum.sources.readers import table

_RESPELLED = [
    (r"\bcapital improvement program\s*\(\s*cip\s*\)", "cip"), (r"\bcapital improvement program\b", "cip"), (r"\bpublic works\s*(?:and|&)\s*transportation commission\b", "pwtc"),
    (r"\beast palo alto sanitary district\s*\(\s*epasd\s*\)", "epasd"), (r"\beast palo alto sanitary district\b", "epasd"), (r"\bsenate bill\b", "sb"), (r"\brates?\b", "rate"),
    (r"\bincreases?\b", "increase"), (r"\bdisruptions?\b", "disruption"), (r"\btemporar(?:y|ily)\b", " "), (r"\bwork[\s-]+plan\b", "workplan"), (r"&", " and "), (r"[^a-z0-9.]+", " "),
]
_STOP = "a ad advisory an and adoption annual approving change compliance conduct consider for get hoc hearing maximum near of on public receive resolution review the to vote with adjustments during in informational presentation discussion"
_REWORDING = "['accept', 'approve', 'consistency', 'law', 'replace', 'state', 'update']"


def sql_tokens(title: str) -> str:
    """The identity tokens of a title, in DuckDB."""
    text = f"strip_accents(lower({title}))"
    for pattern, word in _RESPELLED:
        text = f"regexp_replace({text}, '{pattern}', '{word}', 'g')"
    stop = ", ".join(f"'{w}'" for w in _STOP.split())
    return f"list_sort(list_distinct(list_filter(string_split({text}, ' '), lambda x: x <> '' AND NOT list_contains([{stop}], x))))"


def sql_conflict(a: str, b: str) -> str:
    digits = lambda t: f"list_filter({t}, lambda x: regexp_matches(x, '[0-9]'))"
    return f"(len({digits(a)}) > 0 AND len({digits(b)}) > 0 AND {digits(a)} <> {digits(b)})"


def sql_same_item(a: str, b: str) -> str:
    """Whether two sorted token lists name one item, in DuckDB."""
    least, shared = f"least(len({a}), len({b}))", f"len(list_intersect({a}, {b}))"
    only = lambda x, y: f"len(list_filter({x}, lambda w: NOT list_contains({y}, w) AND NOT list_contains({_REWORDING}, w))) = 0"
    reworded = f"({least} >= 5 AND {shared} >= 0.8 * {least} AND {only(a, b)} AND {only(b, a)})"
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({a} = {b} OR NOT {sql_conflict(a, b)} AND ({reworded} OR len({a}) <> len({b}) AND {least} >= 3 AND {shared} = {least})))"


_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_FIRST = "split_part(coalesce(text, ''), chr(10), 1)"
_PARENT = "lang || '-' || CAST(coalesce(n_chars, 0) % 40 AS VARCHAR)"


def _claim_rounds() -> str:
    """The rounds of claims as common table expressions."""
    out, last = [], "k0"
    for which, free, who in (("", "legacy", "c"), ("identified_", "adoptable", "(SELECT * FROM c WHERE NOT has)")):
        for rule in ("exact", "title", "fuzzy"):
            name = f"k_{which}{rule}"
            s, f = f"(SELECT * FROM {who} WHERE card_id NOT IN (SELECT card_id FROM {last}))", f"(SELECT * FROM {free} WHERE row_id NOT IN (SELECT row_id FROM {last}))"
            if rule == "fuzzy":
                new = f"""SELECT arg_min(card_id, ord) AS card_id, row_id FROM (SELECT s.card_id, s.ord, min(f.row_id) AS row_id FROM {s} s JOIN {f} f ON s.parent = f.parent AND {sql_same_item("s.tok", "f.tok")}
GROUP BY s.card_id, s.ord HAVING count(*) = 1) GROUP BY row_id"""
            else:
                on = "parent, tn, link" if rule == "exact" else "parent, tn"
                new = f"SELECT card_id, row_id FROM (SELECT {on}, min(row_id) AS row_id FROM {f} GROUP BY {on} HAVING count(*) = 1) JOIN (SELECT {on}, arg_min(card_id, ord) AS card_id FROM {s} GROUP BY {on}) USING ({on})"
            out.append(f"{name} AS (SELECT * FROM {last} UNION ALL SELECT card_id, row_id, '{which}{rule}' AS rule FROM ({new}))")
            last = name
    return ",\n".join(out)


@query("adopt_children", rf"""WITH d AS (SELECT doc_id, {_PARENT} AS parent, {_FIRST} AS title, source, lang FROM documents),
src AS (SELECT -doc_id - 1 AS card_id, doc_id AS ord, parent, CASE WHEN doc_id % 5 = 0 THEN 'i' || CAST(doc_id // 2 * 2 AS VARCHAR) END AS id, CASE doc_id % 4 WHEN 0 THEN 'Update ' || title WHEN 1 THEN title || ' north side' ELSE title END AS title, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS url FROM d),
tgt AS (SELECT doc_id AS row_id, parent, CASE WHEN doc_id % 3 = 0 THEN 'i' || CAST(doc_id AS VARCHAR) END AS id, title, source AS url, doc_id % 7 = 0 AS is_featured FROM d),
c0 AS (SELECT card_id, ord, parent, id IS NOT NULL AS has, id, {_NORM.format("title")} AS tn, {_NORM.format("url")} AS link, {sql_tokens("title")} AS tok FROM src),
c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY parent, has, CASE WHEN has THEN id ELSE tn END, CASE WHEN has THEN '' ELSE link END ORDER BY ord) AS n FROM c0) WHERE n = 1),
r AS (SELECT row_id, parent, id IS NOT NULL AS has, id, {_NORM.format("title")} AS tn, {_NORM.format("url")} AS link, {sql_tokens("title")} AS tok FROM tgt),
legacy AS (SELECT * FROM r WHERE NOT has), adoptable AS (SELECT * FROM r WHERE has AND (parent, id) NOT IN (SELECT (parent, id) FROM c WHERE has)),
k0 AS (SELECT card_id, max(row_id) AS row_id, 'identity' AS rule FROM c JOIN r USING (parent, id) WHERE c.has AND r.has GROUP BY card_id),
{_claim_rounds()}
SELECT c.card_id, c.parent, k.row_id AS adopted, coalesce(k.rule, 'new') AS rule, coalesce(c.id, t.id) AS source_item_id, t.is_featured FROM c LEFT JOIN k_identified_fuzzy k USING (card_id) LEFT JOIN tgt t ON t.row_id = k.row_id""")
def adopt_children(spark, sf_dir):
    """Each document comes anew, reworded, expanded or with another url, some with an identity; stored ones are claimed once, in rounds."""
    key = F.col("doc_id")
    parent = F.concat_ws("-", "lang", (F.coalesce("n_chars", F.lit(0)) % 40).cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", parent.alias("parent"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), "source", "lang")
    stored = docs.select(key.alias("card_id"), "parent", F.when(key % 3 == 0, F.concat(F.lit("i"), key)).alias("source_item_id"), "title", F.col("source").alias("url"), (key % 7 == 0).alias("is_featured"))
    retitled = F.when(key % 4 == 0, F.concat(F.lit("Update "), "title")).when(key % 4 == 1, F.concat("title", F.lit(" north side"))).otherwise(F.col("title"))
    identity = F.when(key % 5 == 0, F.concat(F.lit("i"), (F.floor(key / 2) * 2).cast("string")))
    fresh = docs.select((-key - 1).alias("card_id"), key.alias("ord"), "parent", identity.alias("source_item_id"), retitled.alias("title"), F.when(key % 3 == 0, F.col("lang")).otherwise(F.col("source")).alias("url"))
    return matching.adopt_children(stored, fresh, "parent", "card_id", "ord", "source_item_id", "title", "url", ["is_featured"])


_CARDS = rf"""d AS (SELECT doc_id, {_PARENT} AS block, {_FIRST} AS title, source, coalesce(n_chars, 0) AS n_chars FROM documents),
cards AS (SELECT doc_id AS card_id, block, title, CASE WHEN doc_id % 6 = 1 THEN source END AS url, CASE WHEN doc_id % 10 = 3 THEN CAST(n_chars % 12 AS VARCHAR) || '.' END AS number,
  CASE WHEN doc_id % 8 = 5 THEN 'i' || CAST(doc_id - 1 AS VARCHAR) END AS id, source AS points FROM d WHERE doc_id % 2 = 1),
items AS (SELECT doc_id AS item_id, block, title, source AS url, CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars % 12 AS VARCHAR) END AS number, 'i' || CAST(doc_id // 3 * 3 AS VARCHAR) AS id, n_chars % 3 = 0 AS has_result FROM d WHERE doc_id % 2 = 0)"""


def _sql_cascade(cards: str, items: str, out: str, points: str = "''") -> str:
    """The cascade as common table expressions that end in ``out`` (card_id, item_id, method, score)."""
    return rf"""{out}_c AS (SELECT card_id, block, nullif(trim(url), '') AS url, nullif(upper(regexp_replace(trim(number), '[.\s]+$', '')), '') AS number, {sql_tokens(f"title || ' ' || {points}")} AS tok FROM {cards}),
{out}_i AS (SELECT item_id, block, trim(url) AS url, nullif(upper(regexp_replace(trim(number), '[.\s]+$', '')), '') AS number, {sql_tokens("title")} AS tok FROM {items}),
{out}_u AS (SELECT block, url, min(item_id) AS item_id FROM {out}_i GROUP BY block, url HAVING count(*) = 1),
{out}_n AS (SELECT block, number, count(*) AS same, min(item_id) AS item_id FROM {out}_i WHERE number IS NOT NULL GROUP BY block, number),
{out}_s AS (SELECT c.*, u.item_id AS by_url, n.item_id AS by_number, CASE WHEN u.item_id IS NOT NULL THEN 'source_url' WHEN c.number IS NULL OR c.block NOT IN (SELECT block FROM {out}_n) THEN 'title' WHEN n.same IS NULL THEN 'none' WHEN n.same = 1 THEN 'agenda_number' ELSE 'narrowed' END AS step
  FROM {out}_c c LEFT JOIN {out}_u u USING (block, url) LEFT JOIN {out}_n n ON n.block = c.block AND n.number = c.number),
{out}_p AS (SELECT s.card_id, i.item_id, len(list_intersect(s.tok, i.tok)) AS common, len(list_intersect(s.tok, i.tok)) / least(len(s.tok), len(i.tok)) AS score
  FROM {out}_s s JOIN {out}_i i ON s.block = i.block AND (s.step = 'title' OR s.step = 'narrowed' AND i.number = s.number) WHERE len(s.tok) > 0 AND len(i.tok) > 0 AND NOT {sql_conflict("s.tok", "i.tok")}),
{out}_r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM {out}_p WHERE common >= 3 WINDOW w AS (PARTITION BY card_id ORDER BY score DESC, item_id)),
{out} AS (SELECT card_id, by_url AS item_id, 'source_url' AS method, CAST(1 AS DOUBLE) AS score FROM {out}_s WHERE step = 'source_url' UNION ALL SELECT card_id, by_number, 'agenda_number', 1 FROM {out}_s WHERE step = 'agenda_number'
  UNION ALL SELECT card_id, item_id, 'title', score FROM {out}_r WHERE place = 1 AND score >= 0.72 AND score - coalesce(next, 0) >= 0.15)"""


def _cards(spark, sf_dir):
    key = F.col("doc_id")
    block = F.concat_ws("-", "lang", (F.coalesce("n_chars", F.lit(0)) % 40).cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", block.alias("block"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), "source", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    number = (F.col("n_chars") % 12).cast("string")
    cards = docs.where(key % 2 == 1).select(
        key.alias("card_id"), "block", "title", F.when(key % 6 == 1, F.col("source")).alias("url"), F.when(key % 10 == 3, F.concat(number, F.lit("."))).alias("number"),
        F.when(key % 8 == 5, F.concat(F.lit("i"), (key - 1).cast("string"))).alias("id"), F.col("source").alias("points"),
    )
    items = docs.where(key % 2 == 0).select(
        key.alias("item_id"), "block", "title", F.col("source").alias("url"), F.when(key % 4 == 0, number).alias("number"), F.concat(F.lit("i"), (F.floor(key / 3) * 3).cast("string")).alias("id"), (F.col("n_chars") % 3 == 0).alias("has_result"),
    )
    return cards, items


@query("match_cascade", f"WITH {_CARDS}, {_sql_cascade('cards', 'items', 'm')} SELECT * FROM m")
def match_cascade(spark, sf_dir):
    """Odd documents find the even one they are about: by url, by number, or by title; a number that no item has ends the search."""
    cards, items = _cards(spark, sf_dir)
    return matching.match_cascade(cards, items, "block", "card_id", "item_id")


@query("source_items", rf"""WITH {_CARDS}, known AS (SELECT block, id FROM items GROUP BY block, id HAVING count(*) = 1),
ci AS (SELECT * FROM cards WHERE (block, id) IN (SELECT (block, id) FROM known)),
t AS (SELECT block, {_NORM.format("title")} AS tn, min(id) AS id FROM items GROUP BY ALL HAVING count(*) = 1),
e AS (SELECT c.card_id, t.id FROM cards c JOIN t ON t.block = c.block AND t.tn = {_NORM.format("c.title")} WHERE c.card_id NOT IN (SELECT card_id FROM ci) AND (t.block, t.id) IN (SELECT (block, id) FROM known)),
open1 AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS number) FROM cards WHERE card_id NOT IN (SELECT card_id FROM ci UNION ALL SELECT card_id FROM e)), plain_items AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS number) FROM items),
{_sql_cascade("open1", "plain_items", "m1")}, open2 AS (SELECT * FROM open1 WHERE card_id NOT IN (SELECT card_id FROM m1)), {_sql_cascade("open2", "plain_items", "m2", "points")}
SELECT card_id, id, 'known' AS method FROM ci UNION ALL SELECT card_id, id, 'exact_title' FROM e
UNION ALL SELECT m.card_id, i.id, m.method FROM (SELECT card_id, item_id, 'title' AS method FROM m1 UNION ALL SELECT card_id, item_id, 'title_points' FROM m2) m JOIN items i USING (item_id) WHERE (i.block, i.id) IN (SELECT (block, id) FROM known)""")
def source_items(spark, sf_dir):
    """The identity of the item that each odd document comes from; an identity that two items of a block have is nobody's."""
    cards, items = _cards(spark, sf_dir)
    return matching.source_items(cards, items, "block", "card_id", "id").select("card_id", "id", "method")


@query("structured_results", rf"""WITH {_CARDS}, known AS (SELECT block, id FROM items GROUP BY block, id HAVING count(*) = 1), decided AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS number) FROM items WHERE has_result),
by_id AS (SELECT c.card_id, i.item_id FROM cards c JOIN decided i USING (block, id) WHERE (c.block, c.id) IN (SELECT (block, id) FROM known)),
specific AS (SELECT block, url FROM items GROUP BY block, url HAVING count(*) = 1),
rest AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS number, CASE WHEN (block, url) IN (SELECT (block, url) FROM specific) THEN url END AS url) FROM cards WHERE card_id NOT IN (SELECT card_id FROM by_id)), {_sql_cascade("rest", "decided", "m")}
SELECT card_id, item_id, 'source_item_id' AS method, CAST(1 AS DOUBLE) AS score FROM by_id UNION ALL SELECT * FROM m""")
def structured_results(spark, sf_dir):
    """The item with a recorded result that each odd document is about, a third of the even ones having one."""
    cards, items = _cards(spark, sf_dir)
    return matching.structured_results(cards, items, "block", "card_id", "item_id", "id", F.col("has_result"))
