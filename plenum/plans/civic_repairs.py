"""Queries of repairs and audits: merged meetings, survivors, targets of children, link bands, guarded writes, repeats and nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import civic_text as said
from plenum.functions import nested, repeats
from plenum.operators import bands, merge, repair
from plenum.plans.civic_matches import sql_same_item, sql_tokens
from plenum.plans.registry import query
from plenum.plans.roles import CARDS, cards, with_roles
from plenum.sources.readers import table

_FIRST = "split_part(coalesce(text, ''), chr(10), 1)"
_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


def _first_line():
    return F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)


@query("merged_meetings", rf"""WITH c AS (SELECT doc_id AS card_id, lang || '-' || CAST(doc_id % 40 AS VARCHAR) AS meeting_id, lang, doc_id % 40 AS n, {_NORM.format(_FIRST)} AS plain, {sql_tokens(_FIRST)} AS tok FROM documents),
dup AS (SELECT l.card_id, l.meeting_id FROM c l WHERE l.n % 2 = 1 AND EXISTS (SELECT 1 FROM c s WHERE s.lang = l.lang AND s.n = l.n - 1 AND (s.plain = l.plain OR {sql_same_item("l.tok", "s.tok")}))),
bad AS (SELECT DISTINCT meeting_id FROM dup WHERE card_id % 5 = 0),
p AS (SELECT card_id, CASE WHEN n % 2 = 0 OR meeting_id IN (SELECT meeting_id FROM bad) THEN 'keep' WHEN card_id IN (SELECT card_id FROM dup) THEN 'drop' ELSE 'move' END AS action, meeting_id, lang, n FROM c),
q AS (SELECT card_id, action, CASE WHEN action = 'move' THEN lang || '-' || CAST(n - 1 AS VARCHAR) ELSE meeting_id END AS meeting_id FROM p)
SELECT 'card' AS what, * FROM q UNION ALL SELECT 'outcome', * FROM q WHERE card_id % 5 = 0
UNION ALL SELECT 'document', l.doc_id, CASE WHEN c.n % 2 = 0 OR c.meeting_id IN (SELECT meeting_id FROM bad) THEN 'keep' ELSE 'move' END, CASE WHEN c.n % 2 = 0 OR c.meeting_id IN (SELECT meeting_id FROM bad) THEN c.meeting_id ELSE c.lang || '-' || CAST(c.n - 1 AS VARCHAR) END FROM labels l JOIN c ON c.card_id = l.doc_id
UNION ALL SELECT 'conflict', card_id, 'keep', meeting_id FROM dup WHERE card_id % 5 = 0""")
def merged_meetings(spark, sf_dir):
    """Every odd meeting of documents goes into the even one before it, unless a copy that would go has an outcome; three child tables follow."""
    key = F.col("doc_id")
    of = lambda n: F.concat_ws("-", "lang", n.cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", _first_line().alias("title"))
    stored = docs.select(key.alias("card_id"), of(key % 40).alias("meeting_id"), "title")
    pairs = docs.where(key % 2 == 1).select(of(key % 40).alias("loser"), of(key % 40 - 1).alias("survivor")).distinct()
    outcomes = stored.where("card_id % 5 = 0").select("card_id", "meeting_id")
    papers = table(spark, sf_dir, "labels", "doc_id").join(stored.select(F.col("card_id").alias("doc_id"), "meeting_id"), "doc_id")
    done = repair.consolidate(pairs, stored, outcomes, {"documents": papers})
    row = lambda df, what, card: df.select(F.lit(what).alias("what"), F.col(card).alias("card_id"), "action", "meeting_id")
    refused = done.conflicts.select("card_id", F.lit("keep").alias("action"), F.col("loser").alias("meeting_id"))
    return row(done.cards, "card", "card_id").union(row(done.children["outcomes"], "outcome", "card_id")).union(row(done.children["documents"], "document", "doc_id")).union(row(refused, "conflict", "card_id"))


@query("card_survivors", rf"""WITH c AS (SELECT doc_id, lang, {_NORM.format(_FIRST)} AS plain FROM documents),
s AS (SELECT c.*, CASE WHEN c.doc_id % 3 = 0 THEN 1000 + 100 * (c.doc_id % 4) / 4.0 ELSE 0 END + CASE WHEN l.n IS NOT NULL THEN 100 * l.n ELSE 0 END + CASE WHEN c.doc_id % 2 = 0 THEN 50 ELSE 0 END + CASE WHEN c.doc_id % 7 = 0 THEN 10 ELSE 0 END
  + CASE WHEN c.doc_id % 5 > 0 THEN 5 ELSE 0 END + 1000.0 * c.doc_id / 1e13 AS score FROM c LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l USING (doc_id)),
g AS (SELECT lang, plain, arg_min(doc_id, (-score, doc_id)) AS k, count(*) FILTER (WHERE doc_id % 3 = 0) > 1 AND count(DISTINCT doc_id % 2) FILTER (WHERE doc_id % 3 = 0) > 1 AS is_conflict FROM s GROUP BY lang, plain)
SELECT doc_id, CASE WHEN NOT is_conflict THEN k END AS survivor, is_conflict, CAST(coalesce(CASE WHEN NOT is_conflict THEN k END, doc_id) AS BIGINT) AS outcome_card FROM c JOIN g USING (lang, plain)""")
def card_survivors(spark, sf_dir):
    """Which of the documents with one first line survives, by score; where outcomes differ none does.  An outcome goes to its card's survivor."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower(F.trim(F.regexp_replace(_first_line(), r"\s+", " "))).alias("plain"))
    outcomes = docs.where(key % 3 == 0).select("doc_id", F.concat(F.lit("k"), key % 2).alias("matched_item_key"), F.lit("u").alias("source_url"), F.lit("Passed").alias("headline"), (key % 4 / 4.0).alias("match_score"))
    chosen = repair.survivors(docs, outcomes, table(spark, sf_dir, "labels", "doc_id"), ["lang", "plain"], "doc_id", key % 2 == 0, key % 7 == 0, key % 5 > 0, F.timestamp_seconds(key))
    onto = repair.fold_cards(chosen, {"refs": docs.select("doc_id", key.alias("ref"))}, "doc_id")[1]["refs"]
    return chosen.select("doc_id", "survivor", "is_conflict").join(onto.select(F.col("ref").alias("doc_id"), key.alias("outcome_card")), "doc_id")


_URL = "l_partkey || '-' || ((l_suppkey + {}) % 3)"


@query("child_targets", f"""WITH m AS (SELECT o_orderkey AS meeting, o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS day FROM orders), u AS (SELECT DISTINCT l_orderkey AS meeting, {_URL.format(0)} AS url FROM lineitem),
e AS (SELECT kind, url, count(*) AS n, min(meeting) AS by_url FROM u JOIN m USING (meeting) GROUP BY kind, url), d AS (SELECT kind, day, count(*) AS n, min(meeting) AS by_day FROM m GROUP BY kind, day),
c AS (SELECT l_orderkey AS owner, l_linenumber AS line, {_URL.format("CAST(l_quantity AS BIGINT)")} AS url, CAST(l_shipdate AS DATE) AS named, l_returnflag = 'A' AS may FROM lineitem),
t AS (SELECT c.*, m.kind, CASE WHEN m.kind IS NULL THEN 'none' WHEN e.n = 1 THEN 'url' WHEN e.n > 1 AND (c.owner, c.url) IN (SELECT (meeting, url) FROM u) THEN 'owner_of_several' WHEN e.n IS NULL AND d.n = 1 THEN 'day' WHEN may THEN 'fallback' ELSE 'none' END AS method, e.by_url, d.by_day
  FROM c LEFT JOIN m ON m.meeting = c.owner LEFT JOIN e ON e.kind = m.kind AND e.url = c.url LEFT JOIN d ON d.kind = m.kind AND d.day = c.named)
SELECT method, count(*) AS n, CAST(sum(CASE method WHEN 'url' THEN by_url WHEN 'day' THEN by_day WHEN 'none' THEN NULL ELSE owner END) AS BIGINT) AS targets FROM t GROUP BY method""")
def child_targets(spark, sf_dir):
    """The order that each line belongs to by its url, of those of its order's priority, by the day it was shipped, or as its owner."""
    meetings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting"), F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem")
    url = lambda more: F.concat_ws("-", "l_partkey", ((F.col("l_suppkey") + more) % 3).cast("string"))
    urls = lines.select(F.col("l_orderkey").alias("meeting"), url(F.lit(0)).alias("url"))
    children = lines.select(F.col("l_orderkey").alias("owner"), url(F.col("l_quantity").cast("long")).alias("url"), F.to_date("l_shipdate").alias("shipped"), (F.col("l_returnflag") == "A").alias("may"))
    told = repair.resolve_targets(children, meetings, urls, "owner", "meeting", "kind", "url", "day", F.col("shipped"), F.col("may"))
    return told.groupBy("method").agg(F.count("*").alias("n"), F.sum("target").alias("targets"))


@query("link_bands", """WITH l AS (SELECT l_suppkey AS page, l_orderkey AS o, l_linenumber AS line, CAST(l_extendedprice AS DECIMAL(18,2)) AS y, l_returnflag AS f FROM lineitem),
s AS (SELECT page, y, o * 10 + line AS nth, CASE WHEN line = 1 THEN o END AS number FROM l WHERE line = 1 OR line = 2 AND f = 'R'), k AS (SELECT page, o, line, y, row_number() OVER () AS r FROM l WHERE line > 2),
m AS (SELECT k.r, k.page, k.o, k.line, arg_min(coalesce(s.number, -1), (s.y, -s.nth)) AS number FROM k LEFT JOIN s ON s.page = k.page AND s.y + 8 >= k.y GROUP BY ALL)
SELECT page, o AS link_order, line, CASE WHEN number >= 0 THEN number END AS number FROM m""")
def link_bands(spark, sf_dir):
    """Lines as links at their prices: the first line of an order opens a block of the supplier's page, returned second lines end one."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("link_order"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").cast("decimal(18,2)").alias("y"), F.col("l_returnflag").alias("flag")
    )
    lines = rows.where("line < 3").select("page", "y", (F.col("link_order") * 10 + F.col("line")).alias("nth"), F.when(F.col("line") == 1, F.col("link_order")).alias("number"), ((F.col("line") == 2) & (F.col("flag") == "R")).alias("is_end"))
    return bands.link_bands(rows.where("line > 2").drop("flag"), lines, ["page"], "y", "nth", "number", F.col("is_end"), width=5000).select("page", "link_order", "line", "number")


@query("guarded_write", with_roles("""SELECT card_id, points, told, is_featured, bumped, reasons FROM (
SELECT card_id, CASE WHEN card_id % 10 = 0 OR card_id % 4 > 0 THEN status || ';' || category WHEN card_id % 8 = 4 THEN 'new;' || category ELSE 'a;b' END AS points,
  CASE WHEN card_id % 10 = 0 OR card_id % 4 > 0 THEN status || chr(10) || category WHEN card_id % 8 = 4 THEN 'new' || chr(10) || category ELSE 'a' || chr(10) || 'b' END AS told,
  CASE WHEN card_id % 10 > 0 AND card_id % 4 = 0 THEN card_id % 8 = 0 ELSE is_featured END AS is_featured, card_id % 10 > 0 AND card_id % 4 = 0 AS bumped, '' AS reasons FROM cards
UNION ALL SELECT card_id, 'w;x;y;z', 'w' || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z', card_id % 8 = 0, TRUE, 'points' FROM cards WHERE card_id % 20 = 0)""", CARDS))
def guarded_write(spark, sf_dir):
    """Every fourth card is written again, with points or with text, which follow one another; those with four points are refused and stay."""
    key = F.col("card_id")
    first = lambda c: F.concat_ws("\n", c, F.col("category"))
    stored = cards(spark, sf_dir).select("card_id", F.array("status", "category").alias("points"), first(F.col("status")).alias("told"), "is_featured", F.lit(False).alias("bumped"), F.array("status", "category").alias("old_points"), "category")
    again = stored.where(key % 4 == 0)
    listed = F.when(key % 20 == 0, F.array(*[F.lit(x) for x in "wxyz"])).when(key % 8 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("old_points"))
    # by text alone where eight leaves four: the stored points are sent along unchanged
    source = again.select("card_id", listed.alias("points"), F.when((key % 8 == 4) & (key % 20 != 0), first(F.lit("new"))).otherwise(F.col("told")).alias("told"), (key % 8 == 0).alias("is_featured"))
    target = stored.select("card_id", "points", "told", "is_featured", "bumped")
    after, refused = merge.guarded_write(target, source, ["card_id"], merge.points_in_step("points", "told"), {"points": lambda v: F.size(v("points")).between(1, 3), "told": lambda v: v("told") != ""}, "bumped", F.lit(True))
    shown = lambda df, why: df.select("card_id", F.array_join("points", ";").alias("points"), "told", "is_featured", "bumped", why.alias("reasons"))
    return shown(after, F.lit("")).union(shown(refused, F.array_join("reasons", ";")))


def _sql_repeats(n: int) -> str:
    return f"""i{n} AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, i, same, i - row_number() OVER (PARTITION BY doc_id, same ORDER BY i) AS g FROM (SELECT doc_id, i, w = lead(w, {n}) OVER (PARTITION BY doc_id ORDER BY i) AS same FROM w) WHERE same) GROUP BY doc_id, g) GROUP BY doc_id)"""


@query("repeated_runs", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), 1) AS i FROM documents),
s AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), {", ".join(_sql_repeats(n) for n in (1, 2, 3, 4))},
r AS (SELECT doc_id, {", ".join(f"CAST(CASE WHEN coalesce(n, 0) >= {k} THEN coalesce(i{k}.m, 0) // {k} + 1 ELSE 0 END AS INTEGER) AS r{k}" for k in (1, 2, 3, 4))}
  FROM documents LEFT JOIN s USING (doc_id) {" ".join(f"LEFT JOIN i{k} USING (doc_id)" for k in (1, 2, 3, 4))})
SELECT *, r1 >= 6 OR r2 >= 4 OR r3 >= 4 OR r4 >= 4 AS repeats_itself FROM r""")
def repeated_runs(spark, sf_dir):
    """How often a sequence of one to four words stands in a row in each whole text, and whether that is too often."""
    counted = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", repeats.repeat_counts(F.col("text")).alias("c"))
    return counted.select("doc_id", "c.*", repeats.repeats_itself(F.col("c")).alias("repeats_itself"))


@query("verbatim_audit", rf"""WITH d AS (SELECT lang, CASE doc_id % 4 WHEN 0 THEN {_FIRST} WHEN 1 THEN 'Action: ' || {_FIRST} WHEN 2 THEN coalesce(text, '') || ' and so on' ELSE 'Official minutes record of it' END AS summary, coalesce(text, '') AS source FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS b FROM d)
SELECT lang, count(*) AS outcomes, CAST(count(*) FILTER (WHERE regexp_matches(summary, '(?i)official minutes record|motion and second|page\s+\d+\s+of\s+\d+|\baction\s*:')) AS BIGINT) AS boilerplate,
CAST(count(*) FILTER (WHERE length(a) > 20 AND length(b) > 20 AND (contains(a, b) OR contains(b, a))) AS BIGINT) AS near_verbatim FROM n GROUP BY lang""")
def verbatim_audit(spark, sf_dir):
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    summary = F.when(key % 4 == 0, _first_line()).when(key % 4 == 1, F.concat(F.lit("Action: "), _first_line())).when(key % 4 == 2, F.concat(text, F.lit(" and so on"))).otherwise("Official minutes record of it")
    told = table(spark, sf_dir, "documents", "doc_id", "lang", "text").select("lang", summary.alias("summary"), text.alias("source"))
    return told.groupBy("lang").agg(F.count("*").alias("outcomes"), F.count_if(repeats.is_boilerplate(F.col("summary"))).alias("boilerplate"), F.count_if(repeats.near_verbatim(F.col("summary"), F.col("source"))).alias("near_verbatim"))


@query("raw_documents", """WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, 0 AS nth, 'Agenda' AS type, title AS label, url AS source_url FROM t WHERE url <> '' UNION ALL SELECT page_id, 1, NULL, 'x', url || '#raw' FROM t WHERE url <> ''""")
def raw_documents(spark, sf_dir):
    """The documents inside each page's raw JSON: one by url, one whose url is a number and that has a source_url, one without any."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    raw = F.to_json(F.struct(F.array(F.struct(F.lit("Agenda").alias("type"), title.alias("label"), F.col("url").alias("url"))).alias("listed"), F.struct(F.lit("x").alias("label"), F.lit(5).alias("url"), F.concat("url", F.lit("#raw")).alias("source_url")).alias("other")))
    # the two shapes in one list, as a source would give them
    listed = F.concat(F.lit('{"documents":['), F.regexp_extract(raw, r'(?s)^\{"listed":\[(.*)\],"other":', 1), F.lit(","), F.regexp_extract(raw, r'(?s),"other":(\{.*\})\}$', 1), F.lit(',{"label":"none"},7]}'))
    return nested.raw_documents(table(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", listed.alias("raw")), "raw", ["page_id"])


@query("nested_markers", """SELECT event_type, event_id % 14 AS levels, count(*) AS events, CAST(count(*) FILTER (WHERE event_id % 14 <= 10 AND event_type <> 'error') AS BIGINT) AS rejected FROM events GROUP BY ALL""")
def nested_markers(spark, sf_dir):
    """Events whose raw JSON holds a review with an issue that is more than a warning, up to twelve levels down."""
    levels = (F.col("event_id") % 14).cast("int")
    outcome = F.when(F.col("event_type") == "error", "warning").otherwise(F.col("event_type"))
    raw = F.concat(F.repeat(F.lit("["), levels), F.lit('{"a":[{"b":'), "props", F.lit('},{"review":{"issues":[{"outcome":"warning"},3,{"outcome":"'), outcome, F.lit('"}]}}]}'), F.repeat(F.lit("]"), levels))
    told = table(spark, sf_dir, "events", "event_id", "event_type", "props").select("event_type", (F.col("event_id") % 14).alias("levels"), nested.rejected(nested.parsed(raw), "review").alias("is_rejected"))
    return told.groupBy("event_type", "levels").agg(F.count("*").alias("events"), F.count_if("is_rejected").alias("rejected"))
