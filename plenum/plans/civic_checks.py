"""Queries of searches, excerpts, grounding and translations, and of documents that belong to another day."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import grounding, highlight, text
from plenum.operators import ranking, upkeep
from plenum.plans.registry import query
from plenum.plans.roles import CARDS, MEETINGS, cards, meetings, with_roles
from plenum.sources.readers import table


@query("card_search", r"""WITH c AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages),
t AS (SELECT *, ' ' || trim(regexp_replace(strip_accents(lower(title)), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS a, ' ' || trim(regexp_replace(strip_accents(lower(url)), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS b FROM c),
m AS (SELECT * FROM t WHERE regexp_matches(a, ' [^ ]*on[^ ]* [^ ]*e[^ ]* ') OR regexp_matches(b, ' [^ ]*on[^ ]* [^ ]*e[^ ]* ')), f AS (SELECT * FROM m WHERE page_id % 4 < 3 AND contains(url, '/en/'))
SELECT page_id, title, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 12) AS BIGINT) AS pages FROM f ORDER BY page_id DESC LIMIT 12 OFFSET 12""")
def card_search(spark, sf_dir):
    """The second page of the pages that a reader searches for by the words of title or url, in one body and with one of three results; filtered first, then counted and cut."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    fits = text.token_match(F.col("title"), "On, É") | text.token_match(F.col("url"), "on e")
    found = rows.where((F.col("page_id") % 4 < 3) & F.col("url").contains("/en/") & fits)
    totals = ranking.page_totals(found, 12).first()
    return ranking.page(found.select("page_id", "title"), [F.col("page_id").desc()], 2, 12).select("*", F.lit(totals.total).alias("total"), F.lit(totals.pages).alias("pages"))


@query("search_excerpts", r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents),
p AS (SELECT *, instr(lower(c), 'es, en') AS exact, strip_accents(lower(c)) AS plain FROM d),
m AS (SELECT *, CASE WHEN exact > 0 THEN exact - 1 WHEN regexp_matches(plain, 'es[^\p{L}\p{N}]+en') THEN length(regexp_extract(plain, '(?s)^(.*?)es[^\p{L}\p{N}]+en', 1)) END AS s, CASE WHEN exact > 0 THEN 6 ELSE length(regexp_extract(plain, 'es[^\p{L}\p{N}]+en')) END AS n, length(c) AS size FROM p),
r AS (SELECT *, greatest(0, s - greatest(0, CAST(floor((180 - n) * 0.4) AS BIGINT))) AS rough FROM m WHERE s IS NOT NULL),
e AS (SELECT *, least(size, rough + 180) AS fin FROM r), b AS (SELECT *, CASE WHEN fin = size THEN greatest(0, fin - 180) ELSE rough END AS beg FROM e),
w AS (SELECT *, instr(substr(c, beg + 1), ' ') AS space, CASE WHEN contains(substr(c, 1, fin + 1), ' ') THEN length(substr(c, 1, fin + 1)) - instr(reverse(substr(c, 1, fin + 1)), ' ') END AS back FROM b),
x AS (SELECT *, CASE WHEN beg > 0 AND space > 0 AND beg + space - 1 < s THEN beg + space ELSE beg END AS begin, CASE WHEN fin < size AND back > s + n THEN back ELSE fin END AS stop FROM w)
SELECT doc_id, CASE WHEN size <= 180 THEN c ELSE CASE WHEN begin > 0 THEN '…' ELSE '' END || substr(c, begin + 1, stop - begin) || CASE WHEN stop < size THEN '…' ELSE '' END END AS excerpt FROM x""")
def search_excerpts(spark, sf_dir):
    # a filter beside the projection would make each excerpt twice
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_compact(F.array(highlight.excerpt(F.col("text"), "Es, En")))).alias("excerpt"))


_CLAIMS = r"list_sort(list_transform(regexp_extract_all({}, '[$€£¥]?\s*\d+(?:[.,]\d+)*(?:\s*%)?'), lambda c: regexp_extract(c, '[$€£¥]') || array_to_string(regexp_extract_all(c, '\d+'), ':') || CASE WHEN contains(c, '%') THEN '%' ELSE '' END))"
_TRANSLATED = """CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN replace(text, '1', '2') WHEN 2 THEN NULL WHEN 3 THEN text || ' public hearing' WHEN 4 THEN '$5 ' || text ELSE 'Nota: ' || text END"""
_ENGLISH = (
    r"(?i)\b(?:the official|this item|motion and second|to approve|passed(?: unanimously)?|no action(?: taken)?|city council|public hearing|informational items?|regular meeting|approved minutes|staff report|"
    r"commissioners voted|council directed staff|linked staff report context|subject to the provisions)\b"
)


@query("translation_issues", rf"""WITH d AS (SELECT doc_id, text AS s, {_TRANSLATED} AS t, CAST(n_chars % 9 AS VARCHAR) || '-' || CAST(doc_id % 3 AS VARCHAR) AS v FROM documents),
k AS (SELECT *, s IS NOT NULL AND t IS NOT NULL AND trim(t) <> '' AS there, lower(regexp_replace(trim(s), '\s+', ' ', 'g')) = lower(regexp_replace(trim(t), '\s+', ' ', 'g')) AS same FROM d)
SELECT doc_id, concat_ws('; ', CASE WHEN s IS NULL AND t IS NOT NULL THEN 'summary changed a null source value' END, CASE WHEN s IS NOT NULL AND (t IS NULL OR trim(t) = '') THEN 'summary was omitted' END,
CASE WHEN there AND {_CLAIMS.format("s")} <> {_CLAIMS.format("t")} THEN 'summary changed numeric claims' END, CASE WHEN there AND same THEN 'summary was left in English' END,
CASE WHEN there AND NOT same AND regexp_matches(t, '{_ENGLISH}') THEN 'summary contains untranslated English' END) AS issues FROM k""")
def translation_issues(spark, sf_dir):
    """What is wrong with made translations of whole texts; votes in numbers may stay as they are."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    told = docs.select("doc_id", F.col("text").alias("s"), F.expr(_TRANSLATED).alias("t"), F.concat_ws("-", (F.col("n_chars") % 9).cast("string"), (F.col("doc_id") % 3).cast("string")).alias("v"))
    return told.select("doc_id", F.array_join(grounding.translation_issues({"summary": (F.col("s"), F.col("t")), "vote": (F.col("v"), F.col("v"))}), "; ").alias("issues"))


@query("ungrounded_values")
def ungrounded_values(spark, sf_dir):
    """Amounts and days that a summary states and the whole text doesn't; no SQL, tests compare with plain Python."""
    key = F.col("doc_id")
    summary = F.concat(F.lit("Approve $"), (key % 7 + 1).cast("string"), F.lit(".5 million for "), (key % 50).cast("string"), F.lit(" acres by March "), (key % 28 + 1).cast("string"), F.lit(", 2026"))
    source = F.concat(F.coalesce("text", F.lit("")), F.when(key % 2 == 0, F.concat(F.lit(" $"), (key % 7 + 1).cast("string"), F.lit(",500,000; "), (key % 50).cast("string"), F.lit(" ac."))).otherwise(""), F.when(key % 3 == 0, F.concat(F.lit(" on 3/"), (key % 28 + 1).cast("string"), F.lit("/2026"))).otherwise(""))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(grounding.ungrounded(summary, source), "; ").alias("ungrounded"))


@query("leaked_documents", """WITH l AS (SELECT l_orderkey AS meeting, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN l_partkey % 3 > 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END || '/' || (l_suppkey % 5) AS url FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT url FROM l GROUP BY url HAVING count(DISTINCT day) > 1), t AS (SELECT l.*, url IN (SELECT url FROM s) AND url NOT LIKE '/%' AND left(url, 10) <> day AS leaks FROM l)
SELECT day, count(*) AS links, CAST(count(*) FILTER (WHERE leaks) AS BIGINT) AS leaked FROM t GROUP BY day""")
def leaked_documents(spark, sf_dir):
    """Links of lines whose url names the day it was shipped, from orders of that and of other days."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").withColumn("meeting", F.col("l_orderkey")).join(orders, "meeting")
    url = F.concat(F.when(F.col("l_partkey") % 3 > 0, day("l_shipdate")).otherwise(""), F.lit("/"), (F.col("l_suppkey") % 5).cast("string"))
    links = lines.select("meeting", F.when(F.col("l_linenumber") % 2 == 0, day("l_shipdate")).otherwise(day("o_orderdate")).alias("day"), url.alias("url"))
    named = F.nullif(F.regexp_extract("url", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    stay, leak = upkeep.without_leaked(links, "meeting", "day", "url", named)
    both = stay.select("day", F.lit(0).alias("leaks")).union(leak.select("day", F.lit(1)))
    return both.groupBy("day").agg(F.count("*").alias("links"), F.sum("leaks").alias("leaked"))


@query("folded_releases", with_roles("""SELECT owner AS card_id, n AS documents, t AS row_text FROM (SELECT r.owner, count(DISTINCT d) AS n, string_agg(t, ' ' ORDER BY k) AS t FROM (
SELECT coalesce(g.owner, c.card_id) AS owner, c.card_id <> coalesce(g.owner, c.card_id) AS later, c.card_id, c.category AS d, c.status || c.card_id AS t, (CASE WHEN c.card_id <> coalesce(g.owner, c.card_id) THEN 1 ELSE 0 END, c.card_id) AS k FROM cards c LEFT JOIN
(SELECT meeting_id, month(sort_at) AS m, max(card_id) AS owner FROM cards WHERE status <> 'P' AND category < '3' GROUP BY ALL) g ON g.meeting_id = c.meeting_id AND g.m = month(c.sort_at) AND c.status = 'P') r GROUP BY r.owner)""", CARDS))
def folded_releases(spark, sf_dir):
    """Pending cards as early releases: each goes into the last urgent one of its customer and month that isn't pending."""
    rows = cards(spark, sf_dir).select("card_id", "meeting_id", F.month("sort_at").alias("m"), (F.col("status") == "P").alias("early"), (F.col("category") < "3").alias("agenda"), F.array("category").alias("docs"), F.concat("status", F.col("card_id").cast("string")).alias("row_text"))
    out = upkeep.folded_releases(rows, ["meeting_id", "m"], "card_id", F.col("early"), F.col("agenda"), "docs", "row_text")
    return out.select("card_id", F.size("docs").cast("long").alias("documents"), "row_text")


@query("union_by_id", with_roles("""SELECT id, name FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY n, name) AS r FROM (SELECT meeting_id AS id, body AS name, 0 AS n FROM meetings WHERE jurisdiction % 2 = 0
UNION ALL SELECT meeting_id, title, 1 FROM meetings WHERE jurisdiction % 3 = 0 UNION ALL SELECT meeting_id, status, 2 FROM cards)) WHERE r = 1""", CARDS, MEETINGS))
def union_by_id(spark, sf_dir):
    """Three shards with the same ids: the first that has one gives its row."""
    m = meetings(spark, sf_dir)
    shards = [m.where("jurisdiction % 2 = 0").select(F.col("meeting_id").alias("id"), F.col("body").alias("name")), m.where("jurisdiction % 3 = 0").select(F.col("meeting_id").alias("id"), F.col("title").alias("name"))]
    return upkeep.union_by_id([*shards, cards(spark, sf_dir).select(F.col("meeting_id").alias("id"), F.col("status").alias("name"))], "id")
