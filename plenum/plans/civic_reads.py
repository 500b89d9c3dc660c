"""Read queries: pages, searches, pools, matches, coverage, digests, over the tables in their civic roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions import civic_time, text
from plenum.operators import aggregates, joins, matching, ranking
from plenum.plans.registry import query
from plenum.plans.roles import CARDS, ITEMS, MEETINGS, cards, items, meetings, with_roles
from plenum.sources.readers import table

NOW = "1999-06-15 19:00:00"
_ORDER = "is_featured DESC, sort_at DESC, card_id DESC"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _now():
    return F.lit(NOW).cast("timestamp")


def _order():
    return ranking.decision_order("is_featured", "sort_at", "sort_at", "card_id")


def _shown(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("decision_page", with_roles(f"""SELECT card_id, title, jurisdiction, is_featured, {TS.format("sort_at")} AS sort_at FROM cards LEFT JOIN meetings USING (meeting_id)
WHERE is_published ORDER BY {_ORDER} LIMIT 12 OFFSET 24""", CARDS, MEETINGS))
def decision_page(spark, sf_dir):
    page = ranking.page(cards(spark, sf_dir).where("is_published"), _order(), 3, 12)
    # the page is cut first, so that only its rows look for their meetings
    return page.join(meetings(spark, sf_dir), "meeting_id", "left").select("card_id", "title", "jurisdiction", "is_featured", _shown("sort_at").alias("sort_at"))


@query("page_totals", with_roles("SELECT count(*) AS total, CAST(ceil(count(*) / 12.0) AS BIGINT) AS pages FROM cards WHERE is_published", CARDS))
def page_totals(spark, sf_dir):
    return ranking.page_totals(cards(spark, sf_dir).where("is_published"), 12)


@query("federated_top", with_roles(f"""SELECT card_id, r_name AS shard FROM cards JOIN meetings USING (meeting_id) JOIN nation ON n_nationkey = jurisdiction JOIN region ON r_regionkey = n_regionkey
WHERE is_published ORDER BY {_ORDER} LIMIT 20""", CARDS, MEETINGS))
def federated_top(spark, sf_dir):
    """Shards (regions) read as one table; one global top-k replaces a page from each."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    places = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    everything = cards(spark, sf_dir).where("is_published").join(meetings(spark, sf_dir), "meeting_id").join(places, F.col("jurisdiction") == F.col("n_nationkey"))
    return everything.orderBy(*_order()).limit(20).select("card_id", F.col("r_name").alias("shard"))


@query("published_count", with_roles("SELECT count(*) AS published FROM cards WHERE is_published", CARDS))
def published_count(spark, sf_dir):
    return cards(spark, sf_dir).where("is_published").agg(F.count("*").alias("published"))


@query("public_stats", with_roles("""SELECT jurisdiction, count(*) FILTER (WHERE is_published) AS published, count(*) FILTER (WHERE is_featured) AS featured,
count(*) FILTER (WHERE status = 'O') AS open_cards, count(DISTINCT meeting_id) FILTER (WHERE is_published) AS meetings FROM cards JOIN meetings USING (meeting_id) GROUP BY jurisdiction""", CARDS, MEETINGS))
def public_stats(spark, sf_dir):
    return cards(spark, sf_dir).join(meetings(spark, sf_dir), "meeting_id").groupBy("jurisdiction").agg(
        F.count_if("is_published").alias("published"), F.count_if("is_featured").alias("featured"), F.count_if(F.col("status") == "O").alias("open_cards"),
        F.count_distinct(F.when(F.col("is_published"), F.col("meeting_id"))).alias("meetings"),
    )


@query("result_freshness", with_roles(f"""SELECT n_nationkey AS jurisdiction, {TS.format("latest")} AS latest FROM nation LEFT JOIN (
SELECT jurisdiction AS j, max(sort_at) AS latest FROM cards JOIN meetings USING (meeting_id) WHERE status = 'F' AND is_featured GROUP BY 1) ON j = n_nationkey""", CARDS, MEETINGS))
def result_freshness(spark, sf_dir):
    facts = cards(spark, sf_dir).where("status = 'F' AND is_featured").join(meetings(spark, sf_dir), "meeting_id").groupBy("jurisdiction").agg(F.max("sort_at").alias("latest"))
    all_of = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("jurisdiction"))
    return aggregates.filled(all_of, facts, "jurisdiction").select("jurisdiction", _shown("latest").alias("latest"))


@query("upcoming_snapshot", with_roles(f"""SELECT jurisdiction, count(*) FILTER (WHERE status = 'O') AS open_for_comment, {TS.format("min(sort_at)")} AS next_at
FROM cards JOIN meetings USING (meeting_id) WHERE is_published AND sort_at >= TIMESTAMP '{NOW}' GROUP BY jurisdiction""", CARDS, MEETINGS))
def upcoming_snapshot(spark, sf_dir):
    ahead = cards(spark, sf_dir).where(F.col("is_published") & (F.col("sort_at") >= _now())).join(meetings(spark, sf_dir), "meeting_id")
    return ahead.groupBy("jurisdiction").agg(F.count_if(F.col("status") == "O").alias("open_for_comment"), F.date_format(F.min("sort_at"), "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query("category_cards", """SELECT p_partkey, p_name FROM part WHERE list_contains([p_type, p_brand], 'Brand#13') ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 25""")
def category_cards(spark, sf_dir):
    tagged = table(spark, sf_dir, "part").withColumn("tags", F.array("p_type", "p_brand"))
    return tagged.where(F.array_contains("tags", "Brand#13")).orderBy(F.desc("p_retailprice"), F.desc("p_partkey")).limit(25).select("p_partkey", "p_name")


@query("tag_contained_by", "SELECT p_brand, count(*) AS parts FROM part WHERE len(list_filter([p_type, p_brand], lambda t: NOT list_contains(['PROMO', 'Brand#11', 'ECONOMY', 'Brand#12', p_type], t))) = 0 GROUP BY p_brand")
def tag_contained_by(spark, sf_dir):
    allowed = F.array(*[F.lit(x) for x in ("PROMO", "Brand#11", "ECONOMY", "Brand#12")], F.col("p_type"))
    fits = F.size(F.array_except(F.array("p_type", "p_brand"), allowed)) == 0
    return table(spark, sf_dir, "part").where(fits).groupBy("p_brand").agg(F.count("*").alias("parts"))


@query("text_search_cards", with_roles("""SELECT card_id FROM cards LEFT JOIN meetings USING (meeting_id) WHERE is_published AND (category ILIKE '%urgent%' OR status ILIKE 'x%' OR meeting_id IN (SELECT meeting_id FROM meetings WHERE title ILIKE '%00012%'))""", CARDS, MEETINGS))
def text_search_cards(spark, sf_dir):
    named = meetings(spark, sf_dir).where(F.col("title").ilike(text.ilike_pattern("00012"))).select("meeting_id", F.lit(True).alias("is_named"))
    found = cards(spark, sf_dir).where("is_published").join(named, "meeting_id", "left")
    return found.where(F.col("category").ilike("%urgent%") | F.col("status").ilike("x%") | F.coalesce("is_named", F.lit(False))).select("card_id")


_NORM = "list_filter(string_split(trim(regexp_replace(lower(strip_accents(nfc_normalize({}))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '')"


@query("token_search", f"""WITH t AS (SELECT conv_id, turn, {_NORM.format("text")} AS ts FROM conversations)
SELECT conv_id, turn FROM t WHERE len(list_filter(generate_series(1, len(ts)), lambda i: contains(ts[i], 'th') AND contains(coalesce(ts[i + 1], ''), 'an'))) > 0""")
def token_search(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(text.token_match(F.col("text"), "Th an")).select("conv_id", "turn")


@query("json_path_filter", "SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3, 5, 8, 13) GROUP BY event_type")
def json_path_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").withColumn("k", k).where(F.col("k").isin(1, 2, 3, 5, 8, 13)).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("total"))


@query("awaiting_result", with_roles(f"""SELECT jurisdiction, count(*) AS awaiting FROM cards JOIN meetings USING (meeting_id) WHERE is_published AND sort_at < TIMESTAMP '{NOW}'
AND NOT EXISTS (SELECT 1 FROM items WHERE items.card_id = cards.card_id AND flag = 'R') GROUP BY jurisdiction""", CARDS, MEETINGS, ITEMS))
def awaiting_result(spark, sf_dir):
    past = cards(spark, sf_dir).where(F.col("is_published") & (F.col("sort_at") < _now()))
    awaiting = past.join(items(spark, sf_dir).where("flag = 'R'"), "card_id", "left_anti")
    return awaiting.join(meetings(spark, sf_dir), "meeting_id").groupBy("jurisdiction").agg(F.count("*").alias("awaiting"))


@query("active_window", with_roles(f"""SELECT status, count(*) AS active FROM (SELECT status, meeting_id, CASE WHEN is_featured THEN NULL ELSE sort_at END AS s, CASE WHEN status = 'O' THEN NULL ELSE sort_at + INTERVAL 90 DAY END AS e FROM cards)
WHERE (s IS NULL OR s <= TIMESTAMP '{NOW}') AND (e IS NULL OR e >= TIMESTAMP '{NOW}') AND (meeting_id % 5 = 0 OR meeting_id % 7 = 3) GROUP BY status""", CARDS))
def active_window(spark, sf_dir):
    spans = cards(spark, sf_dir).withColumns({"s": F.when(~F.col("is_featured"), F.col("sort_at")), "e": F.when(F.col("status") != "O", F.col("sort_at") + F.expr("INTERVAL 90 DAYS"))})
    scope = (F.col("meeting_id") % 5 == 0) | (F.col("meeting_id") % 7 == 3)  # global, or of the asking jurisdiction
    return spans.where(civic_time.active_between(F.col("s"), F.col("e"), _now()) & scope).groupBy("status").agg(F.count("*").alias("active"))


@query("month_window", with_roles("""SELECT count(*) AS cards, min(card_id) AS first_card, max(card_id) AS last_card FROM cards WHERE sort_at >= TIMESTAMP '1999-05-01 07:00:00' AND sort_at < TIMESTAMP '1999-08-01 07:00:00'""", CARDS))
def month_window(spark, sf_dir):
    inside = cards(spark, sf_dir).where(civic_time.in_month_window(F.col("sort_at"), _now()))
    return inside.agg(F.count("*").alias("cards"), F.min("card_id").alias("first_card"), F.max("card_id").alias("last_card"))


@query("published_parent_semi", with_roles("SELECT body, count(*) AS meetings FROM meetings WHERE meeting_id IN (SELECT meeting_id FROM cards WHERE is_published AND is_featured) GROUP BY body", CARDS, MEETINGS))
def published_parent_semi(spark, sf_dir):
    with_cards = meetings(spark, sf_dir).join(cards(spark, sf_dir).where("is_published AND is_featured"), "meeting_id", "left_semi")
    return with_cards.groupBy("body").agg(F.count("*").alias("meetings"))


@query("nested_children", with_roles("""SELECT meeting_id, coalesce(n, 0) AS children, coalesce(firsts, '') AS card_ids FROM meetings LEFT JOIN (SELECT meeting_id AS m, count(*) AS n, string_agg(CAST(card_id AS VARCHAR), ',' ORDER BY card_id) AS firsts
FROM cards WHERE is_published GROUP BY 1) ON m = meeting_id""", CARDS, MEETINGS))
def nested_children(spark, sf_dir):
    kids = cards(spark, sf_dir).where("is_published").select("meeting_id", "card_id", "status")
    nested = joins.nested_children(meetings(spark, sf_dir), kids, "meeting_id", "meeting_id", ["card_id", "status"], "cards")
    ids = F.array_join(F.transform("cards", lambda c: c["card_id"].cast("string")), ",")
    return nested.select("meeting_id", F.size("cards").cast("long").alias("children"), ids.alias("card_ids"))


@query("overlay_fingerprint", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN lower(p_type) ELSE p_type END AS p_type, p_partkey % 3 = 0 AS is_translated FROM part""")
def overlay_fingerprint(spark, sf_dir):
    """Every third part has a fresh translation, of which odd sizes lack a type; the next third has a stale one."""
    base = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    made = base.where("p_partkey % 3 < 2").select(
        "p_partkey", F.lit("es").alias("locale"), F.when(F.col("p_partkey") % 2 == 0, "machine").otherwise("reviewed").alias("translation_status"),
        F.when(F.col("p_partkey") % 3 == 0, joins.fingerprint(F.col("p_name"), F.col("p_type"))).otherwise(F.lit("stale")).alias("source_fingerprint"),
        F.upper("p_name").alias("p_name"), F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.lit(" ")).alias("p_type"),
    )
    return joins.overlay_translation(base, made, "p_partkey", ["p_name", "p_type"], "es").drop("p_size")


@query("stale_translations", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def stale_translations(spark, sf_dir):
    base = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    fresh = F.when(F.col("p_partkey") % 3 == 0, joins.fingerprint(F.col("p_name"), F.col("p_type"))).otherwise(F.lit("stale"))
    made = base.where("p_partkey % 3 < 2").select("p_partkey", F.lit("es").alias("locale"), fresh.alias("source_fingerprint"))
    return joins.stale_translations(base, made, "p_partkey", ["p_name", "p_type"], "es").select("p_partkey")


@query("outcome_overlay", with_roles(f"""SELECT card_id, n AS outcomes, {TS.format("d")} AS decided_at FROM cards LEFT JOIN (SELECT card_id AS c, count(*) AS n, max(shipped) AS d FROM items WHERE flag = 'R' GROUP BY 1) ON c = card_id WHERE is_published""", CARDS, ITEMS))
def outcome_overlay(spark, sf_dir):
    results = items(spark, sf_dir).where("flag = 'R'").groupBy("card_id").agg(F.count("*").alias("outcomes"), F.max("shipped").alias("decided"))
    return cards(spark, sf_dir).where("is_published").join(results, "card_id", "left").select("card_id", "outcomes", _shown("decided").alias("decided_at"))


@query("adjacent_meetings", with_roles("""SELECT card_id, lag(card_id) OVER w AS older, lead(card_id) OVER w AS newer FROM cards WINDOW w AS (PARTITION BY meeting_id ORDER BY sort_at, card_id)""", CARDS))
def adjacent_meetings(spark, sf_dir):
    return joins.adjacent(cards(spark, sf_dir), ["meeting_id"], "sort_at", "card_id").select("card_id", "older", "newer")


@query("duplicate_pairs", """WITH p AS (SELECT *, p_partkey % 4 = 0 AS bad, lower(CASE WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_brand ELSE p_name END) AS t FROM part)
SELECT duplicate, canonical FROM (SELECT a.p_partkey AS duplicate, b.p_partkey AS canonical, row_number() OVER (PARTITION BY a.p_partkey ORDER BY length(b.t) DESC, b.p_partkey) AS r
FROM p a JOIN p b ON a.p_size = b.p_size AND a.bad AND NOT b.bad AND contains(a.t, b.t)) WHERE r = 1""")
def duplicate_pairs(spark, sf_dir):
    bad = F.col("p_partkey") % 4 == 0
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size").withColumn("title", F.when(bad, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name")))
    return joins.duplicate_pairs(parts, "p_partkey", ["p_size"], "title", bad)


@query("guarded_match", f"""WITH l AS (SELECT p_partkey AS lk, p_brand AS b, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT p_partkey AS rk, p_brand AS b, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part WHERE p_partkey % 2 = 1),
n AS (SELECT lk, rk, len(list_intersect(l.t, r.t)) AS c, list_sort(list_filter(l.t, lambda x: regexp_full_match(x, '[0-9]+'))) AS ln, list_sort(list_filter(r.t, lambda x: regexp_full_match(x, '[0-9]+'))) AS rn,
  len(list_intersect(l.t, r.t)) / least(len(l.t), len(r.t)) AS s FROM l JOIN r USING (b)),
k AS (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY s DESC, rk) AS p, lead(s) OVER (PARTITION BY lk ORDER BY s DESC, rk) AS nx FROM n WHERE c > 0 AND NOT (len(ln) > 0 AND len(rn) > 0 AND ln <> rn))
SELECT lk AS left_id, rk AS right_id, s AS score FROM k WHERE p = 1 AND s >= 0.6 AND c >= 2 AND s - coalesce(nx, 0.0) >= 0.15""")
def guarded_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("b"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tokens"))
    left, right = parts.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "left_id"), parts.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "right_id")
    return matching.guarded_match(left, right, ["b"], "left_id", "right_id", least=0.6, shared=2)


@query("best_item", """WITH l AS (SELECT p_partkey AS lk, p_brand AS b, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT p_partkey AS rk, p_brand AS b, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part WHERE p_partkey % 2 = 1),
n AS (SELECT lk, rk, len(list_intersect(l.t, r.t)) / least(len(l.t), len(r.t)) AS s FROM l JOIN r USING (b))
SELECT lk AS left_id, rk AS right_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY s DESC, rk) AS p FROM n WHERE s >= 0.4) WHERE p = 1""")
def best_item(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("b"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tokens"))
    left, right = parts.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "left_id"), parts.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "right_id")
    return matching.best_match(left, right, ["b"], "left_id", "right_id", least=0.4)


@query("archive_attach_unique", with_roles("""SELECT card_id, sole AS archive_id FROM cards LEFT JOIN (SELECT m, d, min(s) AS sole FROM (SELECT meeting_id AS m, CAST(sort_at AS DATE) AS d, card_id AS s FROM cards WHERE status = 'F') GROUP BY m, d HAVING count(*) = 1) ON m = meeting_id AND d = CAST(sort_at AS DATE)
AND (meeting_id, CAST(sort_at AS DATE)) IN (SELECT (meeting_id, CAST(sort_at AS DATE)) FROM cards WHERE status <> 'F' GROUP BY meeting_id, CAST(sort_at AS DATE) HAVING count(*) = 1) WHERE status <> 'F'""", CARDS))
def archive_attach_unique(spark, sf_dir):
    dated = cards(spark, sf_dir).withColumn("day", F.to_date("sort_at"))
    return joins.unique_match(dated.where("status <> 'F'"), dated.where("status = 'F'"), ["meeting_id", "day"], "card_id", "archive_id").select("card_id", "archive_id")


@query("uncovered_items", with_roles("SELECT count(*) AS uncovered, min(card_id) AS first_card FROM cards WHERE is_published AND NOT EXISTS (SELECT 1 FROM items WHERE items.card_id = cards.card_id AND quantity > 40)", CARDS, ITEMS))
def uncovered_items(spark, sf_dir):
    open_cards = cards(spark, sf_dir).where("is_published").join(items(spark, sf_dir).where("quantity > 40"), "card_id", "left_anti")
    return open_cards.agg(F.count("*").alias("uncovered"), F.min("card_id").alias("first_card"))


@query("interest_totals", f"SELECT user_id, event_type, count(*) AS signals, {TS.format('max(ts)')} AS latest FROM events GROUP BY user_id, event_type")
def interest_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("signals"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("coverage_pct", "SELECT lang, count(*) AS documents, count(quality) AS labelled, floor(count(quality) * 1000.0 / count(*) + 0.5) / 10 AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage_pct(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    counted = labelled.groupBy("lang").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"))
    return counted.withColumn("percent", aggregates.percentage(F.col("labelled"), F.col("documents")))


@query("histogram", "SELECT source, lang, count(*) AS documents FROM documents GROUP BY source, lang")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents", "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("documents"))


@query("unique_keys", with_roles("SELECT card_id, number FROM items GROUP BY card_id, number HAVING count(*) = 1", ITEMS))
def unique_keys(spark, sf_dir):
    return aggregates.occurring_once(items(spark, sf_dir).select("card_id", "number"), ["card_id", "number"])


_TIE = "part, supplier, quantity, price, flag, shipped"


@query("first_wins_dedupe", with_roles(f"SELECT card_id, number, part, supplier FROM (SELECT *, row_number() OVER (PARTITION BY card_id, number ORDER BY {_TIE}) AS r FROM items) WHERE r = 1", ITEMS))
def first_wins_dedupe(spark, sf_dir):
    return aggregates.first_wins(items(spark, sf_dir), ["card_id", "number"], [F.col(c) for c in _TIE.split(", ")]).select("card_id", "number", "part", "supplier")


@query("merge_group", """WITH d AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN source END AS s FROM documents)
SELECT lang, arg_min(s, doc_id) FILTER (WHERE s IS NOT NULL) AS s, md5((arg_min({'t': text}, {'n': -length(text), 'o': doc_id})).t) AS longest, bool_or(doc_id % 100 = 7) AS flagged, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS merged_rows FROM d GROUP BY lang""")
def merge_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"s": F.when(F.col("doc_id") % 3 > 0, F.col("source")), "flagged": F.col("doc_id") % 100 == 7})
    merged = aggregates.merge_group(docs, ["lang"], "doc_id", first=["s"], longest=["text"], flags=["flagged"], union=["source"])
    return merged.select("lang", "s", F.md5(F.col("text").cast("binary")).alias("longest"), "flagged", F.array_join("source", ",").alias("sources"), "merged_rows")


@query("duplicate_plan", with_roles("""WITH k AS (SELECT *, is_featured AS o FROM cards), g AS (SELECT meeting_id, category, count(*) AS copies, arg_max(card_id, {'s': sort_at, 'c': card_id}) AS survivor, count(*) FILTER (WHERE status = 'P') AS outcomes, max(CASE WHEN status = 'P' THEN card_id END) AS outcome_row FROM k GROUP BY ALL)
SELECT *, outcomes > 1 AS is_ambiguous, outcomes <= 1 AND coalesce(outcome_row <> survivor, FALSE) AS moves_outcome FROM g WHERE copies > 1""", CARDS).replace("\nWITH k", ",\nk", 1))
def duplicate_plan(spark, sf_dir):
    return aggregates.duplicate_plan(cards(spark, sf_dir).withColumn("has_outcome", F.col("status") == "P"), ["meeting_id", "category"], "card_id", "sort_at", "has_outcome")


@query("canonical_assignment", with_roles("""SELECT part AS item, card AS card_id FROM (SELECT part, card, n, o, lowest, m, row_number() OVER (PARTITION BY part ORDER BY seen_at, card) AS bt, row_number() OVER b AS br, rk, sc, lead(rk) OVER b AS nr, lead(sc) OVER b AS ns
FROM (SELECT part, card_id * 10 + number AS card, flag <> 'R' AS m, CAST(quantity % 5 AS INTEGER) AS rk, quantity / 50.0 AS sc, shipped AS seen_at, count(*) OVER (PARTITION BY part) AS n, sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY part) AS o, min(CAST(quantity % 5 AS INTEGER)) OVER (PARTITION BY part) AS lowest
FROM (SELECT DISTINCT * FROM items)) WINDOW b AS (PARTITION BY part ORDER BY rk DESC, sc DESC, card)) WHERE CASE WHEN n = 1 THEN TRUE WHEN o = 1 THEN NOT m WHEN lowest = 4 THEN bt = 1 ELSE coalesce(br = 1 AND (nr < rk OR sc - ns >= 0.15), FALSE) END""", ITEMS))
def canonical_assignment(spark, sf_dir):
    proposals = items(spark, sf_dir).distinct().select(
        F.col("part").alias("item"), (F.col("card_id") * 10 + F.col("number")).alias("card_id"), (F.col("flag") != "R").alias("is_minutes"), (F.col("quantity") % 5).cast("int").alias("rank"), (F.col("quantity") / 50.0).alias("score"), "shipped"
    )
    return aggregates.canonical_assignment(proposals, "item", "card_id", "is_minutes", "rank", "score", "shipped")


@query("ingestion_gate", with_roles("""SELECT card_id, count(DISTINCT part) AS documents, bool_and(flag = 'R') AS all_failed, NOT bool_or(flag <> 'R' AND quantity >= 10) AS none_usable FROM items GROUP BY card_id HAVING NOT bool_or(flag <> 'R' AND quantity >= 10)""", ITEMS))
def ingestion_gate(spark, sf_dir):
    """A card's documents, counted by url once: it fails if none of them is usable."""
    usable = (F.col("flag") != "R") & (F.col("quantity") >= 10)
    gates = items(spark, sf_dir).groupBy("card_id").agg(F.count_distinct("part").alias("documents"), F.bool_and(F.col("flag") == "R").alias("all_failed"), (~F.bool_or(usable)).alias("none_usable"))
    return gates.where("none_usable")


@query("problem_report", """SELECT problems, count(*) AS documents FROM (SELECT array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '$$$') THEN 'corrupt' END, CASE WHEN length(text) - length(replace(text, chr(10), '')) > 50 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents) GROUP BY problems""")
def problem_report(spark, sf_dir):
    body = F.col("text")
    checks = {"short": F.col("n_chars") < 200, "corrupt": F.contains(body, F.lit("$$$")), "long": F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) > 50}
    found = aggregates.problems(table(spark, sf_dir, "documents"), checks)
    return found.groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count("*").alias("documents"))


@query("civic_day_calendar", "SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS civic_day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def civic_day_calendar(spark, sf_dir):
    day = F.date_format(civic_time.civic_day(F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    return table(spark, sf_dir, "events", "ts", "event_type").groupBy(day.alias("civic_day"), "event_type").agg(F.count("*").alias("events"))


@query("pool_per_jurisdiction", with_roles(f"SELECT jurisdiction, card_id, CAST(r AS INTEGER) AS rank_in_group FROM (SELECT jurisdiction, card_id, row_number() OVER (PARTITION BY jurisdiction ORDER BY {_ORDER}) AS r FROM cards JOIN meetings USING (meeting_id) WHERE is_published) WHERE r <= 40", CARDS, MEETINGS))
def pool_per_jurisdiction(spark, sf_dir):
    joined = cards(spark, sf_dir).where("is_published").join(meetings(spark, sf_dir), "meeting_id")
    return ranking.top_per_group(joined, ["jurisdiction"], _order(), ranking.pool_size(25)).select("jurisdiction", "card_id", "rank_in_group")


@query("diverse_top", with_roles(f"SELECT card_id, meeting_id, r > 2 AS deferred FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY {_ORDER}) AS r FROM cards WHERE is_published) ORDER BY r > 2, {_ORDER} LIMIT 50", CARDS))
def diverse_top(spark, sf_dir):
    return ranking.diverse_top(cards(spark, sf_dir).where("is_published"), "meeting_id", "card_id", _order(), 50).select("card_id", "meeting_id", "deferred")


@query("quota_mix", with_roles(f"SELECT card_id, is_result FROM (SELECT *, status = 'P' AS is_result, row_number() OVER (PARTITION BY status = 'P' ORDER BY {_ORDER}) AS r FROM cards) WHERE r <= 15", CARDS))
def quota_mix(spark, sf_dir):
    return ranking.quota_mix(cards(spark, sf_dir), F.col("status") == "P", _order(), 30).select("card_id", "is_result")


@query("group_round_robin", with_roles(f"SELECT card_id, category, r > 1 AS is_extra FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS r FROM cards WHERE is_published) ORDER BY r > 1, {_ORDER} LIMIT 20", CARDS))
def group_round_robin(spark, sf_dir):
    return ranking.group_round_robin(cards(spark, sf_dir).where("is_published"), "category", _order(), 20).select("card_id", "category", "is_extra")


@query("gap_clusters", "SELECT user_id, CAST(c AS BIGINT) AS cluster, CAST(min(t) AS BIGINT) AS first_s, CAST(max(t) AS BIGINT) AS last_s, count(*) AS members FROM (SELECT user_id, t, sum(CASE WHEN t - p <= 7200 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS c FROM (SELECT user_id, event_id, floor(epoch(ts)) AS t, lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS p FROM events)) GROUP BY user_id, c")
def gap_clusters(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")
    clusters = aggregates.gap_clusters(table(spark, sf_dir, "events").select("user_id", seconds), ["user_id"], "at", 7200)
    return clusters.select("user_id", F.col("cluster").cast("long").alias("cluster"), F.col("first").cast("long").alias("first_s"), F.col("last").cast("long").alias("last_s"), "members")


@query("capped_children", with_roles("SELECT meeting_id, count(*) AS children, count(*) FILTER (WHERE status = 'O' AND k <= 4) AS selected FROM (SELECT meeting_id, status, sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY sort_at, card_id) AS k FROM cards) GROUP BY meeting_id", CARDS))
def capped_children(spark, sf_dir):
    marked = ranking.capped_children(cards(spark, sf_dir), ["meeting_id"], F.col("status") == "O", [F.col("sort_at"), F.col("card_id")], cap=4)
    return marked.groupBy("meeting_id").agg(F.count("*").alias("children"), F.count_if("selected").alias("selected"))


@query("hash_sample", """SELECT c_custkey, h AS sample_hash FROM (SELECT c_custkey, c_name, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM customer) ORDER BY h, c_name LIMIT 40""")
def hash_sample(spark, sf_dir):
    return ranking.hash_sample(table(spark, sf_dir, "customer", "c_custkey", "c_name"), F.col("c_name"), 40).select("c_custkey", "sample_hash")


@query("source_priority_pick", with_roles(f"SELECT card_id, part FROM (SELECT card_id, part, row_number() OVER (PARTITION BY card_id ORDER BY quantity >= 20 DESC, CASE WHEN quantity >= 20 THEN CASE flag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END END ASC, number, {_TIE}) AS r FROM items) WHERE r = 1", ITEMS))
def source_priority_pick(spark, sf_dir):
    priority = F.when(F.col("flag") == "N", 0).when(F.col("flag") == "A", 1).otherwise(2)
    order = [F.col(c) for c in ("number", *_TIE.split(", "))]
    return ranking.first_by_priority(items(spark, sf_dir), ["card_id"], priority, F.col("quantity") >= 20, order).select("card_id", "part")


@query("money_score", """WITH t AS (SELECT o_orderkey AS card_id, a, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' thousand' WHEN 2 THEN 'M' ELSE ' billion' END AS u FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS a FROM orders)),
d AS (SELECT card_id, a * CASE card_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1e9 END AS dollars FROM t)
SELECT card_id, CAST(dollars AS DOUBLE) AS dollars, CASE WHEN dollars < 1000 THEN 0 ELSE CAST(least(26, greatest(0, floor((log10(dollars) - 3) * 4 + 4.5))) AS INTEGER) END AS score FROM d""")
def money_score(spark, sf_dir):
    unit = F.element_at(F.array(F.lit(""), F.lit(" thousand"), F.lit("M"), F.lit(" billion")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    told = F.concat(F.lit("Award of $5 and $"), F.format_number(F.floor("o_totalprice"), 0), unit, F.lit(" to a bidder"))
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card_id"), told.alias("told"))
    return texts.select("card_id", text.largest_dollars(F.col("told")).alias("dollars"), text.money_score(F.col("told")).alias("score"))


@query("html_to_text", """WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|table|ul|ol)\\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t\\r\\f\\x{A0}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{2,}', chr(10), 'g') AS t FROM c)
SELECT page_id, md5(trim(t)) AS text_md5, length(trim(t)) AS chars FROM d""")
def html_to_text(spark, sf_dir):
    plain = table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("t"))
    return plain.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("chars"))


#: The kinds of links, in the order in which they are tried.
LINKS = [("track", r"(?i)://[^/]*track"), ("spam", r"(?i)://[^/]*(?:pills|bets|spam)"), ("page", r"(?i)\.html?(?:$|[?#])"), ("feed", r"utm_source=feed"), ("folder", r"/(?:$|[?#])")]


@query("link_classify", "SELECT kind, count(*) AS links FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{k}'" for k, p in LINKS) + " ELSE 'other' END AS kind FROM pages) GROUP BY kind")
def link_classify(spark, sf_dir):
    return table(spark, sf_dir, "pages", "url").groupBy(text.classify(F.col("url"), LINKS, "other").alias("kind")).agg(F.count("*").alias("links"))


@query("union_shards", with_roles("SELECT jurisdiction, count(*) AS n FROM meetings GROUP BY jurisdiction", MEETINGS))
def union_shards(spark, sf_dir):
    """Shard results put together again, then counted as one."""
    shards = [meetings(spark, sf_dir).where(F.col("jurisdiction") % 5 == s) for s in range(5)]
    return reduce(lambda a, b: a.unionByName(b), shards).groupBy("jurisdiction").agg(F.count("*").alias("n"))


@query("budget_stop", with_roles("SELECT meeting_id, count(*) AS taken, CAST(max(s) AS DOUBLE) AS spent FROM (SELECT meeting_id, sum(price) OVER (PARTITION BY meeting_id ORDER BY sort_at, card_id) AS s FROM cards) WHERE s <= 600000 GROUP BY meeting_id", CARDS))
def budget_stop(spark, sf_dir):
    kept = aggregates.running_budget(cards(spark, sf_dir), ["meeting_id"], [F.col("sort_at"), F.col("card_id")], "price", 600_000)
    return kept.groupBy("meeting_id").agg(F.count("*").alias("taken"), F.max("spent").cast("double").alias("spent"))


@query("failure_streak", with_roles("SELECT meeting_id, max(n) AS streak FROM (SELECT meeting_id, i, count(*) FILTER (WHERE status = 'F') AS n FROM (SELECT meeting_id, status, sum(CASE WHEN status <> 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY sort_at, card_id) AS i FROM cards) GROUP BY meeting_id, i) GROUP BY meeting_id", CARDS))
def failure_streak(spark, sf_dir):
    return aggregates.failure_streaks(cards(spark, sf_dir), ["meeting_id"], [F.col("sort_at"), F.col("card_id")], F.col("status") == "F")


@query("interest_order", with_roles(f"SELECT card_id FROM cards WHERE is_published ORDER BY sort_at >= TIMESTAMP '{NOW}' DESC, floor(price / 1000) DESC, CASE WHEN sort_at >= TIMESTAMP '{NOW}' THEN epoch(sort_at) ELSE -epoch(sort_at) END, card_id DESC LIMIT 48", CARDS))
def interest_order(spark, sf_dir):
    scored = cards(spark, sf_dir).where("is_published").withColumn("score", F.floor(F.col("price") / 1000))
    return scored.orderBy(*ranking.public_interest_order("sort_at", "score", "card_id", _now())).limit(48).select("card_id")


@query("sequence_validation", with_roles("SELECT card_id, max(g) AS widest_gap, count(*) AS numbers FROM (SELECT card_id, number - lag(number, 1, 0) OVER (PARTITION BY card_id ORDER BY number) AS g FROM (SELECT DISTINCT card_id, number FROM items)) GROUP BY card_id HAVING max(g) <= 5", ITEMS))
def sequence_validation(spark, sf_dir):
    """Cards whose item numbers rise by five at most."""
    numbers = items(spark, sf_dir).select("card_id", "number").distinct()
    gaps = numbers.withColumn("gap", F.col("number") - F.lag("number", 1, 0).over(Window.partitionBy("card_id").orderBy("number")))
    return gaps.groupBy("card_id").agg(F.max("gap").alias("widest_gap"), F.count("*").alias("numbers")).where("widest_gap <= 5")
