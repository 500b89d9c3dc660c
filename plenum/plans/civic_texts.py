"""Queries over what cards say and how they are kept up: interest, classes, identity, meeting lists, hashes, marks, backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import civic_text as said
from plenum.functions import civic_time, text
from plenum.operators import ranking, upkeep
from plenum.plans.civic_reads import NOW, TS
from plenum.plans.registry import query
from plenum.plans.roles import CARDS, ITEMS, MEETINGS, cards, items, meetings, with_roles
from plenum.sources.readers import table

#: What made-up cards say: each row of a table takes one by its key.
PHRASES = [
    "Approve $1,200,000 contract for street paving", "Adopt the ordinance on rent control for tenants", "Roll call", "Meeting minutes of May 3", "Proclamation for national library month", "Appoint a library commissioner",
    "Special meeting of the council", "Rezoning of Elm Street for affordable housing", "Item withdrawn by staff", "Public hearing on water rates", "Annual report of the parks division", "Notice of cancellation",
    "Receive and file the quarterly report", "Bond measure of $60 million for schools", "A closed session", "Bike lanes and crosswalks near the train station", "Accessibility at the health clinic", "Sister city visit",
    "Budget hearing with a $250 thousand shortfall", "Capital improvement program", "Meeting of the planning board", "Solar power for the community center", "Update of the general plan, land use and density", "No action taken",
    "Notice of special election", "Notice of a regular board meeting", "Notice of public hearing on parking", "Elect a new vice chair",
]
CATEGORIES = [*said.CATEGORY_POINTS][:7]
STATUSES = ["Upcoming vote", "Routine approval", "Under discussion", "Passed", "Information only", "Cancelled"]
ACTIONS = ["Approve", "Item withdrawn", "Withdrawn from the agenda", "The motion passed 5-0", "Withdraw funds", "Hear"]
RESULTS = ["Passed", "motion failed", "Continued to May", "No action taken", "Motion carried", "Denied", "", "Tabled", "Passage of time", "rejected 3-2", "Referred to staff"]
TITLES = [
    "Adopt the work plan 2026", "Approve work plan update 2026", "Public hearing: sewer rates increase", "Sewer rate increases", "Sewer rate increase 2025", "Library contract with Acme for books", "Park contract with Acme for books",
    "Accept state law consistency update of the housing element program text", "Housing element program text", "Senate Bill 9 lots", "SB 9 lots", "Consider the", "Street trees and benches on Main", "Street trees and benches on Main Street north", "Café tables of the East Palo Alto Sanitary District (EPASD)", "Cafe tables of EPASD",
]


def _pick(values: list[str], key):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _sql_pick(values: list[str], key: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], CAST({key} % {len(values)} AS INTEGER) + 1)"


def _told(spark, sf_dir):
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", "p_name", _pick(PHRASES, key).alias("item"), _pick(STATUSES, F.floor(key / 5)).alias("status"), F.array(_pick(CATEGORIES, key), _pick(CATEGORIES, F.floor(key / 3))).alias("tags"))
    return parts.withColumn("told", said.card_text(F.col("item"), F.col("p_name"), F.col("status"))).withColumns({"has_comment": key % 3 == 0, "is_fallback": key % 11 == 0})


def _rx(words: str) -> str:
    return f"regexp_matches(told, '{said.words_pattern(words)}')"


_TOLD = rf"""told AS (SELECT *, item || ' ' || p_name || ' ' || status AS told, p_partkey % 3 = 0 AS has_comment, p_partkey % 11 = 0 AS is_fallback FROM (SELECT p_partkey, p_name, {_sql_pick(PHRASES, "p_partkey")} AS item,
{_sql_pick(STATUSES, "(p_partkey // 5)")} AS status, {_sql_pick(CATEGORIES, "p_partkey")} AS c1, {_sql_pick(CATEGORIES, "(p_partkey // 3)")} AS c2 FROM part)),
classes AS (SELECT *,
  regexp_matches(item, '(?i)^\s*(?:notice of\s+)?(?:an?\s+)?(?:special|regular|adjourned|closed|joint|annual)\s+(?:session|meeting)\b|^\s*meeting of the\b|^\s*(?:call|notice) of\s+(?:a\s+)?(?:special|closed)\b') AS announcement,
  regexp_matches(told, '(?i)\b(?:consent calendar minutes|approve (?:the )?(?:consent calendar )?minutes|meeting minutes|call to order|roll call|pledge of allegiance|adjournment|approval of agenda|recognize|recognition|proclamation|commendation|certificate|national .+ month|presentation only|introduce and welcome|swearing[- ]in|oath of office|installation of officers)\b') AS routine,
  regexp_matches(told, '(?i)\b(?:ad hoc|nominating|appoint|appoints|appointments?|officer election|bylaws?|rules of procedure|work ?plans?|(?:elect|select) (?:a )?(?:new )?(?:chair|vice chair|president|secretary)|orientation|annual report|receive and file|informational (?:item|update|report)|status update|(?:monthly|quarterly|mid-?year) report|meeting end time|item rollover|terms? and limits?|term limits?|meeting schedule|calendar of meetings|meeting notice|special joint (?:commission|committee|board))\b')
    OR regexp_matches(told, '(?i)\bnotice of (?:a |an )?(?:special|joint|regular|adjourned|closed)\b[^.]{{0,24}}\bmeeting\b') AS procedural,
  regexp_matches(told, '(?i)\b(?:withdrawn|removed from (?:the )?agenda|no action taken)\b') AS withdrawn, regexp_matches(told, '(?i)\b(?:cancell?ed|cancellation)\b') AS cancelled,
CASE WHEN contains(item, '$1,200,000') THEN 16 WHEN contains(item, '$60 million') THEN 23 WHEN contains(item, '$250 thousand') THEN 14 ELSE 0 END AS money,
least(62, {" + ".join(f"CASE WHEN {_rx(w)} THEN {n} ELSE 0 END" for n, w in said.DAILY_LIFE)}) AS daily FROM told),
scored AS (SELECT *, least(44, {" + ".join(f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {said.CATEGORY_POINTS[k]}" for k in CATEGORIES) + " END" for c in ("c1", "c2"))})
+ CASE status WHEN 'Upcoming vote' THEN 32 WHEN 'Routine approval' THEN -20 WHEN 'Under discussion' THEN 22 WHEN 'Passed' THEN 10 WHEN 'Information only' THEN -8 ELSE 0 END
+ daily + money + {" + ".join(f"CASE WHEN {_rx(w)} THEN {n} ELSE 0 END" for n, w in said.BINDING)} + CASE WHEN has_comment THEN 4 ELSE 0 END - CASE WHEN is_fallback THEN 60 ELSE 0 END
- CASE WHEN announcement THEN 100 ELSE 0 END - CASE WHEN routine THEN 140 ELSE 0 END - CASE WHEN procedural THEN 80 ELSE 0 END - CASE WHEN withdrawn THEN 90 ELSE 0 END - CASE WHEN cancelled THEN 70 ELSE 0 END AS score FROM classes)"""


def _scored(spark, sf_dir):
    score = said.interest_score(F.col("told"), F.col("item"), F.col("tags"), F.col("status"), F.col("has_comment"), F.col("is_fallback"))
    return _told(spark, sf_dir).withColumn("score", score.cast("int"))


@query("interest_score", f"WITH {_TOLD} SELECT p_partkey, CAST(score AS INTEGER) AS score, NOT (announcement OR routine OR procedural OR withdrawn OR cancelled OR is_fallback) AND (daily > 0 OR money >= 12 OR status = 'Upcoming vote') AND score >= 58 AS is_public FROM scored")
def interest_score(spark, sf_dir):
    public = said.is_public_interest(F.col("score"), F.col("told"), F.col("item"), F.col("status"), F.col("is_fallback"))
    return _scored(spark, sf_dir).select("p_partkey", "score", public.alias("is_public"))


@query("card_classes", f"WITH {_TOLD} SELECT announcement, routine, procedural, withdrawn, cancelled, count(*) AS cards FROM classes GROUP BY ALL")
def card_classes(spark, sf_dir):
    told = _told(spark, sf_dir)
    return told.select(*[c.alias(n) for n, c in said.card_classes(F.col("told"), F.col("item")).items()]).groupBy(*said.CLASS_POINTS).agg(F.count("*").alias("cards"))


_AT = f"TIMESTAMP '{NOW}' + INTERVAL 1 DAY * (p_partkey % 400 - 300)"


@query("digest_order", f"""WITH {_TOLD}, r AS (SELECT p_partkey, p_partkey % 97 = 0 AS featured, p_partkey % 400 - 300 AS days, score FROM scored)
SELECT p_partkey FROM r ORDER BY featured DESC, days >= 0 DESC, score * CASE WHEN days >= 0 THEN 1.0 ELSE greatest(0.5, 1 - -days / 180.0) END + greatest(0.0, 24 * (1 - abs(days) / 60.0)) DESC, CASE WHEN days >= 0 THEN days ELSE -days END, p_partkey DESC LIMIT 48""")
def digest_order(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(now) + 86_400 * (F.col("p_partkey") % 400 - 300))
    dated = _scored(spark, sf_dir).withColumn("at", at).withColumn("rank", F.round(said.ranking_score(F.col("score"), F.col("at"), now), 9))
    return dated.orderBy((F.col("p_partkey") % 97 == 0).desc(), *ranking.public_interest_order("at", "rank", "p_partkey", now)).limit(48).select("p_partkey")


@query("digest_mix", f"""WITH {_TOLD}, r AS (SELECT *, p_partkey % 20 = 7 AND p_partkey < 100 AS is_result FROM scored WHERE score >= 58), n AS (SELECT *, row_number() OVER (PARTITION BY is_result ORDER BY score DESC, p_partkey DESC) AS place, count(*) FILTER (WHERE is_result) OVER () AS results,
count(*) FILTER (WHERE NOT is_result) OVER () AS decisions FROM r) SELECT p_partkey, is_result FROM n WHERE place <= CASE WHEN is_result THEN greatest(15, 30 - decisions) ELSE greatest(15, 30 - results) END""")
def digest_mix(spark, sf_dir):
    """Few results, so decisions fill their share."""
    worthy = _scored(spark, sf_dir).where(f"score >= {said.THRESHOLD}")
    mixed = ranking.quota_mix(worthy, (F.col("p_partkey") % 20 == 7) & (F.col("p_partkey") < 100), [F.desc("score"), F.desc("p_partkey")], 30)
    return mixed.select("p_partkey", "is_result")


@query("official_signals", f"""WITH a AS (SELECT {_sql_pick(ACTIONS, "c_custkey")} AS action, {_sql_pick(RESULTS, "(c_custkey // 6)")} AS result FROM customer),
s AS (SELECT CASE WHEN action IN ('Item withdrawn', 'Withdrawn from the agenda') THEN 'withdrawn' WHEN result IN ('Continued to May', 'Tabled', 'Referred to staff') THEN 'continued' WHEN result IN ('motion failed', 'Denied', 'rejected 3-2') THEN 'failed'
WHEN result = 'No action taken' THEN 'no_action' WHEN result IN ('Passed', 'Motion carried') OR contains(action, 'motion passed') THEN 'approved' END AS signal FROM a)
SELECT signal, CASE signal WHEN 'withdrawn' THEN 'Cancelled' WHEN 'continued' THEN 'Tabled' WHEN 'approved' THEN 'Passed' WHEN 'failed' THEN 'Information only' WHEN 'no_action' THEN 'Information only' END AS status, count(*) AS n FROM s GROUP BY ALL""")
def official_signals(spark, sf_dir):
    key = F.col("c_custkey")
    signal = said.official_signal(_pick(ACTIONS, key), _pick(RESULTS, F.floor(key / 6)))
    return table(spark, sf_dir, "customer", "c_custkey").select(signal.alias("signal")).groupBy("signal", said.official_status(F.col("signal")).alias("status")).agg(F.count("*").alias("n"))


#: Which of the titles above name one item, by their places; stated by hand.
_SAME = [(2, 3), (7, 8), (9, 10), (12, 13), (2, 4), (3, 4), (14, 15)]


@query("same_item", "WITH p AS (SELECT p_partkey, p_name, CAST(p_partkey % {n} AS INTEGER) AS l, CAST(p_partkey // {n} % {n} AS INTEGER) AS r FROM part) SELECT p_partkey, l, r FROM p WHERE l = r OR (least(l, r), greatest(l, r)) IN ({s})".format(n=len(TITLES), s=", ".join(str(x) for x in _SAME)))
def same_item(spark, sf_dir):
    """Two titles of each part, its name after them: the same item or not."""
    n, key = len(TITLES), F.col("p_partkey")
    places = table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", "p_name", (key % n).cast("int").alias("l"), (F.floor(key / n) % n).cast("int").alias("r"))
    title = lambda c: said.item_tokens(F.concat_ws(" ", _pick(TITLES, F.col(c)), "p_name"))
    # the tokens come out of a generator, so that they are made once a row and not for each use in the rule
    told = places.select("p_partkey", "l", "r", F.inline(F.array(F.struct(title("l").alias("lt"), title("r").alias("rt")))))
    return told.where(said.same_item(F.col("lt"), F.col("rt"))).select("p_partkey", "l", "r")


@query("meeting_search", with_roles("""SELECT meeting_id, CASE WHEN contains(lower(title), '0012') THEN 'title' WHEN lower(body) LIKE 'build%' THEN 'type' END AS field FROM meetings
WHERE contains(lower(title), '0012') OR lower(body) LIKE 'build%'""", MEETINGS).replace("'0012'", "'customer#000000012'"))
def meeting_search(spark, sf_dir):
    """The first field, in order, that has the words in a row: a number only as a whole token, so not within the title's."""
    wanted = lambda c: text.token_match(F.col(c), "Build") | text.token_match(F.col(c), "customer 000000012")
    found = meetings(spark, sf_dir).withColumn("field", F.when(wanted("title"), "title").when(wanted("body"), "type"))
    return found.where("field IS NOT NULL").select("meeting_id", "field")


@query("upcoming_meetings", with_roles(f"""SELECT status, count(*) FILTER (WHERE up) AS upcoming, count(*) FILTER (WHERE up AND status <> 'P') AS attendable, count(*) FILTER (WHERE clock AND t <= TIMESTAMP '{NOW}' AND t + INTERVAL 3 HOUR > TIMESTAMP '{NOW}') AS in_progress
FROM (SELECT status, card_id % 2 = 0 AS clock, t, CASE WHEN card_id % 2 = 0 THEN t + INTERVAL 3 HOUR > TIMESTAMP '{NOW}' ELSE CAST(t - INTERVAL 7 HOUR AS DATE) >= DATE '1999-06-15' END AS up
FROM (SELECT card_id, status, TIMESTAMP '{NOW}' + INTERVAL 1 HOUR * (card_id % 200 - 100) AS t FROM cards)) GROUP BY status""", CARDS))
def upcoming_meetings(spark, sf_dir):
    now, clock = F.lit(NOW).cast("timestamp"), F.col("card_id") % 2 == 0
    dated = cards(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.unix_timestamp(now) + 3600 * (F.col("card_id") % 200 - 100)))
    up = civic_time.is_upcoming(F.col("at"), clock, now)
    return dated.groupBy("status").agg(F.count_if(up).alias("upcoming"), F.count_if(up & (F.col("status") != "P")).alias("attendable"), F.count_if(civic_time.is_in_progress(F.col("at"), clock, now)).alias("in_progress"))


@query("next_meetings", with_roles(f"SELECT meeting_id, strftime(min(sort_at), '%Y-%m-%d') AS next_day FROM cards WHERE sort_at >= TIMESTAMP '{NOW}' GROUP BY meeting_id ORDER BY min(sort_at), meeting_id LIMIT 5", CARDS))
def next_meetings(spark, sf_dir):
    ahead = cards(spark, sf_dir).where(F.col("sort_at") >= F.lit(NOW).cast("timestamp")).groupBy("meeting_id").agg(F.min("sort_at").alias("at"))
    return ahead.orderBy("at", "meeting_id").limit(5).select("meeting_id", F.date_format("at", "yyyy-MM-dd").alias("next_day"))


@query("meeting_list", with_roles("""SELECT meeting_id, strftime(t, '%Y-%m-%d') AS day FROM meetings LEFT JOIN (SELECT meeting_id AS m, max(sort_at) AS t FROM cards WHERE status = 'P' GROUP BY 1) ON m = meeting_id WHERE body = 'BUILDING' ORDER BY t DESC NULLS LAST, meeting_id DESC LIMIT 25 OFFSET 25""", CARDS, MEETINGS))
def meeting_list(spark, sf_dir):
    latest = cards(spark, sf_dir).where("status = 'P'").groupBy("meeting_id").agg(F.max("sort_at").alias("at"))
    listed = meetings(spark, sf_dir).where("body = 'BUILDING'").join(latest, "meeting_id", "left")
    return ranking.page(listed, [F.col("at").desc_nulls_last(), F.desc("meeting_id")], 2, 25).select("meeting_id", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("skip_unchanged", "SELECT p_partkey, sha256('{\"v\":\"' || p_name || '\"},{\"v\":\"' || p_size || '\"}') AS source_hash FROM part WHERE p_partkey % 3 <> 0 OR p_size % 2 <> 0")
def skip_unchanged(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    of = upkeep.source_hash(F.col("p_name"), F.col("p_size"))
    stored = parts.where("p_partkey % 3 = 0").select("p_partkey", F.array(F.lit("older"), F.when(F.col("p_size") % 2 == 0, of).otherwise(F.lit("stale"))).alias("hashes"))
    return upkeep.changed_sources(parts, stored, "p_partkey", of).select("p_partkey", "source_hash")


@query("backfill_chain", with_roles("SELECT card_id, coalesce(CASE WHEN card_id % 2 = 0 THEN category END, CASE WHEN meeting_id % 3 = 0 THEN title END, body) AS label FROM cards LEFT JOIN meetings USING (meeting_id)", CARDS, MEETINGS))
def backfill_chain(spark, sf_dir):
    partial = cards(spark, sf_dir).select("card_id", "meeting_id", F.when(F.col("card_id") % 2 == 0, F.col("category")).alias("label"))
    named = meetings(spark, sf_dir).withColumn("title", F.when(F.col("meeting_id") % 3 == 0, F.col("title")))
    return upkeep.backfill(partial, named, "meeting_id", "label", ["title", "body"]).select("card_id", "label")


_RUNS = "SELECT user_id, event_type, ts, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'completed' ELSE 'failed' END AS status FROM events"


@query("recover_runs", f"""WITH r AS (SELECT user_id, CASE WHEN status = 'running' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 60 SECOND THEN 'failed' ELSE status END AS status FROM ({_RUNS}))
SELECT user_id, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'partial' END AS status, count(*) AS runs FROM r GROUP BY user_id""")
def recover_runs(spark, sf_dir):
    status = F.when(F.col("event_id") % 4 == 0, "running").when(F.col("event_id") % 4 == 3, "failed").otherwise("completed")
    runs = table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumns({"status": status, "ts": F.col("ts").cast("timestamp")})
    return upkeep.rolled_up(upkeep.recover_runs(runs, "status", "ts", F.lit("2024-01-15").cast("timestamp")), ["user_id"], "status")


@query("stored_texts", "SELECT doc_id, length(left(text, CASE WHEN doc_id % 3 = 0 THEN 2000000 WHEN doc_id % 3 = 1 THEN 4000 ELSE 500000 END)) AS kept FROM documents")
def stored_texts(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "Minutes").when(F.col("doc_id") % 3 == 1, "raw").otherwise("other")
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.length(upkeep.capped_text(F.col("text"), kind)).cast("long").alias("kept"))


@query("payload_once", with_roles("SELECT card_id, CASE WHEN card_id = min(CASE WHEN card_id % 3 > 0 THEN card_id END) OVER (PARTITION BY meeting_id) THEN category END AS payload FROM cards", CARDS))
def payload_once(spark, sf_dir):
    bulky = cards(spark, sf_dir).withColumn("payload", F.when(F.col("card_id") % 3 > 0, F.col("category")))
    return upkeep.once_per_batch(bulky, "meeting_id", "card_id", "payload").select("card_id", "payload")


@query("refresh_sets", "SELECT p_brand AS owner, CASE WHEN p_brand < 'Brand#3' THEN p_type ELSE CAST(p_size AS VARCHAR) END AS entry, count(*) AS n FROM part WHERE p_brand >= 'Brand#3' OR p_size > 10 GROUP BY ALL")
def refresh_sets(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_brand", "p_type", "p_size")
    held = parts.select(F.col("p_brand").alias("owner"), F.col("p_size").cast("string").alias("entry"))
    wanted = parts.where("p_brand < 'Brand#3' AND p_size > 10").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("entry"))
    return upkeep.refresh(held, wanted, "owner").groupBy("owner", "entry").agg(F.count("*").alias("n"))


@query("prefer_upcoming", with_roles(f"SELECT meeting_id, category, card_id FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, category ORDER BY sort_at >= TIMESTAMP '{NOW}' DESC, sort_at, card_id) AS r FROM cards) WHERE r = 1", CARDS))
def prefer_upcoming(spark, sf_dir):
    ahead = F.col("sort_at") >= F.lit(NOW).cast("timestamp")
    return upkeep.prefer(cards(spark, sf_dir), ["meeting_id", "category"], ahead, [F.col("sort_at"), F.col("card_id")]).select("meeting_id", "category", "card_id")


_MARK = "TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 30)"


@query("digest_marks", f"""WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' ELSE 'none' END AS topic, CASE WHEN c_custkey % 5 > 0 THEN {_MARK} END AS mark FROM customer),
m AS (SELECT s.*, ts FROM s LEFT JOIN events ON event_type = topic AND ts > coalesce(mark, TIMESTAMP '1970-01-01'))
SELECT c_custkey, topic, count(ts) AS new_signals, {TS.format("coalesce(max(ts), any_value(mark))")} AS new_mark FROM m GROUP BY c_custkey, topic""")
def digest_marks(spark, sf_dir):
    key = F.col("c_custkey")
    mark = F.when(key % 5 > 0, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + 86_400 * (key % 30)))
    topic = F.when(key % 3 == 0, "click").when(key % 3 == 1, "purchase").otherwise("none")
    asked = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", topic.alias("topic"), mark.alias("mark"))
    signals = table(spark, sf_dir, "events", "event_type", "ts").select(F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("ts"))
    return upkeep.digest_marks(asked, signals, "c_custkey", "topic", "ts", "mark").select("c_custkey", "topic", "new_signals", F.date_format("new_mark", "yyyy-MM-dd HH:mm:ss").alias("new_mark"))


@query("water_filled", with_roles("""SELECT card_id, CAST(sum(granted) AS BIGINT) AS granted, max(granted) AS most FROM (SELECT card_id, quantity, least(quantity, coalesce(min(CASE WHEN i = lv THEN share END) OVER (PARTITION BY card_id), quantity)) AS granted
FROM (SELECT *, min(CASE WHEN quantity > share THEN i END) OVER (PARTITION BY card_id) AS lv FROM (SELECT card_id, quantity, i, CAST(floor((60 - b) / (n - i)) AS BIGINT) AS share FROM (SELECT card_id, quantity, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY card_id) AS n,
coalesce(sum(quantity) OVER (PARTITION BY card_id ORDER BY quantity, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT *, number * 1000000 + part AS k FROM items) WINDOW w AS (PARTITION BY card_id ORDER BY quantity, k))))) GROUP BY card_id""", ITEMS))
def water_filled(spark, sf_dir):
    blocks = items(spark, sf_dir).withColumn("k", F.col("number") * 1_000_000 + F.col("part"))
    dealt = upkeep.water_filled(blocks, ["card_id"], "quantity", "k", 60)
    return dealt.groupBy("card_id").agg(F.sum("granted").alias("granted"), F.max("granted").alias("most"))


@query("nearest_line", with_roles("""SELECT card_id, number, line FROM (SELECT l.card_id, l.number, r.number AS line, row_number() OVER (PARTITION BY l.card_id, l.number, l.part, l.supplier, l.quantity ORDER BY abs(r.quantity - l.quantity), r.quantity, r.number) AS p
FROM (SELECT DISTINCT * FROM items WHERE flag = 'N') l JOIN items r ON l.card_id = r.card_id AND r.flag <> 'N') WHERE p = 1""", ITEMS))
def nearest_line(spark, sf_dir):
    marks = items(spark, sf_dir).where("flag = 'N'").distinct().select("card_id", "number", "part", "supplier", "quantity")
    lines = items(spark, sf_dir).where("flag <> 'N'")
    found = upkeep.nearest(marks, lines, ["card_id"], "quantity", "number", "line")
    return found.where("line IS NOT NULL").select("card_id", "number", "line")


@query("month_grid", "SELECT d AS civic_day, count(c_custkey) AS n FROM (SELECT strftime(DATE '1999-05-30' + CAST(i AS INTEGER), '%Y-%m-%d') AS d FROM range(42) AS r(i)) LEFT JOIN (SELECT o_custkey AS c_custkey, strftime(o_orderdate, '%Y-%m-%d') AS od FROM orders) ON od = d GROUP BY d")
def month_grid(spark, sf_dir):
    days = spark.range(1).select(F.explode(civic_time.month_grid(F.lit(NOW).cast("date"))).alias("day"))
    orders = table(spark, sf_dir, "orders", "o_orderdate").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.join(orders, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("civic_day"), F.coalesce("n", F.lit(0)).alias("n"))
