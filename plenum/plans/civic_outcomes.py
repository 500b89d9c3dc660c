"""Queries over minutes: what was decided, its votes and sentences, numbered blocks, and results of consent calendars.

Every document is a meeting; its minutes are its whole text with agenda numbers before its lines and the record's phrases among them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import outcomes
from plenum.operators import consent
from plenum.plans.civic_matches import sql_tokens
from plenum.plans.registry import query
from plenum.sources.readers import table

RECORDS = [
    "ADOPTED unanimously", "Motion denied by a 3-2 vote", "Continued to August 4, 2026", "Approved as amended, 5-0", "The motion did not pass", "The item has not been adopted", "No action taken", "Failed",
    "Ayes: Chan, Dorsey, Chen Excused: Sauter", "AYES: Arenas, Duong. NOES: Simitian.", "Directed staff to return", "Received and filed", "Referred to committee", "Pass",
]
ACTIONS = [
    "Approve", "Withdrawn from the agenda", "Approve the withdrawal of funds", "Moved to rescind the previous vote", "Moved to reconsider the vote", "RECOMMENDED", "HEARD AND FILED", "AMENDED", "Adopt an ordinance",
]
BODIES = ["City Council", "Budget Committee", "County Planning Commission"]


def _pick(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _sql_pick(values, key):
    return "list_extract([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"], CAST({key} % {len(values)} AS INTEGER) + 1)"


def _records(spark, sf_dir):
    key, docs = F.col("doc_id"), table(spark, sf_dir, "documents", "doc_id", "text")
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return docs.select("doc_id", F.concat_ws(" ", _pick(ACTIONS, key), line).alias("action"), F.concat_ws(". ", _pick(RECORDS, F.floor(key / 9)), "text").alias("result"), _pick(BODIES, F.floor(key / 5)).alias("body"))


_RECORDS = f"""rec AS (SELECT doc_id, {_sql_pick(ACTIONS, "doc_id")} || ' ' || split_part(coalesce(text, ''), chr(10), 1) AS action, concat_ws('. ', {_sql_pick(RECORDS, "(doc_id // 9)")}, text) AS result,
  {_sql_pick(BODIES, "(doc_id // 5)")} AS body FROM documents)"""


def _sql_compact(text: str) -> str:
    """A record on one line, cut at a word, in DuckDB."""
    bare = rf"trim(regexp_replace(trim(regexp_replace(regexp_replace({text}, '[\s\x{{A0}}]+', ' ', 'g'), '(?i)===\s*PAGE\s+\d+\s*===', ' ', 'g')), '(?i)^(?:action|result|decision|motion)\s*[:\-]\s*', ''))"
    cut = f"left({bare}, 697)"
    word = f"list_extract(string_split({cut}, ' '), -1)"
    return f"CASE WHEN length({bare}) <= 700 THEN {bare} WHEN 697 - length({word}) - 1 > 500 THEN left({cut}, CAST(697 - length({word}) - 1 AS BIGINT)) || '...' ELSE {cut} || '...' END"


_TERMS = (
    "approved|adopted|pass(?:ed)?|carried|accepted|authorized|confirmed|denied|rejected|fail(?:ed)?|defeated|continued|postponed|tabled|deferred|referred|amended|determined|reported|directed|"
    "provided direction|gave direction|received and filed|introduced and waived(?: the)? reading|no action(?: taken)?"
)


def _sql_kind(text: str) -> str:
    """The kind of an outcome, in DuckDB."""
    negated = "(?:\\bnot\\b|\\bnever\\b|\\bnor\\b|n[''’]t\\b)(?:\\s+(?:be|been|being|yet))?\\s+"
    left = f"regexp_replace(lower({text}), '{negated}(?:{_TERMS})\\b', ' ', 'g')"
    has = lambda p: f"regexp_matches({left}, '\\b(?:{p})\\b')"
    failed = has("denied|rejected|fail(?:ed)?|defeated")
    approval = "approved|adopted|pass(?:ed)?|carried|accepted|authorized|confirmed"
    return f"""CASE WHEN {has("amend(?:ed|ment|ments)?")} AND NOT {failed} THEN 'amended' WHEN {has("continued|postponed|tabled|deferred|referred")} THEN 'continued'
WHEN {failed} OR regexp_matches(lower({text}), '{negated}(?:{approval})\\b') THEN 'rejected' WHEN {has(approval)} THEN 'approved' ELSE 'other' END"""


def _sql_headline(kind: str, text: str) -> str:
    has = lambda p: f"regexp_matches({text}, '(?i)\\b(?:{p})\\b')"
    every = f"CASE WHEN {has('unanim(?:ous|ously|ity)')} THEN ' unanimously' ELSE '' END"
    date = f"regexp_extract({text}, '(?i)\\bcontinued\\s+to\\s+([A-Z][a-z]+\\s+\\d{{1,2}})', 1)"
    return f"""CASE {kind} WHEN 'amended' THEN CASE WHEN {has("approved|adopted|pass(?:ed)?|carried")} THEN 'Approved with amendments' || {every} ELSE 'Amended' END
WHEN 'continued' THEN CASE WHEN {has("postponed")} THEN 'Postponed' WHEN {has("referred")} THEN 'Referred' WHEN {date} <> '' THEN 'Continued to ' || {date} ELSE 'Continued' END
WHEN 'rejected' THEN CASE WHEN {has("denied")} THEN 'Denied' WHEN {has("fail(?:ed)?|defeated")} THEN 'Motion failed' ELSE 'Rejected' END
WHEN 'approved' THEN CASE WHEN {has("adopted")} THEN 'Adopted' || {every} WHEN {has("approved|authorized|confirmed")} THEN 'Approved' || {every} ELSE 'Passed' || {every} END
ELSE CASE WHEN {has("no action(?: taken)?")} THEN 'No action taken' WHEN {has("directed|provided direction|gave direction")} THEN 'Direction provided' WHEN {has("received and filed")} THEN 'Received and filed'
WHEN {has("introduced and waived(?: the)? reading")} THEN 'Introduced' ELSE 'Outcome recorded' END END"""


@query("outcome_interpretation", rf"""WITH {_RECORDS}, t AS (SELECT doc_id, body, {_sql_compact("action")} AS act, {_sql_compact("result")} AS res FROM rec), s AS (SELECT *, concat_ws(' | ', nullif(act, ''), nullif(res, '')) AS src FROM t),
k AS (SELECT *, {_sql_kind("src")} AS kind, regexp_matches(src, '(?i)\b(?:fail(?:ed)?|denied|rejected|defeated)\b') AS failed, regexp_matches(src, '(?i)\bpass(?:ed)?\b') AND contains(body, 'Committee') AS committee FROM s),
r AS (SELECT *, CASE WHEN regexp_matches(src, '(?i)^(?:item\s+)?withdrawn\b|\bwithdraw(?:n|al)\b[^.]{{0,40}}?\b(?:from\s+(?:the\s+)?(?:agenda|calendar|consideration)|by\s+(?:staff|the\s+applicant|the\s+petitioner|the\s+sponsor))\b') THEN 'withdrawn'
  WHEN regexp_matches(src, '(?i)\brescind(?:ed|ing|s)?\b[^.]{{0,40}}?\b(?:previous|prior|earlier)\b|\b(?:previous|prior|earlier)\s+(?:vote|motion|action)\b[^.]{{0,40}}?\brescind') THEN 'rescinded'
  WHEN regexp_matches(src, '(?i)\b(?:motion|moved|move)\b[^.]{{0,40}}?\breconsider') THEN 'reconsidered'
  WHEN contains(body, 'Planning') THEN CASE kind WHEN 'continued' THEN 'adv_continued' WHEN 'other' THEN 'adv_recorded' ELSE 'adv_' || kind END
  WHEN regexp_matches(act, '(?i)\brecommend(?:ed|ation)?\b') THEN 'recommended' WHEN regexp_matches(act, '(?i)\bheard\s+and\s+filed\b') THEN 'heard_and_filed'
  WHEN regexp_matches(src, '(?i)\b(?:amend(?:ed|ment|ments)?|continued|postponed|tabled|deferred|referred)\b') AND regexp_matches(res, '(?i)\b(?:fail(?:ed)?|denied|rejected|defeated)\b') THEN 'changed_failed'
  WHEN committee AND kind = 'amended' THEN 'committee_amended' WHEN committee AND kind = 'approved' THEN 'committee_action' ELSE 'plain' END AS rule FROM k)
SELECT doc_id, CASE WHEN rule IN ('changed_failed') THEN 'rejected' WHEN rule = 'plain' THEN kind WHEN rule = 'adv_continued' THEN 'continued' WHEN rule = 'committee_amended' THEN 'amended' ELSE 'other' END AS kind,
CASE rule WHEN 'adv_continued' THEN 'continued' WHEN 'adv_recorded' THEN 'recorded' WHEN 'adv_approved' THEN 'recommended' WHEN 'adv_rejected' THEN 'recommended' WHEN 'adv_amended' THEN 'recommended' WHEN 'changed_failed' THEN 'rejected'
  WHEN 'committee_amended' THEN 'amended' WHEN 'plain' THEN CASE WHEN kind <> 'other' THEN kind WHEN regexp_matches(src, '(?i)\bno action(?: taken)?\b') THEN 'no_action' WHEN regexp_matches(src, '(?i)\b(?:directed|provided direction|gave direction)\b') THEN 'direction' ELSE 'recorded' END ELSE rule END AS status,
CASE rule WHEN 'withdrawn' THEN 'Withdrawn from the agenda' WHEN 'rescinded' THEN 'Previous vote rescinded' WHEN 'reconsidered' THEN 'Previous vote reconsidered' WHEN 'adv_approved' THEN 'Recommended approval' WHEN 'adv_rejected' THEN 'Recommended denial'
  WHEN 'adv_amended' THEN 'Recommendation amended' WHEN 'adv_recorded' THEN CASE WHEN regexp_matches(src, '(?i)\bno action(?: taken)?\b') THEN 'No recommendation made' ELSE 'Advisory action recorded' END
  WHEN 'recommended' THEN CASE WHEN failed THEN 'Recommendation failed' ELSE 'Recommended for approval' END WHEN 'heard_and_filed' THEN 'Heard and filed' WHEN 'changed_failed' THEN {_sql_headline("'rejected'", "res")}
  WHEN 'committee_amended' THEN 'Amended in committee' WHEN 'committee_action' THEN 'Committee motion passed' ELSE {_sql_headline("kind", "src")} END AS headline FROM r""")
def outcome_interpretation(spark, sf_dir):
    told = outcomes.interpret(F.col("action"), F.col("result"), F.col("body"), F.col("body").contains("Planning"), F.lit(False))
    return _records(spark, sf_dir).select("doc_id", told.alias("told")).select("doc_id", "told.kind", "told.status", "told.headline")


def _sql_roll_call(text: str, label: str) -> str:
    end = r"[.;]|\b(?:no(?:es)?|nay(?:s)?|absent|excused|abstain(?:ed|ing|tions?)?|recused|vacant|motion|moved|move|seconded?|enactment|resolution|ordinance|proclamation|session|closed|item|file|attachment)\b"
    rest = f"regexp_extract({text}, '(?is)^.*?\\b(?:{label})\\s*:\\s*(.*)$', 1)"
    names = f"trim(regexp_replace(regexp_extract({rest}, '(?is)^(.*?)(?:{end}|$)', 1), '\\s+', ' ', 'g'))"
    return f"nullif(left(regexp_replace({names}, '[\\s,;:\\-–—]+$', ''), 160), '')"


@query("vote_details", rf"""WITH {_RECORDS}, t AS (SELECT doc_id, {_sql_compact("result")} AS t FROM rec),
v AS (SELECT doc_id, t, regexp_extract(t, '\b(\d{{1,2}})\s*[-–—]\s*(\d{{1,2}})(?:\s*[-–—]\s*(\d{{1,2}}))?\b', ['a', 'b', 'c']) AS n, {_sql_roll_call("t", "ayes?|yes")} AS ayes, {_sql_roll_call("t", "noes?|nays?|no")} AS noes FROM t)
SELECT doc_id, CASE WHEN n.a <> '' THEN n.a || '–' || n.b || CASE WHEN n.c <> '' THEN '–' || n.c ELSE '' END WHEN ayes IS NOT NULL THEN left('Ayes: ' || ayes || '; Noes: ' || coalesce(noes, 'None'), 260)
WHEN regexp_matches(t, '(?i)\bunanim(?:ous|ously|ity)\b') THEN 'Unanimous' END AS vote FROM v""")
def vote_details(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", outcomes.vote_detail(F.col("result")).alias("vote"))


def minutes_of():
    """The minutes of a document: a consent calendar of its lines, each with a number, what was pulled, the action, and the text as the hearing."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    numbered = F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.lit("4."), (F.floor(i / 2) + 1).cast("string"), F.lit(" "), line)), "\n")
    pulled = F.when(key % 3 == 0, "Items 4.2 and 4.3 were pulled for discussion\n").otherwise("")
    action = F.when(key % 4 > 0, F.concat(F.lit("ACTION: Motion to approve the consent calendar passed "), (key % 7).cast("string"), F.lit("-0.\n\n"))).otherwise("\n")
    return F.concat(F.lit("A. Call to Order\nConsent Calendar\n"), numbered, F.lit("\n"), pulled, action, F.lit("C. Public Hearings\n5. "), _pick(RECORDS, F.floor(key / 9)), F.lit(". "), text).alias("minutes")


_MINUTES = rf"""mins AS (SELECT doc_id, 'A. Call to Order' || chr(10) || 'Consent Calendar' || chr(10)
  || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: '4.' || CAST((i - 1) // 2 + 1 AS VARCHAR) || ' ' || x), chr(10)) || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN 'Items 4.2 and 4.3 were pulled for discussion' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 > 0 THEN 'ACTION: Motion to approve the consent calendar passed ' || CAST(doc_id % 7 AS VARCHAR) || '-0.' || chr(10) || chr(10) ELSE chr(10) END
  || 'C. Public Hearings' || chr(10) || '5. ' || {_sql_pick(RECORDS, "(doc_id // 9)")} || '. ' || coalesce(text, '') AS minutes FROM documents),
norm AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(minutes, '\r\n?', chr(10), 'g'), '\x{{A0}}', ' ', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS m FROM mins),
lines AS (SELECT doc_id, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS i FROM norm)"""


@query("numbered_blocks", rf"""WITH {_MINUTES}, l AS (SELECT *, nullif(lower(regexp_extract(line, '(?i)^\s*(?:agenda\s+)?(?:item\s+)?([A-Z]?\d{{1,2}}(?:\.\d{{1,3}})?)\s*(?:[.)]\s*\S|:\s+[^\d\s]|-\s+[^\d\s]|\s+\S)', 1)), '') AS number,
  regexp_matches(line, '^\s*[A-Z]\s*[.)-]\s+[A-Z][\s\S]{{1,120}}$') AS section FROM lines),
o AS (SELECT *, section OR number IS DISTINCT FROM lag(number) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM l WHERE section OR number IS NOT NULL),
w AS (SELECT l.doc_id, l.i, l.line, count(CASE WHEN o.opens THEN 1 END) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS session FROM l LEFT JOIN o USING (doc_id, i)),
b AS (SELECT w.doc_id, session, min(i) AS at, trim(string_agg(line, chr(10) ORDER BY i)) AS block FROM w WHERE session > 0 GROUP BY w.doc_id, session)
SELECT b.doc_id, o.number, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY session) AS BIGINT) AS nth, md5(block) AS block FROM b JOIN o ON o.doc_id = b.doc_id AND o.i = b.at WHERE o.number IS NOT NULL""")
def numbered_blocks(spark, sf_dir):
    """Every numbered block of the minutes, in order, with the digest of its text."""
    blocks = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", outcomes.numbered_blocks(minutes_of()).alias("blocks"))
    told = blocks.select("doc_id", F.posexplode("blocks").alias("nth", "b"))
    return told.select("doc_id", "b.number", (F.col("nth") + 1).cast("long").alias("nth"), F.md5(F.col("b.block").cast("binary")).alias("block"))


@query("result_texts")
def result_texts(spark, sf_dir):
    """The sentence of each minutes that tells a result; no SQL, as its patterns look ahead: tests compare with another engine for patterns."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", outcomes.result_text(minutes_of()).alias("result"))


@query("consent_results", rf"""WITH it AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
items AS (SELECT doc_id, doc_id || '-' || i AS item, CASE WHEN i % 11 = 10 THEN '7.1' ELSE '4.' || CAST(i // 2 + 1 AS VARCHAR) END AS number, CASE WHEN i % 5 = 4 THEN 'Ferry landing proposal number ' || i ELSE line END AS title, i % 13 = 12 AS is_consent FROM it
  UNION ALL SELECT doc_id, doc_id || '-head', '4', 'Consent Calendar', FALSE FROM documents WHERE doc_id % 5 > 0),
own AS (SELECT *, is_consent OR number LIKE '4.%' AND doc_id % 5 > 0 AS belongs, {sql_tokens("title")} AS tok FROM items), {_MINUTES},
bound AS (SELECT *, min(CASE WHEN i > 2 AND (regexp_matches(trim(line), '^[A-Z]\s*[.):-]\s*[A-Z][\s\S]{{1,100}}$') OR regexp_matches(trim(line), '^[A-Z][A-Z0-9/&,''’() -]{{3,100}}[.:]?$')) THEN i END) OVER (PARTITION BY doc_id) AS stop FROM lines),
sec AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS section, bool_or(starts_with(line, 'ACTION: ')) AS acted FROM bound WHERE i >= 2 AND i < coalesce(stop, 1000000000) GROUP BY doc_id),
d AS (SELECT doc_id, section, {sql_tokens("section")} AS words FROM sec WHERE acted)
SELECT item, doc_id, 'Motion to approve the consent calendar passed ' || CAST(doc_id % 7 AS VARCHAR) || '-0.' AS result FROM own JOIN d USING (doc_id)
WHERE belongs AND len(tok) > 0 AND len(list_intersect(tok, words)) >= 0.72 * least(len(tok), len(words))
AND NOT regexp_matches(section, '(?i)\b' || replace(number, '.', '\.') || '\b[^.\n]{{0,180}}\b(?:pulled|removed|separate(?:ly)?|continued)\b|\b(?:pulled|removed|separate(?:ly)?|continued)\b[^.\n]{{0,180}}\b' || replace(number, '.', '\.') || '\b')""")
def consent_results(spark, sf_dir):
    """The consent motion of each document's minutes for all of its lines as items, but for those it lacks, that lie elsewhere or were pulled."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    number = F.concat(F.lit("4."), (F.floor(F.col("i") / 2) + 1).cast("string"))
    items = lines.select(
        "doc_id", F.concat_ws("-", "doc_id", "i").alias("item"), F.when(F.col("i") % 11 == 10, "7.1").otherwise(number).alias("number"),
        F.when(F.col("i") % 5 == 4, F.concat(F.lit("Ferry landing proposal number "), F.col("i"))).otherwise(F.col("line")).alias("title"), F.when(F.col("i") % 13 == 12, "Consent Calendar").alias("item_type"),
    )
    heads = docs.where(key % 5 > 0).select("doc_id", F.concat_ws("-", "doc_id", F.lit("head")).alias("item"), F.lit("4").alias("number"), F.lit("Consent Calendar").alias("title"), F.lit(None).cast("string").alias("item_type"))
    found = consent.consent_results(docs.select("doc_id", minutes_of().alias("text")), items.unionByName(heads), "doc_id", "item")
    return found.select("item", "doc_id", "result")
