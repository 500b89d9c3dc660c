"""Write-side queries: upserts, refreshes, clean-ups and batches as the rows they leave; limiter and digest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import joins, merge
from plenum.plans.registry import query
from plenum.plans.roles import CARDS, ITEMS, MEETINGS, cards, items, meetings, with_roles
from plenum.sources.readers import table
from plenum.streaming import signals

_TIE = "part, supplier, quantity, price, flag, shipped"


@query("upsert_merge", with_roles("""SELECT card_id, status, CASE WHEN card_id % 5 = 0 THEN category ELSE coalesce(CASE WHEN card_id % 10 = 2 THEN 'new' END, CASE WHEN card_id % 2 = 0 AND card_id % 10 = 2 THEN 'new' END, category) END AS category, is_featured FROM (
SELECT card_id, CASE WHEN card_id % 2 = 0 THEN 'X' ELSE status END AS status, category, is_featured FROM cards)
UNION ALL SELECT -card_id - 1, 'X', NULL, FALSE FROM cards WHERE card_id % 100 = 0""", CARDS))
def upsert_merge(spark, sf_dir):
    """Even cards come anew with another status; one in five of those with a category, which the others keep; flags are the target's."""
    target = cards(spark, sf_dir).select("card_id", "status", "category", "is_featured")
    same = cards(spark, sf_dir).where("card_id % 2 = 0").select("card_id", F.lit("X").alias("status"), F.when(F.col("card_id") % 10 == 2, "new").alias("category"), F.lit(False).alias("is_featured"))
    new = cards(spark, sf_dir).where("card_id % 100 = 0").select((-F.col("card_id") - 1).alias("card_id"), F.lit("X").alias("status"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("is_featured"))
    return merge.upsert(target, same.unionByName(new), ["card_id"], preserve=["category"], state=["is_featured"])


@query("collapse_conflicts", with_roles(f"""SELECT card_id, number, arg_max(p, o) FILTER (WHERE p IS NOT NULL) AS part, arg_max(q, o) FILTER (WHERE q IS NOT NULL) AS quantity FROM (
SELECT card_id, number, CASE WHEN part % 3 > 0 THEN part END AS p, CASE WHEN quantity % 2 > 0 THEN quantity END AS q, row_number() OVER (PARTITION BY card_id, number ORDER BY {_TIE}) AS o FROM items) GROUP BY card_id, number""", ITEMS))
def collapse_conflicts(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("card_id", "number").orderBy(*_TIE.split(", ")))
    rows = items(spark, sf_dir).select(
        "card_id", "number", F.when(F.col("part") % 3 > 0, F.col("part")).alias("part"), F.when(F.col("quantity") % 2 > 0, F.col("quantity")).alias("quantity"), order.alias("ord")
    )
    return merge.collapse(rows, ["card_id", "number"], "ord")


@query("preserve_missing", """SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 4 = 0 AND l.doc_id IS NULL THEN NULL WHEN d.doc_id % 4 = 0 THEN 'archived' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def preserve_missing(spark, sf_dir):
    """Every fourth document comes without its source; the archive has that of the labelled ones."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source").withColumn("source", F.when(F.col("doc_id") % 4 != 0, F.col("source")))
    archive = table(spark, sf_dir, "labels", "doc_id").select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit("archived").alias("source"))
    return merge.upsert(archive, docs, ["doc_id"], preserve=["source"])


@query("replace_children", with_roles("""SELECT meeting_id, card_id, is_featured,
CASE WHEN meeting_id % 3 = 0 AND card_id % 2 = 0 THEN 'fresh' ELSE status END AS status FROM cards WHERE meeting_id % 3 <> 0 OR card_id % 2 = 0
  OR meeting_id NOT IN (SELECT meeting_id FROM cards WHERE card_id % 2 = 0 OR card_id % 7 = 0)
UNION ALL SELECT meeting_id, -card_id - 1, FALSE, 'fresh' FROM cards WHERE meeting_id % 3 = 0 AND card_id % 7 = 0""", CARDS))
def replace_children(spark, sf_dir):
    """Every third meeting that has any gets its even cards again and some new ones; what was featured stays so."""
    target = cards(spark, sf_dir).select("meeting_id", "card_id", "is_featured", "status")
    third = target.where("meeting_id % 3 = 0")
    again = third.where("card_id % 2 = 0").select("meeting_id", "card_id")
    new = third.where("card_id % 7 = 0").select("meeting_id", (-F.col("card_id") - 1).alias("card_id"))
    source = again.unionByName(new).withColumns({"is_featured": F.lit(False), "status": F.lit("fresh")})
    return merge.replace_children(target, source, "meeting_id", ["card_id"], ["is_featured"])


@query("drop_obsolete", with_roles("SELECT status, count(*) AS cards FROM cards WHERE is_featured OR card_id IN (SELECT card_id FROM items WHERE quantity > 45) GROUP BY status", CARDS, ITEMS))
def drop_obsolete(spark, sf_dir):
    left = merge.drop_obsolete(cards(spark, sf_dir), items(spark, sf_dir).where("quantity > 45"), ["card_id"], F.col("is_featured"))
    return left.groupBy("status").agg(F.count("*").alias("cards"))


@query("status_reconcile", with_roles("""SELECT status, s AS new_status, count(*) AS cards FROM (SELECT status, CASE WHEN status = 'P' THEN 'P' WHEN sort_at < TIMESTAMP '1999-06-15 19:00:00' THEN 'F' ELSE 'O' END AS s FROM cards) WHERE s <> status GROUP BY status, s""", CARDS))
def status_reconcile(spark, sf_dir):
    past = F.col("sort_at") < F.lit("1999-06-15 19:00:00").cast("timestamp")
    effective = F.when(F.col("status") == "P", F.col("status")).otherwise(F.when(past, F.lit("F")).otherwise(F.lit("O")))
    changed = merge.reconcile_status(cards(spark, sf_dir), "status", effective).where("is_changed")
    return changed.groupBy("status", "new_status").agg(F.count("*").alias("cards"))


@query("write_batches", """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
b AS (SELECT source, doc_id, n, 0 AS batch, 1 AS r, n_chars AS s FROM d WHERE n = 1 UNION ALL
SELECT d.source, d.doc_id, d.n, CASE WHEN b.r >= 10 OR b.s + d.n_chars > 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.r >= 10 OR b.s + d.n_chars > 20000 THEN 1 ELSE b.r + 1 END, CASE WHEN b.r >= 10 OR b.s + d.n_chars > 20000 THEN d.n_chars ELSE b.s + d.n_chars END
FROM b JOIN d ON d.source = b.source AND d.n = b.n + 1) SELECT doc_id, source, CAST(batch AS INTEGER) AS batch FROM b""")
def write_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    return merge.write_batches(docs, ["source"], [F.col("doc_id")], "n_chars", 10, 20_000).select("doc_id", "source", "batch")


@query("protected_duplicates", with_roles("SELECT meeting_id AS duplicate, meeting_id IN (SELECT meeting_id FROM cards WHERE is_featured) OR meeting_id IN (SELECT meeting_id FROM cards WHERE status = 'P') AS is_protected FROM meetings WHERE meeting_id % 2 = 0", CARDS, MEETINGS))
def protected_duplicates(spark, sf_dir):
    pairs = meetings(spark, sf_dir).where("meeting_id % 2 = 0").select(F.col("meeting_id").alias("duplicate"))
    owned = [cards(spark, sf_dir).where("is_featured").select("meeting_id"), cards(spark, sf_dir).where("status = 'P'").select("meeting_id")]
    return joins.protected(pairs, owned)


_LIMIT = signals.Limit(3, 86_400.0, 43_200.0)


@query("rate_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t, t AS ws, 1 AS c, CAST(NULL AS DOUBLE) AS bu, TRUE AS ok, 0 AS wait FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.event_id, e.n, e.t,
  CASE WHEN r.bu > e.t THEN r.ws WHEN r.ws + 86400 <= e.t THEN e.t ELSE r.ws END,
  CASE WHEN r.bu > e.t THEN r.c WHEN r.ws + 86400 <= e.t THEN 1 WHEN r.c >= 3 THEN r.c ELSE r.c + 1 END,
  CASE WHEN r.bu > e.t THEN r.bu WHEN r.ws + 86400 <= e.t THEN NULL WHEN r.c >= 3 THEN e.t + 43200 ELSE NULL END,
  CASE WHEN r.bu > e.t THEN FALSE WHEN r.ws + 86400 <= e.t THEN TRUE ELSE r.c < 3 END,
  CASE WHEN r.bu > e.t THEN CAST(greatest(1, ceil(r.bu - e.t)) AS INTEGER) WHEN r.ws + 86400 <= e.t THEN 0 WHEN r.c >= 3 THEN 43200 ELSE 0 END
FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, ok AS allowed, CAST(wait AS INTEGER) AS retry_after FROM r""")
def rate_limit(spark, sf_dir):
    told = signals.rate_limit(table(spark, sf_dir, "events", "user_id", "event_id", "ts"), _LIMIT, "user_id", "event_id", "ts")
    return told.select(F.col("id").alias("event_id"), "allowed", "retry_after")


@query("weekly_digest", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, event_type, count(*) AS signals FROM events GROUP BY 1, 2")
def weekly_digest(spark, sf_dir):
    events = table(spark, sf_dir, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    return signals.weekly(events, ["event_type"], "ts").withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))


@query("idempotent_signals", "SELECT DISTINCT user_id, event_type FROM events")
def idempotent_signals(spark, sf_dir):
    return signals.idempotent(table(spark, sf_dir, "events", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type")
