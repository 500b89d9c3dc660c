"""Civic time, texts and streams on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plenum.functions import civic_time, text
from plenum.operators import merge
from plenum.streaming import signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "clock", "hour"),
    [("7/4/2026", "1:00:00 PM", 13), ("July 4, 2026", "6:30 p.m.", 18), ("7/4/26", "12:15 AM", 0), ("7/4/2026", "12:00 PM", 12), ("7/4/2026", "18:30", 18), ("7/4/2026", None, 0)],
)
def test_parse_civic(spark, said, clock, hour):
    local = F.from_utc_timestamp(civic_time.parse_civic(F.lit(said), F.lit(clock)), civic_time.ZONE)
    found = one(spark, local)
    assert (found.year, found.month, found.day, found.hour) == (2026, 7, 4, hour)


def test_parse_civic_of_nothing(spark):
    assert one(spark, civic_time.parse_civic(F.lit("to be announced"))) is None
    assert one(spark, civic_time.parse_civic(F.lit("13/45/2026"))) is None
    assert one(spark, civic_time.parse_civic(F.lit(None).cast("string"))) is None


def test_month_window(spark):
    now = F.lit("2026-07-13 19:00:00").cast("timestamp")
    inside = lambda t: one(spark, civic_time.in_month_window(F.lit(t).cast("timestamp"), now))
    assert [inside(t) for t in ("2026-06-01 06:59:59", "2026-06-01 07:00:00", "2026-09-01 06:59:59", "2026-09-01 07:00:00")] == [False, True, True, False]


def test_effective_status(spark):
    now = F.lit("2026-07-13 20:00:00").cast("timestamp")

    def status(said, at, section="Other", clock=True):
        return one(spark, civic_time.effective_status(F.lit(said), F.lit(section), F.lit(at).cast("timestamp"), F.lit(clock), now))

    assert status("Upcoming", "2026-07-10 20:00:00") == "Past"
    assert status("Past", "2026-07-20 20:00:00") == "Upcoming"
    assert status("Cancelled", "2026-07-10 20:00:00") == "Cancelled"
    assert status("Past", "2026-07-13 07:00:00", "All Meetings", clock=False) == "Upcoming"


def test_weekly_subscriptions_are_due_in_the_next_week(spark):
    due = lambda sent, now: one(spark, civic_time.is_due(F.lit(sent).cast("timestamp"), F.lit("2026-01-01").cast("timestamp"), F.lit("weekly"), F.lit(now).cast("timestamp")))
    assert due("2026-07-14 09:00:00", "2026-07-20 00:00:01")
    assert not due("2026-07-14 09:00:00", "2026-07-19 23:59:59")


@pytest.mark.parametrize(("needle", "fits"), [("parking", True), ("PARK garage", True), ("2", False), ("25", True), ("garage parking", False), ("...", True)])
def test_token_match(spark, needle, fits):
    assert one(spark, text.token_match(F.lit("Parking-garage rates: 25 cents, Café"), needle)) is fits


def test_points_money_and_overlap(spark):
    points = lambda s: one(spark, text.summary_points(F.lit(s)))
    assert points('["a", " b "]') == ["a", "b"]
    assert points("a\n\n b") == ["a", "b"]
    assert points("[see the report] first") == ["[see the report] first"]
    assert points(None) == []
    assert one(spark, text.largest_dollars(F.lit("from $1,200 to $1.5 million"))) == 1_500_000
    assert one(spark, text.money_score(F.lit("$999"))) == 0
    assert one(spark, text.money_score(F.lit("$4 billion"))) == 26
    tokens = lambda *t: F.array(*[F.lit(x) for x in t])
    assert one(spark, text.overlap(tokens("a", "b"), tokens("b", "c", "d"))) == 0.5
    assert one(spark, text.numbers_conflict(tokens("lot", "5"), tokens("lot", "6")))


def test_upsert_preserves_and_inserts(spark):
    target = spark.createDataFrame([(1, "old", "note"), (2, "stays", None)], "k int, v string, notes string")
    source = spark.createDataFrame([(1, None, "x"), (3, "new", None)], "k int, v string, notes string")
    rows = merge.upsert(target, source, ["k"], preserve=["v"], state=["notes"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "old", "note"), (2, "stays", None), (3, "new", None)]


def test_write_batches_let_an_oversized_row_go_alone(spark):
    rows = spark.createDataFrame([(i, 100 if i == 2 else 10) for i in range(6)], "i int, n int").withColumn("g", F.lit(1))
    found = {r["i"]: r["batch"] for r in merge.write_batches(rows, ["g"], [F.col("i")], "n", 2, 50).collect()}
    assert found == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}


EVENTS = [("k", i, dt.datetime(2026, 1, 1, 0, s // 60, s % 60)) for i, s in enumerate((1, 2, 3, 4, 62))]
ANSWERS = [(True, 0), (True, 0), (False, 30), (False, 29), (True, 0)]


def test_rate_limit(spark):
    events = spark.createDataFrame(EVENTS, "k string, i long, at timestamp")
    told = signals.rate_limit(events, signals.Limit(2, 60, 30), "k", "i", "at").orderBy("id").collect()
    assert [(r["allowed"], r["retry_after"]) for r in told] == ANSWERS


def test_rate_limit_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, "k string, i long, at timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    told = signals.rate_limit_stream(stream, signals.Limit(2, 60, 30), "k", "i", "at")
    query = told.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("told").orderBy("id").collect()
    assert [(r["allowed"], r["retry_after"]) for r in rows] == ANSWERS


@pytest.mark.parametrize(("needle", "said"), [("Škoda", "A ŠKODA bus"), ("dvořák", "Antonín Dvořák hall"), ("skoda", "Škoda"), ("fi", "oﬃce hours"), ("№", "item No 4"), ("łódź", "Łódź street")])
def test_marks_are_folded_alike_on_both_sides(spark, needle, said):
    assert one(spark, text.token_match(F.lit(said), needle)) is True


@pytest.mark.parametrize(("said", "clock"), [("10 am item; 7/4/2026", 0), ("7/4/2026 - Room 2, 6:30 p. m.", 18), ("July 4, 2026 at 9 a.m. or 3 p.m.", 9), ("7/4/2026 18:05:30", 18), ("2026-07-05T03:00:00Z", 20)])
def test_clock_after_the_date(spark, said, clock):
    local = one(spark, F.from_utc_timestamp(civic_time.parse_civic(F.lit(said)), civic_time.ZONE))
    assert (local.month, local.day, local.hour) == (7, 4, clock)


@pytest.mark.parametrize(("said", "has"), [("18:30", False), ("6 pm", True), ("6:30 P.M.", True), ("6:30 p. m. sharp", True), ("item 6", False), ("at 12pm.", True), (None, False)])
def test_has_clock(spark, said, has):
    assert one(spark, civic_time.has_clock(F.lit(said).cast("string"))) is has


@pytest.mark.parametrize(("said", "dollars"), [("$5 and $1,250.50", 1250.5), ("a $60 million bond", 6e7), ("$3.5M, $2B", 2e9), ("$ 40k", 4e4), ("US$7 mills", 7.0), ("no money $", 0.0), (None, 0.0)])
def test_largest_dollars(spark, said, dollars):
    assert one(spark, text.largest_dollars(F.lit(said).cast("string"))) == dollars
