"""Grounding, translations, excerpts, marks folded in the JVM, and upkeep over hot groups, against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from plenum.functions import grounding, highlight, text
from plenum.operators import upkeep


def each(spark, f, values, width=1):
    rows = [(i, *(v if width > 1 else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"v{k} string" for k in range(width)))
    return [r.out for r in df.select("i", f(*[F.col(f"v{k}") for k in range(width)]).alias("out")).orderBy("i").collect()]


def test_numeric_values(spark):
    cases = {
        "It costs $1.5 million.": [(1_500_000.0, "currency", None)], "45 % of 1,200 sq. ft. and 3 parcels": [(45.0, "percent", None), (1200.0, "number", "square-foot"), (3.0, "number", "parcel")],
        "2 properties, 7 people": [(2.0, "number", "property"), (7.0, "number", "people")], "12 gross square feet": [(12.0, "number", "square-foot")], "no number": [], None: [], "5 acres, 5 ac": [(5.0, "number", "acre")],
    }
    assert [[tuple(v) for v in out] for out in each(spark, grounding.numeric_values, list(cases))] == list(cases.values())


def test_date_values(spark):
    cases = {"On March 3, 2026 and 3/3/2026": ["2026-03-03"], "Sept. 9 2025": ["2025-09-09"], "February 30, 2026": [], "2/29/2024": ["2024-02-29"], "May 1, 26": [], None: []}
    assert each(spark, grounding.date_values, list(cases)) == list(cases.values())


def test_ungrounded(spark):
    cases = {
        ("Spend $2 million by May 4, 2026", "A contract of $2,000,000 ends 5/4/2026."): [], ("Spend $3 million", "A contract of $2,000,000"): ["currency 3000000.0000"],
        ("40 homes", "plan of 40 units"): ["number 40.0000 home"], ("40", "plan of 40 units"): [], ("5%", "5 of them"): ["percent 5.0000"], ("June 1, 2026", "June 2, 2026"): ["2026-06-01"], (None, "x"): [], ("$1", None): ["currency 1.0000"],
    }
    assert each(spark, grounding.ungrounded, list(cases), 2) == list(cases.values())


def test_translation_issues(spark):
    fields = lambda s, t, v, w: grounding.translation_issues({"summary": (s, t), "vote": (v, w)})
    cases = {
        ("The plan passed", "El plan se aprobó", "5-0", "5-0"): [], ("The plan", "the  PLAN", None, None): ["summary was left in English"], ("It has 3 parts", "Tiene 4 partes", None, "x"): ["summary changed numeric claims", "vote changed a null source value"],
        ("A", " ", "Unanimous", "Unanimous"): ["summary was omitted", "vote was left in English"], ("A", "El public hearing", None, None): ["summary contains untranslated English"], ("$1,000 and 5 %", "5% y $1.000", None, None): [], ("€5", "$5", None, None): ["summary changed numeric claims"],
    }
    assert each(spark, fields, list(cases), 4) == list(cases.values())


def _told_claims(value):
    out = []
    for c in re.findall(r"[$€£¥]?\s*\d+(?:[.,]\d+)*(?:\s*%)?", value):
        sign = re.search("[$€£¥]", c)
        out.append((sign[0] if sign else "") + ":".join(re.findall(r"\d+", c)) + ("%" if "%" in c else ""))
    return sorted(out)


def test_claims_against_brute_force(spark):
    rng = random.Random(2)
    values = ["".join(rng.choices("$€ 12345.,%ab", k=rng.randrange(25))) for _ in range(300)]
    assert each(spark, grounding.numeric_claims, values) == [_told_claims(v) for v in values]


def test_excerpts(spark):
    long = "word " * 60 + "the Café résumé stands here " + "tail " * 60
    shown = lambda q: each(spark, lambda t: highlight.excerpt(t, q), [long, "short Cafe, Resume text", "nothing of it", "", None])
    out = shown("cafe resume")
    assert out[1] == "short Cafe, Resume text" and out[2:] == [None, None, None]
    assert out[0].startswith("…word") and out[0].endswith("tail…") and "the Café résumé stands" in out[0] and len(out[0]) <= 182
    assert shown("  ") == [None] * 5 and shown("?!")[0] is None
    at = each(spark, lambda t: highlight.first_match(t, "b, c"), ["a B, C", "xb - céd", "bc", "ﬁ b. c"])
    assert [a and tuple(a) for a in at] == [(2, 4), (1, 5), None, (2, 4)]


def test_marks_fold_alike_on_both_sides(spark):
    rng = random.Random(5)
    pool = [chr(n) for n in [*range(0x20, 0x250), *range(0x370, 0x500), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF5F), 0x301, 0x327, 0x4E2D, 0x1F642]]
    values = ["".join(rng.choices(pool, k=12)) for _ in range(400)] + ["Ångström Éléphant ﬁn", ""]
    told = each(spark, text.folded, values)
    assert told == [text.fold_marks(v) for v in values]
    # one letter for each character: the same as full decomposition
    latin = ["Éléphant", "naïve Ångström", "ǅungla", "ﬃ", "Ελλάδα", "Йод", "ｆｕｌｌ"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.category(c).startswith("M")).lower() for v in latin]
    assert each(spark, text.folded, latin) == want
    plan = spark.createDataFrame([("é",)], "t string").select(text.folded(F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("width", [1, 30, 10_000])
def test_digest_marks_count_without_pairs(spark, width):
    rng = random.Random(width)
    signals = [(rng.choice("ab"), rng.randrange(200)) for _ in range(300)] + [(None, 5), ("a", None)]
    subs = [(i, rng.choice("abc"), rng.choice([None, *range(-5, 220)])) for i in range(80)]
    at = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    out = upkeep.digest_marks(at(spark.createDataFrame(subs, "k int, topic string, mark int"), "mark"), at(spark.createDataFrame(signals, "topic string, ts int"), "ts"), "k", "topic", "ts", "mark", width)
    found = {r.k: (r.n, r.m) for r in out.select("k", F.col("new_signals").alias("n"), F.unix_timestamp("new_mark").alias("m")).collect()}
    want = {}
    for k, topic, mark in subs:
        later = [t for s, t in signals if s == topic and t is not None and t > (mark or 0 if mark is None else mark)]
        want[k] = (len(later), max(later) if later else mark)
    assert found == want


@pytest.mark.parametrize("width", [3, 1000])
def test_nearest_keeps_types(spark, width):
    rng = random.Random(7)
    big = 2**60
    left = [(rng.choice("xy"), big + rng.randrange(50), i) for i in range(60)]
    right = [(rng.choice("xz"), big + rng.randrange(50), i) for i in range(25)]
    out = upkeep.nearest(spark.createDataFrame(left, "b string, at long, l int"), spark.createDataFrame(right, "b string, at long, r long"), ["b"], "at", "r", "found", width)
    assert out.schema["found"].dataType.typeName() == "long"
    want = {}
    for b, at, i in left:
        near = [(abs(p - at), p, k) for c, p, k in right if c == b]
        want[i] = min(near)[2] if near else None
    assert {r.l: r.found for r in out.collect()} == want


def test_payload_once_for_ties(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q"), ("a", 0, None), ("b", 5, None), ("b", 6, "r")], "batch string, ord int, payload string")
    out = upkeep.once_per_batch(df, "batch", "ord", "payload").collect()
    assert len(out) == 5 and sorted(r.payload for r in out if r.payload) in (["p", "r"], ["q", "r"])


def test_leaks_and_releases(spark):
    links = spark.createDataFrame([(1, "2026-01-01", "x/2026-01-01"), (2, "2026-01-02", "x/2026-01-01"), (3, "2026-01-03", "y"), (4, "2026-01-04", "y"), (5, "2026-01-05", "z/2026-01-01"), (6, None, "x/2026-01-01")], "meeting int, day string, url string")
    stay, leak = upkeep.without_leaked(links, "meeting", "day", "url", F.nullif(F.regexp_extract("url", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    assert {r.meeting for r in leak.collect()} == {2, 6} and {r.meeting for r in stay.collect()} == {1, 3, 4, 5}
    rows = [(1, "c", "d", "Regular", True, ["a"], "one"), (2, "c", "d", "Staff Report Release", False, ["b", "a"], "two"), (3, "c", "e", "Staff Report Release", True, ["x"], "three"), (4, None, "d", "Regular", True, None, None), (5, None, "d", "Staff Report Release", None, ["n"], "five")]
    df = spark.createDataFrame(rows, "id int, body string, day string, status string, agenda boolean, docs array<string>, row_text string")
    out = upkeep.folded_releases(df, ["body", "day"], "id", F.col("status") == "Staff Report Release", F.col("agenda"), "docs", "row_text")
    assert {r.id: (r.docs, r.row_text) for r in out.collect()} == {1: (["a", "b"], "one two"), 3: (["x"], "three"), 4: (["n"], "five")}


def test_union_by_id(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string"), spark.createDataFrame([(2, "y", 5), (3, "z", None), (3, "w", 1)], "id int, v string, more int")
    assert sorted(map(tuple, upkeep.union_by_id([a, b], "id").collect())) == [(1, "x", None), (2, None, None), (3, "w", 1)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_excerpt_folds_its_text_once(spark):
    from plenum.functions import highlight

    df = spark.createDataFrame([("Meses,\tenero",), ("Mesés - énero",), ("es  ,\n en",), (None,), ("Es, En\nb",)], "t string").select(highlight.excerpt(F.col("t"), "Es, En").alias("e"))
    assert [r.e for r in df.collect()] == ["Meses, enero", "Mesés - énero", "es , en", None, "Es, En b"]
    assert _plan(df).count("translate(") == 1


def test_leaks_shuffle_no_links(spark):
    from plenum.operators import upkeep

    rows = [("a", "2026-01-01", "u1"), ("b", "2026-01-02", "u1"), ("c", "2026-01-02", "u2"), ("d", None, "u1"), ("e", "2026-01-01", None)]
    links = spark.createDataFrame(rows, "meeting string, day string, url string")
    stay, leak = upkeep.without_leaked(links, "meeting", "day", "url", F.when(F.col("url") == "u1", "2026-01-01"))
    assert sorted(r.meeting for r in stay.collect()) == ["a", "c", "e"] and sorted(r.meeting for r in leak.collect()) == ["b", "d"]
    for df in (stay, leak):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_titles_of_a_pair_are_tokenized_once(spark):
    from plenum.plans import registry

    plan = _plan(registry.QUERIES["same_item"](spark, "/root/testdata/sf0.001"))
    assert plan.count("translate(") == 2
