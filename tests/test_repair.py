"""Repairs, bands, guarded writes, repeats and nested JSON on small cases and against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from plenum.functions import nested, repeats
from plenum.operators import bands, merge, repair


def test_consolidation_loses_nothing(spark):
    cards = spark.createDataFrame(
        [(1, "s1", "Street trees on Main"), (2, "l1", "street  trees on MAIN"), (3, "l1", "Street trees on Main Street north"), (4, "l1", "Library roof"), (5, "s2", "Pool hours"), (6, "l2", "Pool hours"), (7, "l2", "Bus stop"), (8, "z", "Pool hours"), (9, "l1", None)],
        "card_id int, meeting_id string, title string",
    )
    outcomes = spark.createDataFrame([(1, "s1", "a"), (4, "l1", "b"), (6, "l2", "c"), (99, "gone", "d")], "card_id int, meeting_id string, note string")
    papers = spark.createDataFrame([("p", "l1"), ("q", "l2"), ("r", "z")], "paper string, meeting_id string")
    pairs = spark.createDataFrame([("l1", "s1"), ("l2", "s2"), ("l3", "s3")], "loser string, survivor string")
    done = repair.consolidate(pairs, cards, outcomes, {"papers": papers})
    plan = {r.card_id: (r.action, r.meeting_id) for r in done.cards.collect()}
    assert plan == {1: ("keep", "s1"), 2: ("drop", "l1"), 3: ("drop", "l1"), 4: ("move", "s1"), 5: ("keep", "s2"), 6: ("keep", "l2"), 7: ("keep", "l2"), 8: ("keep", "z"), 9: ("move", "s1")}
    assert {(r.loser, r.survivor, r.card_id) for r in done.conflicts.collect()} == {("l2", "s2", 6)}
    told = {r.note: (r.action, r.meeting_id) for r in done.children["outcomes"].collect()}
    assert told == {"a": ("keep", "s1"), "b": ("move", "s1"), "c": ("keep", "l2"), "d": ("keep", None)}
    assert {r.paper: r.meeting_id for r in done.children["papers"].collect()} == {"p": "s1", "q": "l2", "r": "z"}
    assert done.cards.count() == cards.count() and done.children["outcomes"].count() == outcomes.count()


def test_survivors_by_score(spark):
    cards = spark.createDataFrame(
        [(1, "g", False, True, True, "2026-01-01"), (2, "g", True, False, False, "2026-01-02"), (3, "h", True, False, True, None), (4, "h", True, False, True, None), (5, "c", False, False, False, None), (6, "c", False, False, False, None), (7, "d", None, None, None, None)],
        "card_id int, g string, on_target boolean, is_featured boolean, is_published boolean, updated string",
    )
    outcomes = spark.createDataFrame([(1, "k", "u", "Passed", 0.5), (5, "k", "u", "Passed", 0.1), (6, "k2", "u", "Passed", None), (3, "k", "u", " passed ", None), (4, "k", "u", "PASSED", 0.9)], "card_id int, matched_item_key string, source_url string, headline string, match_score double")
    translations = spark.createDataFrame([(2, "es"), (2, "zh")], "card_id int, locale string")
    chosen = repair.survivors(cards, outcomes, translations, ["g"], "card_id", F.col("on_target"), F.col("is_featured"), F.col("is_published"), F.to_timestamp("updated"))
    out = {r.card_id: (r.survivor, r.is_conflict) for r in chosen.collect()}
    assert out == {1: (1, False), 2: (1, False), 3: (4, False), 4: (4, False), 5: (None, True), 6: (None, True), 7: (7, False)}
    left, children = repair.fold_cards(chosen, {"outcomes": outcomes, "translations": translations}, "card_id")
    assert {r.card_id for r in left.collect()} == {1, 4, 5, 6, 7}
    assert sorted(r.card_id for r in children["outcomes"].collect()) == [1, 4, 4, 5, 6]
    assert [r.card_id for r in children["translations"].collect()] == [1, 1]


def test_targets(spark):
    meetings = spark.createDataFrame([(1, "Council", "2026-01-01"), (2, "Council", "2026-01-02"), (3, "Board", "2026-01-03"), (4, "Council", "2026-01-05"), (5, "Council", "2026-01-05")], "meeting int, kind string, day string")
    urls = spark.createDataFrame([(1, "a"), (1, "both"), (2, "both"), (3, "a"), (2, "both")], "meeting int, url string")
    children = spark.createDataFrame(
        [("only", 2, "a", None, False), ("several", 2, "both", None, False), ("not mine", 4, "both", "2026-01-01", False), ("may", 4, "both", None, True), ("day", 4, "x", "2026-01-02", False), ("two days", 1, "x", "2026-01-05", False), ("back", 1, "x", "2026-01-05", True), ("lost", 9, "a", None, True), ("no url", 1, None, None, True)],
        "child string, owner int, url string, named string, may boolean",
    )
    out = repair.resolve_targets(children, meetings, urls, "owner", "meeting", "kind", "url", "day", F.col("named"), F.col("may"))
    assert {r.child: (r.target, r.method) for r in out.collect()} == {
        "only": (1, "url"), "several": (2, "owner_of_several"), "not mine": (None, "none"), "may": (4, "fallback"), "day": (2, "day"), "two days": (None, "none"), "back": (1, "fallback"), "lost": (None, "none"), "no url": (None, "none"),
    }


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_bands_equal_the_range_join(spark, width):
    rng = random.Random(width)
    lines = [(rng.choice("pq"), rng.randrange(120), n, n if rng.random() < 0.6 else None, rng.random() < 0.3) for n in range(80)]
    links = [(rng.choice("pqr"), rng.randrange(-20, 140), i) for i in range(200)]
    told = bands.link_bands(spark.createDataFrame(links, "page string, y int, link int"), spark.createDataFrame(lines, "page string, y int, line int, number int, ends boolean"), ["page"], "y", "line", "number", F.col("ends"), width=width)
    assert told.columns == ["page", "y", "link", "number"]
    want = {}
    for page, y, i in links:
        marks = [(m_y, -n, number) for p, m_y, n, number, ends in lines if p == page and (number is not None or ends) and m_y + 8 >= y]
        want[i] = min(marks)[2] if marks else None
    assert {r.link: r.number for r in told.collect()} == want


def test_bands_take_no_cartesian_product(spark):
    df = spark.range(10).selectExpr("'p' AS page", "id AS y", "id AS link")
    lines = spark.range(10).selectExpr("'p' AS page", "id AS y", "id AS line", "id AS number", "false AS ends")
    plan = bands.link_bands(df, lines, ["page"], "y", "line", "number", F.col("ends"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_guarded_write(spark):
    shape = "k int, points array<string>, told string, at string, n int"
    target = spark.createDataFrame([(1, ["a"], "a", "old", 1), (2, ["b"], "b", "old", 2), (3, ["c"], "c", "old", 3), (4, None, None, "old", 4)], shape)
    source = spark.createDataFrame([(1, ["x", "y"], "a"), (2, ["b"], "p\n\n q "), (3, ["1", "2", "3", "4"], "c"), (5, None, "new\nlines"), (6, [], None), (4, None, None)], "k int, points array<string>, told string")
    after, refused = merge.guarded_write(target, source, ["k"], merge.points_in_step("points", "told"), {"points": lambda v: F.size(v("points")).between(1, 3), "key": lambda v: v("k") < 100}, "at", F.lit("now"))
    assert {r.k: (r.points, r.told, r["at"], r.n) for r in after.collect()} == {
        1: (["x", "y"], "x\ny", "now", 1), 2: (["p", "q"], "p\n\n q ", "now", 2), 3: (["c"], "c", "old", 3), 4: (None, None, "now", 4), 5: (["new", "lines"], "new\nlines", None, None),
    }
    assert {r.k: r.reasons for r in refused.collect()} == {3: ["points"], 6: ["points"]}


def _repeats(tokens, n):
    best = 0
    for start in range(len(tokens) - n + 1):
        times = 1
        while tokens[start + n * times : start + n * (times + 1)] == tokens[start : start + n] and start + n * (times + 1) <= len(tokens):
            times += 1
        best = max(best, times)
    return best


def test_repeats_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("ab", k=rng.randrange(0, 30))) for _ in range(80)] + ["", None, "One, one. ONE one! one (one)", "a b c d " * 4, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", repeats.repeat_counts(F.col("t")).alias("c"))
    for r in df.select("*", repeats.repeats_itself(F.col("c")).alias("bad")).collect():
        tokens = re.findall(r"[^\W_]+", (texts[r.i] or "").lower())
        want = [_repeats(tokens, n) for n in (1, 2, 3, 4)]
        assert list(r.c) == want, texts[r.i]
        assert r.bad == (want[0] >= 6 or max(want[1:]) >= 4)


def test_verbatim(spark):
    long = "The council adopted the budget for the year"
    cases = [(long, f"Minutes: {long.upper()}!", True), (long, "The council rejected it all by a wide margin", False), ("adopted", long, False), (None, long, False), (f"{long} now", long, True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.where(repeats.near_verbatim(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def _visit(value, depth=0):
    if not isinstance(value, (dict, list)) or depth > 12:
        return False
    if isinstance(value, list):
        return any(_visit(v, depth + 1) for v in value)
    review = value.get("review")
    if isinstance(review, dict) and isinstance(review.get("issues"), list) and any(isinstance(i, dict) and i.get("outcome") != "warning" for i in review["issues"]):
        return True
    return any(_visit(v, depth + 1) for v in value.values())


def test_markers_in_nested_json(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.randrange(6)
        if depth > 15 or kind == 0:
            return rng.choice([None, 1, "x", True])
        if kind < 3:
            return [value(depth + 1) for _ in range(rng.randrange(1, 3))]
        out = {f"k{i}": value(depth + 1) for i in range(rng.randrange(1, 3))}
        if rng.random() < 0.3:
            out["review"] = rng.choice([{"issues": [{"outcome": "warning"}]}, {"issues": [{"outcome": "error"}]}, {"issues": [{}]}, {"issues": ["text"]}, {"issues": "none"}, "no", {"issues": [{"outcome": None}]}])
        return out

    values = [value(0) for _ in range(150)]
    deep = {"review": {"issues": [{"outcome": "error"}]}}
    for _ in range(14):
        values.append(deep)
        deep = {"a": deep}
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    found = {r.i for r in df.where(nested.rejected(nested.parsed(F.col("t")), "review")).collect()}
    assert found == {i for i, v in enumerate(values) if _visit(v)} and len(found) > 10


def test_json_inside_texts(spark):
    cases = {'{"a": 1}': "1", 'Here: ```json\n{"a": 2}\n``` done': "2", 'noise {"a": 3} noise': "3", "no json {": None, "": None}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", F.try_variant_get(nested.parsed(F.col("t")), "$.a", "string").alias("a"))
    assert {r.t: r.a for r in df.collect()} == {**cases, None: None}
    page = spark.sql("""SELECT '<html><script type="application/json" id="data">{"x": [1, 2]}</script></html>' AS h UNION ALL SELECT '<p>none</p>' UNION ALL SELECT NULL""")
    assert sorted(str(r[0]) for r in page.select(F.try_variant_get(nested.script_json(F.col("h"), "data"), "$.x[1]", "int")).collect()) == ["2", "None", "None"]


def test_raw_documents(spark):
    rows = [(1, '{"documents":[{"type":"Video","label":"v","url":"u"},{"url":7,"source_url":"s"},{"label":"none"},3,null,{"url":""}]}'), (2, "{}"), (3, "not json"), (4, None), (5, '{"documents":5}')]
    out = nested.raw_documents(spark.createDataFrame(rows, "id int, raw string"), "raw", ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, 0, "Video", "v", "u"), (1, 1, None, None, "s")]


def test_replaced_children_keep_flags_by_key_or_title(spark):
    shape = "meeting int, item string, url string, featured boolean"
    target = spark.createDataFrame([(1, "Street trees", "u", True), (1, "Pool  Hours", "v", True), (1, "Old", "w", True), (2, "Stays", "x", True), (3, "Bus", "y", False)], shape)
    source = spark.createDataFrame([(1, "Street trees", "u", False), (1, "pool hours ", "moved", False), (1, "New", "n", False), (3, "bus", "z", None)], shape)
    out = merge.replace_children(target, source, "meeting", ["item", "url"], ["featured"], "item")
    assert {(r.meeting, r.item, r.url): r.featured for r in out.collect()} == {
        (1, "Street trees", "u"): True, (1, "pool hours ", "moved"): True, (1, "New", "n"): False, (2, "Stays", "x"): True, (3, "bus", "z"): False,
    }
    plain = merge.replace_children(target, source, "meeting", ["item", "url"], ["featured"])
    assert {r.item for r in plain.where("featured").collect()} == {"Street trees", "Stays"}
