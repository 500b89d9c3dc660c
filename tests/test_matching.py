"""Claims, the cascade of matches and word-set joins: contested rows, stops, hot blocks, and all pairs of small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plenum.functions import civic_text as said
from plenum.operators import joins, matching

SHAPE = "card_id int, parent string, ord int, source_item_id string, title string, url string, flag boolean"


def adopt(spark, target, source):
    t = spark.createDataFrame([(i, p, 0, s, a, u, f) for i, p, s, a, u, f in target], SHAPE)
    s = spark.createDataFrame([(i, p, n, s, a, u, None) for n, (i, p, s, a, u) in enumerate(source)], SHAPE).drop("flag")
    out = matching.adopt_children(t, s, "parent", "card_id", "ord", "source_item_id", "title", "url", ["flag"])
    assert out.columns == ["card_id", "parent", "adopted", "rule", "source_item_id", "flag"]
    return {r.card_id: (r.adopted, r.rule, r.source_item_id, r.flag) for r in out.collect()}


def test_each_rule_claims(spark):
    target = [
        (1, "m", "id-1", "Some title", "u", True), (2, "m", None, "Street trees on Main", "u", False), (3, "m", None, "Library roof contract", "v", True),
        (4, "m", None, "Sewer rates of the north district for households", "w", None), (5, "m", "id-5", "Bus shelters near the school", "x", True), (6, "other", None, "Street trees on Main", "u", True),
    ]
    source = [
        (11, "m", "id-1", "New wording", "z"), (12, "m", None, " street  TREES on main ", "U"), (13, "m", None, "Library roof contract", "moved"),
        (14, "m", "id-9", "Update sewer rate of the north district for households", "q"), (15, "m", None, "Bus shelters near the school", "x"), (16, "m", None, "Nothing like it", "n"),
    ]
    assert adopt(spark, target, source) == {
        11: (1, "identity", "id-1", True), 12: (2, "exact", None, False), 13: (3, "title", None, True), 14: (4, "fuzzy", "id-9", None), 15: (5, "identified_exact", "id-5", True), 16: (None, "new", None, None),
    }


def test_contested_rows_are_claimed_once(spark):
    target = [(1, "m", None, "Harbor dredging permit", "a", True), (2, "m", "id-2", "Park fees schedule", "b", True), (3, "m", None, "Twin item", "c", False), (4, "m", None, "Twin item", "d", False)]
    source = [
        (11, "m", "x-1", "Harbor dredging permit", "a"), (12, "m", "x-2", "Harbor dredging permit", "a"), (13, "m", None, "Harbor dredging permit", "other"),
        (14, "m", "x-4", "Park fees schedule", "b"), (15, "m", "id-2", "Renamed altogether", "b"), (16, "m", None, "Park fees schedule", "b"), (17, "m", None, "Twin item", "e"), (18, "m", None, "Twin item", "c"),
    ]
    out = adopt(spark, target, source)
    assert out[11][:2] == (1, "exact")  # the first of three in order
    assert out[12][0] is None and out[13][0] is None
    assert out[15][:2] == (2, "identity") and out[14][0] is None and out[16][0] is None  # an identity that comes again isn't adopted by another
    assert out[18][:2] == (3, "exact") and out[17][:2] == (4, "title")  # once one twin is claimed, the other is the only one
    claimed = [v[0] for v in out.values() if v[0]]
    assert len(claimed) == len(set(claimed))


def test_repeated_and_empty_sources(spark):
    target = [(1, "m", None, "One title", "u", True), (2, "m", "", None, None, None), (3, None, "i", "t", "u", True)]
    source = [(11, "m", "i", "a b c", "u"), (12, "m", "i", "a b c", "u"), (13, "m", None, "One title", "u"), (14, "m", None, "ONE title", "u"), (15, "m", " ", None, None)]
    out = adopt(spark, target, source)
    assert set(out) == {11, 13, 15}
    assert out[13][:2] == (1, "exact") and out[15][:2] == (2, "exact") and out[11][0] is None
    assert adopt(spark, [], source)[13] == (None, "new", None, None)
    assert adopt(spark, target, []) == {}


CARD, ITEM = "card_id int, block string, title string, url string, number string, id string, points string", "item_id int, block string, title string, url string, number string, id string"


def cascade(spark, cards, items, **kw):
    c, i = spark.createDataFrame(cards, CARD), spark.createDataFrame(items, ITEM)
    return {r.card_id: (r.item_id, r.method) for r in matching.match_cascade(c, i, "block", "card_id", "item_id", **kw).collect()}


def test_cascade_and_its_stops(spark):
    items = [
        (1, "m", "Housing loan agreement for the North Fair Oaks development", "https://x/official", None, "a"), (2, "m", "Library renovation on East Avenue", "https://x/m", "4.1", "b"),
        (3, "m", "Library renovation on West Avenue", "https://x/m", "4.2.", "c"), (4, "m", "Water main repair on Oak Street", "https://x/m", "5", "d"), (5, "m", "Tree planting on Oak Street near the pond", "https://x/m", " 5. ", "e"),
        (6, "n", "Street sweeping schedule for downtown blocks", "https://x/n", None, "f"),
    ]
    cards = [
        (11, "m", "Fund new affordable housing near Middlefield Road", "https://x/official", None, None, ""), (12, "m", "Anything at all", "https://x/m", "4.1", None, ""), (13, "m", "Library renovation on West Avenue", None, "9", None, ""),
        (14, "m", "Tree planting on Oak Street near the pond", None, "5", None, ""), (15, "m", "Library renovation contract", None, None, None, ""), (16, "n", "Street sweeping schedule downtown", None, "7", None, ""),
        (17, "m", "Library renovation on West Avenue", None, None, None, ""), (18, "m", "Sweeping schedule for downtown blocks", None, None, None, ""), (19, "m", "", None, None, None, ""), (20, None, None, None, None, None, None),
    ]
    assert cascade(spark, cards, items) == {
        11: (1, "source_url"),  # wording doesn't matter
        12: (2, "agenda_number"),
        # 13: its number is nobody's while items are numbered, so its own title is of no use
        14: (5, "title"),  # two items of that number: the choice is among them
        # 15: two libraries are equally near
        16: (6, "title"),  # no item of that block is numbered
        17: (3, "title"),
        # 18: the item is of another block
    }


def test_numbers_conflict(spark):
    items = [(1, "m", "Resolution 2024-17 adopting parking rules downtown", None, None, "a")]
    cards = [(11, "m", "Resolution 2024-18 adopting parking rules downtown", None, None, None, ""), (12, "m", "Adopting parking rules downtown", None, None, None, "")]
    assert cascade(spark, cards, items) == {12: (1, "title")}


def test_source_items(spark):
    items = [
        (1, "m", "Affordable housing loan agreement", "https://x/m", None, "item-housing"), (2, "m", "Library renovation on East Avenue", "https://x/m", None, "twice"), (3, "m", "Library renovation on West Avenue", "https://x/m", None, "twice"),
        (4, "m", "Bridge inspection report for the river crossing", "https://x/m", None, "item-bridge"), (5, "m", "Nameless thing about ferries", "https://x/m", None, None),
    ]
    cards = [
        (11, "m", "Approve affordable housing loan", "https://x/m", None, None, ""), (12, "m", "Anything", "https://x/m", None, "item-bridge", ""), (13, "m", "Library renovation on East Avenue", "https://x/m", None, "twice", ""),
        (14, "m", "Inspection", "https://x/m", None, None, "bridge report for the river crossing"), (15, "m", " bridge inspection REPORT for the river crossing", None, None, "unknown", ""), (16, "m", "Nameless thing about ferries", None, None, None, ""),
    ]
    c, i = spark.createDataFrame(cards, CARD), spark.createDataFrame(items, ITEM)
    out = {r.card_id: (r.id, r.method) for r in matching.source_items(c, i, "block", "card_id", "id").collect()}
    assert out == {11: ("item-housing", "title"), 12: ("item-bridge", "known"), 14: ("item-bridge", "title_points"), 15: ("item-bridge", "exact_title")}


def test_structured_results(spark):
    items = [(1, "m", "Affordable housing loan agreement", "u1", None, "a"), (2, "m", "Library renovation on East Avenue", "u2", None, "b"), (3, "m", "Library renovation on East Avenue plans", "u2", None, "c")]
    cards = [(11, "m", "x", None, None, "a", ""), (12, "m", "x", "u1", None, None, ""), (13, "m", "x", "u2", None, None, ""), (14, "m", "Library renovation on East Avenue", None, None, "b", "")]
    c, i = spark.createDataFrame(cards, CARD), spark.createDataFrame(items, ITEM)
    out = {r.card_id: (r.item_id, r.method) for r in matching.structured_results(c, i, "block", "card_id", "item_id", "id", F.col("item_id") != 2).collect()}
    # item 2 has no result: its card falls back to the titles of those that have; a url of two items isn't specific, though one of them has no result
    assert out == {11: (1, "source_item_id"), 12: (1, "source_url"), 14: (3, "title")}


def _overlap(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else 0


@pytest.mark.parametrize("least, shared", [(0.72, 3), (0.5, 1), (1.0, 2)])
def test_similar_classes_lose_no_pair(spark, least, shared):
    rng = random.Random(int(least * 100))
    rows = [(i, rng.choice("xy"), sorted({f"w{rng.randrange(12)}" for _ in range(rng.randrange(8))})) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, block string, tokens array<string>")
    left, right = df.where("id < 80"), df.where("id >= 80")
    met = matching.similar_classes(matching.classes(left, ["block"], "id", "tokens"), matching.classes(right, ["block"], "id", "tokens"), ["block"], least, shared)
    found = {(r.block, tuple(r.lt), tuple(r.rt)) for r in met.collect()}
    want = {(b, tuple(t), tuple(u)) for i, b, t in rows[:80] for j, c, u in rows[80:] if b == c and len(set(t) & set(u)) >= shared and _overlap(set(t), set(u)) >= least}
    assert found == want and len(want) > 3


def test_same_item_classes_lose_no_pair(spark):
    rng = random.Random(8)
    words = ["approve", "state", "law", "update", "alpha", "beta", "gamma", "delta", "eps", "zeta", "17", "18"]
    rows = [(i, "m", sorted(rng.sample(words, rng.randrange(0, 9)))) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, block string, tokens array<string>")
    a, b = df.where("id < 120"), df.where("id >= 120")
    found = {(tuple(r.lt), tuple(r.rt)) for r in matching.same_item_classes(matching.classes(a, ["block"], "id", "tokens"), matching.classes(b, ["block"], "id", "tokens"), ["block"]).collect()}
    pairs = a.select(F.col("tokens").alias("lt")).crossJoin(b.select(F.col("tokens").alias("rt"))).where(said.same_item(F.col("lt"), F.col("rt")))
    assert found == {(tuple(r.lt), tuple(r.rt)) for r in pairs.collect()} and len(found) > 20


def test_a_hot_block_of_copies_stays_linear(spark):
    n = 20_000
    cards = spark.range(n).select("id", F.lit("m").alias("block"), F.lit("Renew the same lease of the harbor office").alias("title"))
    named = lambda df: df.withColumn("tokens", said.item_tokens(F.col("title")))
    one = spark.sql("SELECT 1L AS item, 'm' AS block, 'Lease of the harbor office' AS title")
    met = matching.guarded_match(named(cards), named(one), ["block"], "id", "item")
    assert met.count() == n and met.select("item").distinct().count() == 1
    two = one.union(one.selectExpr("2L", "block", "title"))
    assert matching.guarded_match(named(cards), named(two), ["block"], "id", "item").count() == 0  # a copy is a runner-up without a lead
    plan = matching.class_pairs(matching.classes(named(cards), ["block"], "id", "tokens"), matching.classes(named(cards), ["block"], "id", "tokens"), ["block"], lambda size: size)
    assert plan.count() == 1


def test_marks_and_synonyms(spark):
    titles = {"Café rates & increases": {"cafe", "rate", "increase"}, "East Palo Alto Sanitary District (EPASD) work-plan": {"epasd", "workplan"}, "Ｆｕｌｌ ﬁling ½": {"full", "filing", "1", "2"}, "Temporary Öffnung": {"offnung"}, "": set(), None: set()}
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", said.item_tokens(F.col("t")).alias("k"))
    assert {r.t: set(r.k) for r in df.collect()} == titles


def test_classes_of_cards(spark):
    items = ["Notice of special election", "Notice of a regular board meeting", "Notice of public hearing on parking", "A public hearing at the special meeting of the council", "Special meeting of the council", "Appoint a commissioner", "National parks month", "Item withdrawn"]
    df = spark.createDataFrame([(t,) for t in items], "t string").select("t", *[c.alias(n) for n, c in said.card_classes(F.col("t"), F.col("t")).items()])
    of = {r.t: {n for n in said.CLASS_POINTS if r[n]} for r in df.collect()}
    assert of == {items[0]: {"announcement"}, items[1]: {"procedural"}, items[2]: set(), items[3]: set(), items[4]: {"announcement"}, items[5]: {"procedural"}, items[6]: {"routine"}, items[7]: {"withdrawn"}}


def test_contained_titles_lose_no_pair(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("ab ", k=n))
    rows = [(i, rng.choice("xy"), word(rng.randrange(0, 14)) if i % 2 else word(rng.randrange(0, 6)), i % 2 == 1) for i in range(300)] + [(900, "x", None, True), (901, "x", None, False), (902, None, "a", False)]
    df = spark.createDataFrame(rows, "id int, block string, title string, bad boolean")
    want = {}
    for i, b, t, is_bad in rows:
        fits = [(-len(u), j) for j, c, u, other in rows if is_bad and not other and b is not None and b == c and t and u and u in t]
        if fits:
            want[i] = min(fits)[1]
    out = joins.duplicate_pairs(df, "id", ["block"], "title", F.col("bad"))
    assert {r.duplicate: r.canonical for r in out.collect()} == want and len(want) > 50


def test_sets_that_lack_too_many_words_are_not_paired(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    sets = spark.createDataFrame([(i, "m", sorted(rng.sample(words, 10))) for i in range(400)], "id int, block string, tokens array<string>")
    side = lambda cond: matching._marked(matching.classes(sets.where(cond), ["block"], "id", "tokens"))
    named = matching._asked(side("id < 200"), side("id >= 200"), ["block"], lambda size: size - 4)
    share = lambda df, name, t: df.select(F.col("set").alias(name), F.col("tokens").alias(t))
    pairs = share(side("id < 200"), "set", "lt").crossJoin(share(side("id >= 200"), "other", "rt")).where(F.size(F.array_intersect("lt", "rt")) >= 6)
    want, found = ({(r.set, r.other) for r in df.select("set", "other").collect()} for df in (pairs, named))
    # of 40,000 pairs nearly all share one of the words asked for
    assert want and want <= found and len(found) < 2 * len(want) + 100


def test_titles_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(title):
        reads.add(1)
        return title

    seen = F.udf(seen, "string").asNondeterministic()
    items = [(i, "m", f"Contract {i} for the repair of bridge number {i}", f"u{i}", None, f"id-{i}") for i in range(6)]
    cards = [(i, "m", f"Repair of bridge number {i}", None, None, None, f"contract {i}") for i in range(10, 14)] + [(14, "m", "repair of bridge number 3", None, None, "id-3", "")]
    c, i = (spark.createDataFrame(rows, shape).withColumn("title", seen("title")) for rows, shape in ((cards, CARD), (items, ITEM)))
    assert {r.card_id for r in matching.source_items(c, i, "block", "card_id", "id").collect()} == {14}
    assert reads.value == 11
    assert {r.card_id for r in matching.structured_results(c, i, "block", "card_id", "item_id", "id", F.col("item_id") > 0).collect()} == {14}
    assert reads.value == 22


def test_word_that_patterns_start_with_is_in_each_match():
    matches = ["capital improvement program (cip)", "capital improvement program", "public works & transportation commission", "east palo alto sanitary district ( epasd )", "east palo alto sanitary district", "senate bill", "rate", "increase", "disruption", "temporary", "work plan", "&"]
    for (pattern, _), match in zip(said.RESPELLED, matches, strict=True):
        assert re.fullmatch(pattern, match) and said._start(pattern) in match and len(said._start(pattern)) > 0


def test_long_sets_that_lack_too_many_words_are_not_paired(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(2000)]
    sets = spark.createDataFrame([(i, "m", sorted(rng.sample(words, 150 if i % 3 else 140))) for i in range(120)], "id int, block string, tokens array<string>")
    side = lambda cond: matching._marked(matching.classes(sets.where(cond), ["block"], "id", "tokens"))
    left, right = side("id < 60 OR id = 119").cache(), side("id >= 60").cache()
    found = matching._asked(left, right, ["block"], lambda size: F.ceil(size * 0.57).cast("int")).collect()
    assert len(found) < 20  # of 3,660 pairs, half of which 256 bits can't tell
    same = left.select("set").join(right.select("set"), "set").first()["set"]
    assert (same, same, True) in {(r.set, r.other, r.is_small) for r in found}


def test_titles_that_are_claimed_are_not_tokenized(spark, monkeypatch):
    reads = spark.sparkContext.accumulator(0)

    def seen(title):
        reads.add(1)
        return title

    seen, tokens = F.udf(seen, "string").asNondeterministic(), said.item_tokens
    monkeypatch.setattr(said, "item_tokens", lambda title: tokens(seen(title)))
    target = [(i, "m", f"id-{i}" if i % 2 else None, f"Lease {i} of the harbor office", "u", None) for i in range(20)] + [(30, "m", None, "Street trees on Main", "u", True), (31, "m", "id-31", "Park fees schedule", "u", True)]
    source = [(100 + i, "m", f"id-{i}" if i % 2 else None, f"Lease {i} of the harbor office", "u") for i in range(20)]
    source += [(130, "m", None, "Street trees on Main north side", "v"), (131, "m", None, "Park fees schedule for summer", "v"), (132, "m", None, "Nothing like it", "v")]
    out = adopt(spark, target, source)
    assert [out[k][:2] for k in (100, 101, 130, 131, 132)] == [(0, "exact"), (1, "identity"), (30, "fuzzy"), (31, "identified_fuzzy"), (None, "new")]
    # of 45 titles the five that no round by identity or title claims, once each
    assert reads.value == 5


def test_sets_too_short_to_expand_are_not_paired(spark, monkeypatch):
    paired = []
    kept = matching.staged
    monkeypatch.setattr(matching, "staged", lambda df, name: paired.append(out.count()) or out if (out := kept(df, name)) is not None and name == "pairs" else out)
    word = lambda i: f"w{chr(97 + i // 10)}{chr(97 + i % 10)}"
    rows = [(i, "m", ["oak", word(i)][: 1 + i % 2]) for i in range(40)] + [(100 + i, "m", sorted(["oak", word(i), word(i + 1), "x" + word(i)])) for i in range(40)] + [(200, "m", ["oak", "wah", "xwah"])]
    df = spark.createDataFrame(rows, "id int, block string, tokens array<string>")
    side = lambda cond: matching.classes(df.where(cond), ["block"], "id", "tokens")
    met = matching.same_item_classes(side("id < 40 OR id = 200"), side("id >= 100 AND id < 200"), ["block"]).collect()
    assert [(r.lt, r.rt) for r in met] == [(["oak", "wah", "xwah"], ["oak", "wah", "wai", "xwah"])]
    assert paired == [1]  # one of two words is in one or two of the others, one of one word in all
