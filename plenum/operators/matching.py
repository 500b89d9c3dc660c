"""Matches between rows of two tables by several rules, one after the other: unique keys first, words of titles last.

Word sets meet through their rarest words only.  If two sets share k words of the smaller, which has m, then one of its m - k + 1
rarest words is among the shared ones; so the smaller set asks with those, and the other answers with all of its words.
Copies are one class of their block until the end: the pairs compared are pairs of different word sets, however many rows have them.
A word that many sets of a block hold is asked for only by sets that have no rarer ones.  Each set carries marks of its words, so that
sets which lack too many of another's are told where they meet, before a pair of them is written or their words are fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import civic_text as said
from plenum.functions.text import collapse, numbers_conflict
from plenum.sources.stages import staged

#: Longs of 64 bits that mark a set's words.
MARKS = 8


def classes(df: DataFrame, block: Sequence[str], key: str, tokens: str) -> DataFrame:
    """(block, set, tokens, rows, first): the different word sets of each block, how many rows have each, and their smallest key."""
    sets = df.where(F.size(F.col(tokens)) > 0).select(*block, F.col(key).alias("key"), F.sort_array(F.array_distinct(F.col(tokens))).alias("tokens"))
    grouped = sets.groupBy(*block, "tokens").agg(F.count("*").alias("rows"), F.min("key").alias("first"))
    # a set's name; two sets with one name would only meet as a pair that fails the rule
    return grouped.withColumn("set", F.xxhash64(*block, "tokens"))


def _marked(sets: DataFrame) -> DataFrame:
    """Classes with ``MARKS`` longs that have a bit for each word: a bit that another set lacks stands for a word that it lacks."""
    bits = sets.withColumn("bits", F.transform("tokens", lambda w: F.xxhash64(w).bitwiseAND(F.lit(64 * MARKS - 1)).cast("int")))
    none = F.lit(0).cast("long")
    of = lambda j: F.aggregate("bits", none, lambda a, b: F.when(F.shiftright(b, 6) == j, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63))))).otherwise(a))
    return bits.withColumns({f"m{j}": of(j) for j in range(MARKS)}).drop("bits")


def listed(sets: DataFrame, name: str = "listed") -> DataFrame:
    """Classes written with their marks; those that are so already are as they were, so that several searches share them."""
    return sets if "m0" in sets.columns else staged(_marked(sets), name)


def _asked(left: DataFrame, right: DataFrame, block: Sequence[str], wanted: Callable[[Column], Column] | None = None, least: int = 1) -> DataFrame:
    """(set, other, is_small): pairs, and whether the left one is the smaller, where one of the smaller set's rarest words, all but ``wanted(size) - 1`` of them, is in the other, and marks don't tell that too few are.

    Without ``wanted`` the other must have all words, so the rarest one asks.  Sets of fewer than ``least`` words don't ask.
    """
    marks = [f"m{j}" for j in range(MARKS)]
    of = lambda df, is_left: df.select(F.lit(is_left).alias("is_left"), "set", F.size("tokens").alias("size"), F.explode("tokens").alias("word"), *block)
    # the hash of a block's word finds pairs only, which are compared whole, block and words; marks join where a word is asked for, so that words travel without them
    words = of(left, True).union(of(right, False)).select("is_left", "set", "size", F.xxhash64(*block, "word").alias("at"))
    at = Window.partitionBy("at")
    there = F.when(F.col("is_left"), F.sum(F.when(~F.col("is_left"), 1).otherwise(0)).over(at)).otherwise(F.sum(F.when(F.col("is_left"), 1).otherwise(0)).over(at))
    met = words.withColumn("often", there).where(F.col("often") > 0)
    need = F.col("size") if wanted is None else wanted(F.col("size"))
    if wanted is None:
        rare = met.where(F.col("size") >= least).groupBy("is_left", "set", "size").agg(F.count("*").alias("n"), F.min_by("at", "often").alias("at")).where("n = size")
    else:
        own = Window.partitionBy("is_left", "set")
        # words that the other side lacks come first: they are asked for in vain, and cost nothing
        place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "at"))
        rare = met.withColumn("place", place).where((F.col("size") >= least) & (F.col("place") <= F.col("size") - need + 1))
    # written, so that who asks and who is asked go by the same words
    rare = staged(rare.select("at", "is_left", "set", "size"), "rare")
    marked = left.select(F.lit(True).alias("is_left"), "set", *marks).union(right.select(F.lit(False).alias("is_left"), "set", *marks))
    asks = rare.join(marked, ["is_left", "set"]).select("at", *[F.col(c).alias(f"my_{c}") for c in ("is_left", "set", "size", *marks)])
    # a word that one side alone asks for is answered by the other
    asked = rare.select("at", (~F.col("is_left")).alias("is_left")).distinct()
    answers = words.join(asked, ["at", "is_left"], "left_semi").join(marked, ["is_left", "set"])
    lacking = sum((F.bit_count(F.col(f"my_{m}").bitwiseAND(F.bitwise_not(F.col(m)))) for m in marks), F.lit(0))
    smaller = (F.col("my_size") < F.col("size")) | (F.col("my_size") == F.col("size")) & F.col("my_is_left")
    mine = F.col("my_size") if wanted is None else wanted(F.col("my_size"))
    found = asks.join(answers, "at").where((F.col("my_is_left") != F.col("is_left")) & smaller & (lacking <= F.col("my_size") - mine))
    pick = lambda a, b: F.when(F.col("my_is_left"), F.col(a)).otherwise(F.col(b))
    return found.select(pick("my_set", "set").alias("set"), pick("set", "my_set").alias("other"), F.col("my_is_left").alias("is_small")).distinct()


def _paired(named: DataFrame, left: DataFrame, right: DataFrame, block: Sequence[str]) -> DataFrame:
    """Pairs of names as pairs of classes of one block; the words of the smaller go to the larger."""
    l = left.select(*block, "set", F.col("tokens").alias("lt"), F.col("rows").alias("l_rows"), F.col("first").alias("l_first"))  # noqa: E741
    r = right.select(*[F.col(b).alias(f"r_{i}") for i, b in enumerate(block)], F.col("set").alias("other"), F.col("tokens").alias("rt"), F.col("rows").alias("r_rows"), F.col("first").alias("r_first"))
    same = F.lit(True)
    for i, b in enumerate(block):
        same = same & (F.col(b) == F.col(f"r_{i}"))
    named = staged(named, "pairs")
    to_right, to_left = named.where("is_small").join(l, "set").join(r, "other"), named.where("NOT is_small").join(r, "other").join(l, "set")
    return to_right.unionByName(to_left).where(same).drop("set", "other", "is_small", *[f"r_{i}" for i in range(len(block))])


def class_pairs(left: DataFrame, right: DataFrame, block: Sequence[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """(block, lt, rt, l_rows, l_first, r_rows, r_first): pairs of word sets of which the smaller has ``wanted(its size)`` words in common with the other, and perhaps others."""
    l, r = listed(left, "left"), listed(right, "right")  # noqa: E741
    return _paired(_asked(l, r, block, wanted), l, r, block)


def _at_least(share: float, shared: int) -> Callable[[Column], Column]:
    return lambda size: F.greatest(F.lit(shared), F.ceil(F.round(size * share, 9)).cast("int"))


def similar_classes(left: DataFrame, right: DataFrame, block: Sequence[str], least: float, shared: int = 1) -> DataFrame:
    """Pairs of classes with ``common`` words and ``score``, their share of the smaller set, which is ``least`` or more."""
    met = class_pairs(left, right, block, _at_least(least, shared))
    common, size = F.size(F.array_intersect("lt", "rt")), F.least(F.size("lt"), F.size("rt"))
    # most pairs fail, and this fails them by one look at their words
    scored = met.where(common >= _at_least(least, shared)(size)).withColumns({"common": common, "score": common / size})
    return scored.where((F.col("common") >= shared) & (F.col("score") >= least))


def _of_class(rows: DataFrame, block: Sequence[str], key: str, tokens: str, found: DataFrame) -> DataFrame:
    """What was found for a class, for each of its rows."""
    sets = rows.select(*block, key, F.sort_array(F.array_distinct(F.col(tokens))).alias("lt"))
    return sets.join(found, [*block, "lt"])


def guarded_match(left: DataFrame, right: DataFrame, block: Sequence[str], left_key: str, right_key: str, tokens: str = "tokens", least: float = 0.72, shared: int = 3, margin: float = 0.15, conflict: Callable[[Column, Column], Column] = numbers_conflict) -> DataFrame:
    """(left_key, right_key, score): the best right row of the same block for each left row, if nothing speaks against it.

    Needs a similarity of ``least``, ``shared`` common tokens, no conflict of numbers, and a lead of
    ``margin`` over the runner-up, a copy among them; otherwise the row has no match.
    """
    return _guarded(left, classes(right, block, right_key, tokens), block, left_key, right_key, tokens, least, shared, margin, conflict)


def _guarded(left: DataFrame, right: DataFrame, block: Sequence[str], left_key: str, right_key: str, tokens: str = "tokens", least: float = 0.72, shared: int = 3, margin: float = 0.15, conflict: Callable[[Column, Column], Column] = numbers_conflict) -> DataFrame:
    """``guarded_match`` with the classes of the right rows."""
    # a runner-up that trails by the margin or more can't hinder
    met = similar_classes(classes(left, block, left_key, tokens), right, block, max(least - margin, 1e-9), shared)
    fit = met.where(~conflict(F.col("lt"), F.col("rt")))
    order = Window.partitionBy(*block, "lt").orderBy(F.desc("score"), "r_first")
    ranked = fit.withColumns({"place": F.row_number().over(order), "next": F.when(F.col("r_rows") > 1, F.col("score")).otherwise(F.lead("score").over(order))})
    won = (F.col("place") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)
    best = ranked.where(won).select(*block, "lt", F.col("r_first").alias(right_key), "score")
    return _of_class(left, block, left_key, tokens, best).select(left_key, right_key, "score")


def best_match(left: DataFrame, right: DataFrame, block: Sequence[str], left_key: str, right_key: str, tokens: str = "tokens", least: float = 0.6) -> DataFrame:
    """(left_key, right_key, score): the most similar right row of the same block, the first of equals, if it reaches ``least``."""
    met = similar_classes(classes(left, block, left_key, tokens), classes(right, block, right_key, tokens), block, least)
    best = met.groupBy(*block, "lt").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("r_first").alias("r"))).alias("best"))
    found = best.select(*block, "lt", F.col("best.r").alias(right_key), (-F.col("best.s")).alias("score"))
    return _of_class(left, block, left_key, tokens, found).select(left_key, right_key, "score")


def same_item_classes(left: DataFrame, right: DataFrame, block: Sequence[str]) -> DataFrame:
    """Pairs of classes that name one item.

    Titles that differ in rewording words alone are alike without those, so they meet by an equi-join; of a title that expands another, the
    shorter has all its words in the other, so its rarest one finds it.
    """
    l, r = listed(left, "left"), listed(right, "right")  # noqa: E741
    reworded = F.array_except("tokens", F.array(*[F.lit(w) for w in said.REWORDING]))
    bare = lambda df, name: df.select(F.xxhash64(*block, reworded).alias("bare"), F.col("set").alias(name), F.size("tokens").alias(f"{name}_size"))
    alike = bare(l, "set").join(bare(r, "other"), "bare").select("set", "other", (F.col("set_size") <= F.col("other_size")).alias("is_small"))
    # sets of one or two words name what equal sets do, and those are alike without the rewording words too
    named = alike.union(_asked(l, r, block, least=3)).distinct()
    return _paired(named, l, r, block).where(said.same_item(F.col("lt"), F.col("rt")))


# Claims


def _unique_claims(cards: DataFrame, rows: DataFrame, on: Sequence[str], rule: str) -> DataFrame:
    """(row_id, card_id, rule): rows alone with their values of ``on``, each for the first card that has those values."""
    alone = rows.groupBy(*on).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")).where("n = 1").drop("n")
    first = cards.groupBy(*on).agg(F.min_by("card_id", F.struct("ord", "card_id")).alias("card_id"))
    return alone.join(first, list(on)).select("row_id", "card_id", F.lit(rule).alias("rule"))


def _fuzzy_claims(cards: DataFrame, rows: DataFrame, block: str) -> DataFrame:
    """(row_id, card_id, rule): the rows that are the only ones to name a card's item, each for the first such card."""
    asks = cards.withColumn("ask", F.struct("ord", "card_id"))
    met = same_item_classes(classes(asks, [block], "ask", "tokens"), classes(rows, [block], "row_id", "tokens"), [block])
    # of the cards of a class the first asks for all
    only = met.groupBy(block, "lt").agg(F.sum("r_rows").alias("n"), F.min("r_first").alias("row_id"), F.min("l_first").alias("ask")).where("n = 1")
    return only.groupBy("row_id").agg(F.min("ask").alias("ask")).select("row_id", F.col("ask.card_id").alias("card_id"), F.lit("fuzzy").alias("rule"))


def adopt_children(target: DataFrame, source: DataFrame, parent: str, key: str, order: str, identity: str, title: str, url: str, state: Sequence[str] = ()) -> DataFrame:
    """Which stored child each new one of the same parent takes over: (key of source, parent, ``adopted`` key of target or null, ``rule``, identity, state...).

    Rounds of claims, each row claimed once, by the first of the source's rows in order, and out of the later rounds:
    identity; then among rows without an identity the only one with the title and url, with the title, that names the same item;
    then, for source rows without an identity alone, the same three among rows whose identity no source row has.  A row that is adopted keeps its
    identity where the source has none, and its ``state`` (flags, notes), which a new one has not.

    Of source rows with one identity, or without one with one title and url, the first counts.

    Equal titles are told by their SHA-256, and only what the rounds by title leave is tokenized, once.
    """
    norm = lambda c: F.lower(collapse(F.coalesce(F.col(c), F.lit(""))))
    sides = {"has": F.trim(F.coalesce(F.col(identity), F.lit(""))) != "", "identity": F.trim(F.col(identity)), "at": F.sha2(norm(title), 256), "link": norm(url), "title": F.col(title)}
    cards = source.select(F.col(key).alias("card_id"), F.col(order).alias("ord"), F.col(parent).alias("parent"), *[c.alias(n) for n, c in sides.items()])
    once = F.when(F.col("has"), F.struct(F.col("identity").alias("a"), F.lit("").alias("b"), F.lit(True).alias("c"))).otherwise(F.struct(F.col("at").alias("a"), F.col("link").alias("b"), F.lit(False).alias("c")))
    cards = staged(cards.withColumn("n", F.row_number().over(Window.partitionBy("parent", once).orderBy("ord", "card_id"))).where("n = 1").drop("n"), "cards")
    rows = staged(target.select(F.col(key).alias("row_id"), F.col(parent).alias("parent"), *[c.alias(n) for n, c in sides.items()]), "rows")
    claims = cards.where("has").join(rows.where("has"), ["parent", "identity"]).select("row_id", "card_id", F.lit("identity").alias("rule"))
    # an identity that several stored rows have goes to the last of them
    claims = staged(claims.groupBy("card_id", "rule").agg(F.max("row_id").alias("row_id")).select("row_id", "card_id", "rule"), "identity")
    asked_ids = cards.where("has").select("parent", "identity").distinct()
    legacy, adoptable = rows.where("NOT has"), rows.where("has").join(asked_ids, ["parent", "identity"], "left_anti")
    words = said.item_tokens(F.col("title")).alias("tokens")
    worded = None
    for which, free, may in (("", legacy, "true"), ("identified_", adoptable, "NOT has")):
        for rule in ("exact", "title", "fuzzy"):
            left = free.join(claims, "row_id", "left_anti")
            still = (cards if worded is None or rule != "fuzzy" else worded).where(may).join(claims, "card_id", "left_anti")
            if rule == "fuzzy":
                # written, since a filter by tokens would be pushed below the join and make those of all rows
                left = staged(left.select("row_id", "parent", words), "left_over")
                if worded is None:
                    still = worded = staged(still.select("card_id", "ord", "parent", "has", words), "worded")
                new = _fuzzy_claims(still, left, "parent")
            else:
                new = _unique_claims(still, left, ["parent", "at"] + (["link"] if rule == "exact" else []), rule)
            # a card may be the first for several rows by one rule only if it asks with one key, so it claims one
            claims = staged(claims.union(new.select("row_id", "card_id", F.concat(F.lit(which), "rule"))), f"{which}{rule}")
    kept = target.select(F.col(key).alias("adopted"), F.col(identity).alias("old_identity"), *[F.col(c) for c in state])
    out = cards.join(claims.withColumnRenamed("row_id", "adopted"), "card_id", "left").join(kept, "adopted", "left")
    return out.select(F.col("card_id").alias(key), F.col("parent").alias(parent), "adopted", F.coalesce("rule", F.lit("new")).alias("rule"), F.when(F.col("has"), F.col("identity")).otherwise(F.col("old_identity")).alias(identity), *state)


# The cascade of matches


def match_cascade(cards: DataFrame, items: DataFrame, block: str, key: str, item_key: str, title: str = "title", url: str = "url", number: str = "number", **guards) -> DataFrame:
    """(key, item_key, method, score): the item of the same block that a card is about.

    First the only item with the card's url (``url`` may hold an array on the items' side).  Then, where the card has a number: the only item with it;
    several narrow the choice to them; none, while the block has numbered items, ends without a match.  Last the title, guarded.
    """
    asks = staged(cards.select(F.col(block).alias("block"), F.col(key).alias("k"), _present(F.col(url)).alias("u"), said.agenda_number(F.col(number)).alias("n"), said.item_tokens(F.col(title)).alias("tokens")), "asks")
    has = staged(items.select(F.col(block).alias("block"), F.col(item_key).alias("i"), _urls(items, url).alias("us"), said.agenda_number(F.col(number)).alias("n"), said.item_tokens(F.col(title)).alias("tokens")), "has")
    by_url = _only_urls(has)
    numbers = has.where("n IS NOT NULL").groupBy("block", "n").agg(F.count("*").alias("same"), F.min("i").alias("by_number"))
    numbered = numbers.select("block").distinct().withColumn("is_numbered", F.lit(True))
    told = asks.join(by_url.withColumnRenamed("i", "by_url"), ["block", "u"], "left").join(numbers, ["block", "n"], "left").join(numbered, "block", "left")
    step = (
        F.when(F.col("by_url").isNotNull(), "source_url")
        .when(F.col("n").isNull() | F.col("is_numbered").isNull(), "title")
        .when(F.col("same").isNull(), "none")
        .when(F.col("same") == 1, "agenda_number")
        .otherwise("narrowed")
    )
    told = told.withColumn("step", step)
    # a title is looked for among all items of the block, or among those of its number; items are there once for each
    scope = F.when(F.col("step") == "narrowed", F.col("n"))
    open_cards = told.where("step IN ('title', 'narrowed')").select("block", F.coalesce(scope, F.lit("")).alias("scope"), "k", "tokens")
    narrow = has.join(numbers.where("same > 1").select("block", "n"), ["block", "n"], "left_semi")
    open_items = has.select("block", F.lit("").alias("scope"), "i", "tokens").unionByName(narrow.select("block", F.col("n").alias("scope"), "i", "tokens"))
    by_title = guarded_match(open_cards, open_items, ["block", "scope"], "k", "i", conflict=said.numbers_differ, **guards)
    sure = told.where("step IN ('source_url', 'agenda_number')").select("k", F.when(F.col("step") == "source_url", F.col("by_url")).otherwise(F.col("by_number")).alias("i"), F.col("step").alias("method"), F.lit(1.0).alias("score"))
    out = sure.unionByName(by_title.select("k", "i", F.lit("title").alias("method"), "score"))
    return out.select(F.col("k").alias(key), F.col("i").alias(item_key), "method", "score")


def _present(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def _urls(items: DataFrame, url: str) -> Column:
    """The different urls of an item, of which ``url`` holds one or an array."""
    urls = F.col(url) if items.schema[url].dataType.typeName() == "array" else F.array(F.col(url))
    return F.array_distinct(F.transform(urls, lambda u: F.trim(u)))


def _only_urls(items: DataFrame) -> DataFrame:
    """(block, u, i): urls that one item of a block alone has."""
    return items.select("block", "i", F.explode("us").alias("u")).where("u IS NOT NULL AND u <> ''").groupBy("block", "u").agg(F.count("*").alias("many"), F.min("i").alias("i")).where("many = 1").drop("many")


def _unnumbered(asks: DataFrame, urls: DataFrame, items: DataFrame, tokens: str) -> DataFrame:
    """(k, i, method, score): the cascade of asks without numbers, over the items' ``_only_urls`` and ``listed`` classes."""
    by_url = asks.join(urls, ["block", "u"]).select("k", "i", F.lit("source_url").alias("method"), F.lit(1.0).alias("score"))
    by_title = _guarded(asks.join(urls, ["block", "u"], "left_anti"), items, ["block"], "k", "i", tokens, conflict=said.numbers_differ)
    return by_url.unionByName(by_title.select("k", "i", F.lit("title").alias("method"), "score"))


def known_ids(items: DataFrame, block: str, identity: str) -> DataFrame:
    """(block, identity, item's key): identities that one item of a block alone has."""
    named = items.where(F.trim(F.coalesce(F.col(identity), F.lit(""))) != "")
    return named.groupBy(block, F.trim(F.col(identity)).alias(identity)).agg(F.count("*").alias("n")).where("n = 1").drop("n")


def source_items(cards: DataFrame, items: DataFrame, block: str, key: str, identity: str, title: str = "title", points: str = "points", url: str = "url") -> DataFrame:
    """(key, identity, method): the identity of the item that a card comes from, which must be one item's alone.

    The card's own if it is known; the item of the only equal title; a guarded match of the title, then of the title with the points.
    Both sides are read and tokenized once, and each answer is written before the next is looked for.
    """
    named = F.trim(F.col(identity)).alias("id")
    plain = F.lower(collapse(F.coalesce(F.col(title), F.lit("")))).alias("plain")
    words = said.item_tokens(F.col(title)).alias("tokens")
    has = staged(items.select(F.col(block).alias("block"), named, _urls(items, url).alias("us"), plain, words).withColumn("i", F.struct("id")), "items")
    more = said.item_tokens(F.concat_ws(" ", F.col(title), F.col(points))).alias("more")
    asks = staged(cards.select(F.col(block).alias("block"), F.col(key).alias("k"), named, _present(F.col(url)).alias("u"), plain, words, more), "asks")
    known = staged(known_ids(has, "block", "id"), "known")
    own = asks.select("k", "block", "id").join(known, ["block", "id"], "left_semi").select("k", "id", F.lit("known").alias("method"))
    only = has.groupBy("block", "plain").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    found = staged(own, "own")
    by_title = asks.drop("id").join(found, "k", "left_anti").join(only, ["block", "plain"]).join(known, ["block", "id"], "left_semi")
    found = found.unionByName(staged(by_title.select("k", "id", F.lit("exact_title").alias("method")), "exact"))
    urls, sets = staged(_only_urls(has), "urls"), listed(classes(has, ["block"], "i", "tokens"))
    # the title alone is asked first; only what it leaves is asked with the points
    for name, tokens in (("title", "tokens"), ("title_points", "more")):
        left = asks.select("block", "k", "u", tokens).join(found, "k", "left_anti")
        met = _unnumbered(left, urls, sets, tokens).select("k", F.col("i.id").alias("id")).join(asks.select("k", "block"), "k")
        # a match that no known item answers still ends the search
        told = met.join(known.withColumn("is_known", F.lit(True)), ["block", "id"], "left")
        found = found.unionByName(staged(told.select("k", F.when(F.col("is_known"), F.col("id")).alias("id"), F.lit(name).alias("method")), name))
    return found.where("id IS NOT NULL").select(F.col("k").alias(key), F.col("id").alias(identity), "method")


def structured_results(cards: DataFrame, items: DataFrame, block: str, key: str, item_key: str, identity: str, has_result: Column, title: str = "title", url: str = "url") -> DataFrame:
    """(key, item_key, method, score): the item whose recorded result is a card's: the one of its identity, else a guarded match among items with results.

    A url counts only if it is one item's alone, of all items; an identity likewise.
    """
    decided = F.coalesce(has_result, F.lit(False))
    named = F.trim(F.col(identity)).alias("id")
    # only titles that may match are tokenized
    has = staged(items.select(F.col(block).alias("block"), F.col(item_key).alias("i"), named, _urls(items, url).alias("us"), decided.alias("decided"), F.when(decided, said.item_tokens(F.col(title))).alias("tokens")), "items")
    asks = staged(cards.select(F.col(block).alias("block"), F.col(key).alias("k"), named, _present(F.col(url)).alias("u"), said.item_tokens(F.col(title)).alias("tokens")), "asks")
    known = has.where("decided").select("block", "id", "i").join(known_ids(has, "block", "id"), ["block", "id"], "left_semi")
    by_id = staged(asks.select("k", "block", "id").join(known, ["block", "id"]).select("k", "i", F.lit("source_item_id").alias("method"), F.lit(1.0).alias("score")), "by_id")
    urls = staged(_only_urls(has).join(has.where("decided").select("block", "i"), ["block", "i"], "left_semi"), "urls")
    rest = asks.select("block", "k", "u", "tokens").join(by_id, "k", "left_anti")
    out = by_id.unionByName(_unnumbered(rest, urls, classes(has.where("decided"), ["block"], "i", "tokens"), "tokens"))
    return out.select(F.col("k").alias(key), F.col("i").alias(item_key), "method", "score")
