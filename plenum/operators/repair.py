"""Repairs of stored meetings and cards: which duplicate survives, where its children go, and what is refused.

A repair is a plan over several tables at once: every child row gets an action (keep, move, drop) and the parent it ends with, so nothing
is lost unseen, and what would lose an outcome is a conflict row that stops its own group and no other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import civic_text as said
from plenum.functions.text import collapse
from plenum.operators import matching
from plenum.sources.stages import staged


@dataclass(frozen=True)
class Consolidation:
    """What merging meetings leaves: cards and other children with ``action`` and their meeting, and the pairs that are refused."""

    cards: DataFrame
    children: dict[str, DataFrame]
    conflicts: DataFrame


def _norm(title: str) -> Column:
    return F.lower(collapse(F.coalesce(F.col(title), F.lit(""))))


def consolidate(pairs: DataFrame, cards: DataFrame, outcomes: DataFrame, children: dict[str, DataFrame] | None = None, meeting: str = "meeting_id", card: str = "card_id", title: str = "title") -> Consolidation:
    """Fold each ``loser`` meeting of ``pairs`` into its ``survivor``; a meeting is in one pair at most.

    A loser's card goes if the survivor has one with its title or one that names the same item, and moves else; other children move.  A
    card that would go but has an outcome makes the pair a conflict, whose rows all keep their place.  outcomes: card, meeting; they follow their card.
    """
    # four frames read it: written once
    found = staged(_duplicates(pairs, cards, meeting, card, title), "duplicates")
    conflicts = found.join(outcomes.select(card).distinct(), card, "left_semi").select("loser", "survivor", card)
    sound = pairs.join(conflicts.select("loser").distinct(), "loser", "left_anti").select(F.col("loser").alias(meeting), "survivor")
    doomed = found.select(card).withColumn("is_copy", F.lit(True))
    told = cards.join(sound, meeting, "left").join(doomed, card, "left")
    action = F.when(F.col("survivor").isNull(), "keep").when(F.coalesce("is_copy", F.lit(False)), "drop").otherwise("move")
    planned = told.withColumn("action", action).withColumn(meeting, F.when(F.col("action") == "move", F.col("survivor")).otherwise(F.col(meeting))).select(*cards.columns, "action")

    def moved(df: DataFrame) -> DataFrame:
        own = df.join(sound, meeting, "left").withColumn("action", F.when(F.col("survivor").isNull(), "keep").otherwise("move"))
        return own.withColumn(meeting, F.coalesce("survivor", F.col(meeting))).select(*df.columns, "action")

    followed = outcomes.drop(meeting).join(planned.select(card, F.col(meeting), "action"), card, "left").select(*outcomes.columns, F.coalesce("action", F.lit("keep")).alias("action"))
    return Consolidation(planned, {"outcomes": followed, **{name: moved(df) for name, df in (children or {}).items()}}, conflicts)


def _duplicates(pairs: DataFrame, cards: DataFrame, meeting: str, card: str, title: str) -> DataFrame:
    """(loser, survivor, card): cards of losers that the survivor has too."""
    # both sides read it: the words of a title are made once
    titled = staged(cards.select(F.col(meeting), F.col(card), _norm(title).alias("plain"), said.item_tokens(F.col(title)).alias("tokens")), "titled")
    losing = titled.join(pairs.select(F.col("loser").alias(meeting), "survivor"), meeting).withColumnRenamed(meeting, "loser")
    staying = titled.join(pairs.select(F.col("survivor").alias(meeting)).distinct(), meeting).withColumnRenamed(meeting, "survivor")
    same_title = losing.join(staying.select("survivor", "plain").distinct(), ["survivor", "plain"], "left_semi").select("loser", "survivor", card)
    met = matching.same_item_classes(matching.classes(losing, ["survivor"], card, "tokens"), matching.classes(staying, ["survivor"], card, "tokens"), ["survivor"]).select("survivor", "lt").distinct()
    same_item = losing.withColumn("lt", F.array_sort(F.array_distinct("tokens"))).join(met, ["survivor", "lt"], "left_semi").select("loser", "survivor", card)
    return same_title.union(same_item).distinct()


def survivors(cards: DataFrame, outcomes: DataFrame, translations: DataFrame, group: Sequence[str], card: str, on_target: Column, featured: Column, published: Column, updated: Column) -> DataFrame:
    """``cards`` with ``survivor`` of their group (null if the group is a conflict) and ``is_conflict``.

    The highest score survives, of equal ones the smallest key: 1000 with an outcome, 100 times the best match score, 100 for each translation, 50 on the target
    meeting, 10 if featured, 5 if published, and the time of the last change in milliseconds by 1e13.  Outcomes that differ in item, url or headline conflict.
    """
    said_of = F.struct(F.col("matched_item_key"), F.col("source_url"), _norm("headline"))
    best = outcomes.groupBy(card).agg(F.max(F.coalesce("match_score", F.lit(0.0))).alias("best"), F.min(said_of).alias("least_said"), F.max(said_of).alias("most_said"))
    told = translations.groupBy(card).agg(F.count("*").alias("told"))
    flag = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)
    score = (
        flag(F.col("best").isNotNull(), 1000) + 100 * F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0))) + 100 * F.coalesce("told", F.lit(0)) + flag(on_target, 50) + flag(featured, 10) + flag(published, 5)
        + F.coalesce(F.unix_millis(updated), F.lit(0)) / 1e13
    )
    scored = cards.join(best, card, "left").join(told, card, "left").withColumn("score", score)
    of_group = scored.groupBy(*group).agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col(card).alias("k"))).alias("first"), F.count("best").alias("with_outcome"), F.min("least_said").alias("least_of"), F.max("most_said").alias("most_of")
    )
    clash = (F.col("with_outcome") > 1) & ~F.col("least_of").eqNullSafe(F.col("most_of"))
    chosen = of_group.select(*group, F.when(~clash, F.col("first.k")).alias("survivor"), clash.alias("is_conflict"))
    return scored.join(chosen, list(group)).select(*cards.columns, "score", "survivor", "is_conflict")


def fold_cards(chosen: DataFrame, children: dict[str, DataFrame], card: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The cards that survive, and every child table with its rows on the survivor of their card; rows of cards without a survivor stay where they are."""
    left = chosen.where(F.col("survivor").isNull() | (F.col("survivor") == F.col(card)))
    onto = chosen.where("survivor IS NOT NULL").select(F.col(card), "survivor")
    repointed = lambda df: df.join(onto, card, "left").withColumn(card, F.coalesce("survivor", F.col(card))).select(*df.columns)
    return left, {name: repointed(df) for name, df in children.items()}


def resolve_targets(children: DataFrame, meetings: DataFrame, urls: DataFrame, owner: str, meeting: str, kind: str, url: str, day: str, url_day: Column, fallback: Column) -> DataFrame:
    """``children`` with ``target``: the meeting that a child belongs to by its url, and ``method``.

    urls: (meeting, url) of all that a meeting links to.  The only meeting of the owner's kind with the url; of several the owner, if it is one; with no meeting, the only
    one of the kind on the day that the url names; else the owner where ``fallback`` allows it, and null where not.
    """
    of_kind = meetings.select(F.col(meeting), F.col(kind), F.col(day))
    linked = urls.distinct().join(of_kind, meeting)
    exact = linked.groupBy(kind, url).agg(F.count("*").alias("n_exact"), F.min(meeting).alias("by_url"))
    dated = of_kind.groupBy(kind, day).agg(F.count("*").alias("n_dated"), F.min(meeting).alias("by_day"))
    own = children.withColumn("named_day", url_day).join(of_kind.select(F.col(meeting).alias(owner), F.col(kind)), owner, "left")
    mine = urls.distinct().select(F.col(meeting).alias(owner), F.col(url), F.lit(True).alias("is_owners"))
    met = own.join(exact, [kind, url], "left").join(dated.withColumnRenamed(day, "named_day"), [kind, "named_day"], "left").join(mine, [owner, url], "left")
    may = F.coalesce(fallback, F.lit(False))
    method = (
        F.when(F.col(kind).isNull() | F.col(url).isNull(), "none").when(F.col("n_exact") == 1, "url").when((F.col("n_exact") > 1) & F.coalesce("is_owners", F.lit(False)), "owner_of_several")
        .when(F.col("n_exact").isNull() & (F.col("n_dated") == 1), "day").when(may, "fallback").otherwise("none")
    )
    told = met.withColumn("method", method)
    target = F.when(F.col("method") == "url", F.col("by_url")).when(F.col("method") == "day", F.col("by_day")).when(F.col("method").isin("owner_of_several", "fallback"), F.col(owner))
    return told.withColumn("target", target).select(*children.columns, "target", "method")
