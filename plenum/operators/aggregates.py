"""Counts, coverage, groups and plans over keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal, halves up; null over nothing."""
    return F.when(whole > 0, F.floor(part * 1000 / whole + 0.5) / 10)


def filled(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Every row of the dimension, with what the facts have of it or nulls."""
    return dimension.join(facts, key, "left")


def occurring_once(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key no other row has."""
    once = df.groupBy(*key).agg(F.count("*").alias("times")).where("times = 1").select(*key)
    return df.join(once, list(key), "left_semi")


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of the rows of a key the first in order."""
    return df.withColumn("first_wins", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("first_wins = 1").drop("first_wins")


def merge_group(df: DataFrame, key: Sequence[str], order: str, first: Sequence[str] = (), longest: Sequence[str] = (), flags: Sequence[str] = (), union: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first non-null, the longest text, whether any flag is set, and the sorted union of values."""
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    aggs += [F.min(F.when(F.col(c).isNotNull(), F.struct((-F.length(c)).alias("n"), F.col(order).alias("o"), F.col(c).alias("t")))).getField("t").alias(c) for c in longest]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    aggs += [F.array_sort(F.collect_set(c)).alias(c) for c in union]
    return df.groupBy(*key).agg(*aggs, F.count("*").alias("merged_rows"))


def duplicate_plan(df: DataFrame, key: Sequence[str], row_id: str, created: str, has_outcome: str) -> DataFrame:
    """For each key with several rows: the newest row survives; an outcome of another moves to it; several outcomes are ambiguous."""
    newest = F.max(F.struct(F.col(created), F.col(row_id)))
    plan = df.groupBy(*key).agg(
        F.count("*").alias("copies"), newest.getField(row_id).alias("survivor"), F.count_if(F.col(has_outcome)).alias("outcomes"),
        F.max(F.when(F.col(has_outcome), F.col(row_id))).alias("outcome_row"),
    )
    return plan.where("copies > 1").withColumn("is_ambiguous", F.col("outcomes") > 1).withColumn(
        "moves_outcome", ~F.col("is_ambiguous") & F.coalesce(F.col("outcome_row") != F.col("survivor"), F.lit(False))
    )


def canonical_assignment(df: DataFrame, key: str, card: str, is_minutes: str, rank: str, score: str, created: str, top_rank: int = 4, lead: float = 0.15) -> DataFrame:
    """The card that stands for each official item: (key, card); keys without one are ambiguous and left out.

    A single proposal wins; else the only one not from minutes; else, if all match by identity, the
    earliest; else the first by rank and score, if the second has a lower rank or a score ``lead`` lower.
    """
    w = Window.partitionBy(key)
    seen = df.withColumns({"n": F.count("*").over(w), "others": F.sum((~F.col(is_minutes)).cast("int")).over(w), "lowest": F.min(rank).over(w)})
    earliest = F.row_number().over(w.orderBy(F.col(created).asc_nulls_last(), card))
    best = w.orderBy(F.desc(rank), F.desc(score), card)
    seen = seen.withColumns({"by_time": earliest, "by_rank": F.row_number().over(best), "next_rank": F.lead(rank).over(best), "next_score": F.lead(score).over(best)})
    clear = (F.col("by_rank") == 1) & ((F.col("next_rank") < F.col(rank)) | (F.col(score) - F.col("next_score") >= lead))
    wins = (
        F.when(F.col("n") == 1, F.lit(True))
        .when(F.col("others") == 1, ~F.col(is_minutes))
        .when(F.col("lowest") == top_rank, F.col("by_time") == 1)
        .otherwise(F.coalesce(clear, F.lit(False)))
    )
    return seen.where(wins).select(key, card)


def problems(df: DataFrame, checks: dict[str, Column], name: str = "problems") -> DataFrame:
    """``df`` with an array of the names of the checks that a row fails."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return df.withColumn(name, found)


def gap_clusters(df: DataFrame, group: Sequence[str], position: str, gap: float, margin: float = 0) -> DataFrame:
    """(group, cluster, first, last, members): runs of positions no further apart than ``gap``, widened by ``margin``."""
    w = Window.partitionBy(*group).orderBy(position)
    starts = F.coalesce(F.col(position) - F.lag(position).over(w) > gap, F.lit(True)).cast("int")
    run = df.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*group, "cluster").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("members"))
    return out.withColumns({"first": F.col("first") - margin, "last": F.col("last") + margin})


def running_budget(df: DataFrame, group: Sequence[str], order: Sequence[Column], cost: str, limit: float) -> DataFrame:
    """The rows of each group before the first whose running cost exceeds the limit."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= limit)


def failure_streaks(df: DataFrame, group: Sequence[str], order: Sequence[Column], failed: Column) -> DataFrame:
    """(group, streak): the longest run of failures of each group; 0 without any."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumns({"failed_row": failed}).withColumn("island", F.sum((~F.col("failed_row")).cast("int")).over(w))
    runs = run.groupBy(*group, "island").agg(F.count_if("failed_row").alias("n"))
    return runs.groupBy(*group).agg(F.max("n").alias("streak"))
