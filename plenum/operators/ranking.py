"""Orders, pages, pools, quotas and caps over cards.

All of these are top-k reports, where the limit is the feature: a global limit compiles to a
per-task top-k, and a rank per partition with a bound to a per-task rank limit, so neither sorts a
whole table in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pool of a listing over all jurisdictions, and the bounds of the share of each.
POOL_TOTAL, POOL_LEAST, POOL_MOST = 520, 40, 200
PAGE_SIZE_MOST, PAGE_MOST = 48, 500


def decision_order(featured: str, sort_time: str, created: str, key: str) -> list[Column]:
    """Featured first, then newest, then newest created, then greatest key: a total order over unique keys."""
    return [F.coalesce(F.col(featured), F.lit(False)).desc(), F.col(sort_time).desc_nulls_last(), F.col(created).desc_nulls_last(), F.col(key).desc()]


def public_interest_order(time: str, score: str, key: str, now: Column) -> list[Column]:
    """Future cards first, by score; of equal scores the future ones soonest first, past ones latest first."""
    ahead = F.col(time) >= now
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    return [ahead.desc(), F.col(score).desc(), F.when(ahead, seconds).otherwise(-seconds).asc_nulls_last(), F.col(key).desc()]


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The rows of one page; number and size are clamped to what a reader may ask for."""
    size = max(1, min(size, PAGE_SIZE_MOST))
    number = max(1, min(number, PAGE_MOST))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """One row: total, and pages (0 for an empty selection)."""
    size = max(1, min(size, PAGE_SIZE_MOST))
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def pool_size(jurisdictions: int) -> int:
    """Cards each jurisdiction contributes to a listing."""
    return POOL_LEAST if jurisdictions <= 0 else min(POOL_MOST, max(POOL_LEAST, POOL_TOTAL // jurisdictions))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_in_group") -> DataFrame:
    """The first ``n`` rows of each group, with their rank from 1 on."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def diverse_top(df: DataFrame, group: str, key: str, order: Sequence[Column], limit: int, per_group: int = 2) -> DataFrame:
    """The first ``limit`` rows with at most ``per_group`` of a group, filled up from the others if those don't suffice.

    A row without a group is a group of its own.  ``deferred`` tells the rows that filled up.
    """
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("key "), F.col(key).cast("string")))
    # no more than limit rows of a group can be chosen
    ranked = top_per_group(df.withColumn("diverse_group", own), ["diverse_group"], order, limit, "diverse_rank")
    marked = ranked.withColumn("deferred", F.col("diverse_rank") > per_group)
    return marked.orderBy("deferred", *order).limit(limit).drop("diverse_group", "diverse_rank")


def quota_mix(df: DataFrame, is_result: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """``limit`` rows, half of them (rounded up) results and the rest decisions; what one class lacks the other fills."""
    marked = df.withColumn("is_result", is_result)
    results = marked.where("is_result").orderBy(*order).limit(limit)
    decisions = marked.where("NOT is_result").orderBy(*order).limit(limit)
    few = results.unionByName(decisions)  # 2 * limit rows at most
    of_class = Window.partitionBy("is_result")
    few = few.withColumns({"place": F.row_number().over(of_class.orderBy(*order)), "of": F.count("*").over(of_class)})
    other = F.lit(limit) - F.when(F.col("is_result"), F.lit(limit // 2)).otherwise(F.lit(-(-limit // 2)))
    both = few.withColumn("others", F.coalesce(F.sum(F.lit(1)).over(Window.partitionBy(F.lit(1))) - F.col("of"), F.lit(0)))
    share = F.greatest(other, F.lit(limit) - F.col("others"))
    return both.where(F.col("place") <= share).drop("place", "of", "others")


def group_round_robin(df: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The best row of each group first, then the best of the rest: ``limit`` rows that represent as many groups as can be."""
    ranked = top_per_group(df, [group], order, limit, "robin_rank")
    return ranked.withColumn("is_extra", F.col("robin_rank") > 1).orderBy("is_extra", *order).limit(limit).drop("robin_rank")


def capped_children(df: DataFrame, parent: Sequence[str], eligible: Column, order: Sequence[Column], cap: int = 24) -> DataFrame:
    """``df`` with ``selected``: whether a row is among the first ``cap`` eligible ones of its parent."""
    nth = F.sum(eligible.cast("int")).over(Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("selected", eligible & (nth <= cap))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's code points (the fixed values are the algorithm's own)."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), step)


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows with the lowest hash of their key: the same sample every time."""
    return df.withColumn("sample_hash", fnv1a(key)).orderBy("sample_hash", key).limit(n)


def first_by_priority(df: DataFrame, parent: Sequence[str], priority: Column, usable: Column, order: Sequence[Column]) -> DataFrame:
    """One row per parent: the usable one of the best priority, or else the first of all."""
    return top_per_group(df, parent, [usable.desc(), F.when(usable, priority).asc_nulls_last(), *order], 1).drop("rank_in_group")
