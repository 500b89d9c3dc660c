"""As-of joins of positions: the last mark at or before a position, found by one sorted sweep.

Marks and positions of a block are cut into slices of a fixed width, so that no block is one task; what a slice doesn't hold itself, the
last mark of an earlier slice, comes from a sweep over the slices' last marks alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_at_or_before(left: DataFrame, marks: DataFrame, block: Sequence[str], at: str, values: Sequence[str], width: float, order: Sequence[str] = ()) -> DataFrame:
    """``left`` with the ``values`` of the last mark of its block at its position ``at`` or before; of marks at one position the last by ``order``.

    Both sides are swept once by position.  width: how much of the positions a task holds of one block.
    """
    value = F.struct(*[F.col(v) for v in values])
    sliced = lambda df: df.withColumn("slice", F.floor(F.col(at) / F.lit(width)))
    rank = F.struct(F.col(at), *[F.col(o) for o in order])
    own = sliced(left).select(*block, "slice", F.col(at).alias("at"), F.lit(None).cast(marks.select(rank.alias("r")).schema["r"].dataType).alias("rank"), F.struct(*left.columns).alias("own"), F.lit(None).cast(marks.select(value.alias("v")).schema["v"].dataType).alias("mark"))
    placed = sliced(marks).select(*block, "slice", F.col(at).alias("at"), rank.alias("rank"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), value.alias("mark"))
    # nulls last: a position comes after the marks at the same place
    sweep = Window.partitionBy(*block, "slice").orderBy("at", F.col("rank").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = own.unionByName(placed).withColumn("found", F.last("mark", ignorenulls=True).over(sweep)).where("own IS NOT NULL")
    ends = placed.groupBy(*block, "slice").agg(F.max_by("mark", "rank").alias("end_mark"))
    asked = own.select(*block, "slice").distinct()
    slices = asked.join(ends, [*block, "slice"], "full")
    earlier = slices.withColumn("carried", F.last("end_mark", ignorenulls=True).over(Window.partitionBy(*block).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    out = met.join(earlier.drop("end_mark"), [*block, "slice"])
    answer = F.coalesce("found", "carried")
    return out.select("own.*", *[answer.getField(v).alias(v) for v in values])


def link_bands(links: DataFrame, lines: DataFrame, page: Sequence[str], y: str, line: str, number: str, is_end: Column, slack: float = 8, width: float = 1000) -> DataFrame:
    """``links`` with the ``number`` of the block of lines beside which they stand, null for none; y falls down the page.

    A block reaches from ``slack`` above the line that opens with a number to ``slack`` above the next such line, or above a line that ends
    blocks.  Lines at one height count in the order of ``line``.
    """
    down = lambda c: -F.col(y) - c
    opens = lines.where(F.col(number).isNotNull() | F.coalesce(is_end, F.lit(False)))
    marks = opens.select(*page, down(F.lit(slack)).alias("down"), F.col(line).alias("nth"), F.col(number).alias(number))
    placed = links.withColumn("down", down(F.lit(0)))
    return last_at_or_before(placed, marks, page, "down", [number], width, ["nth"]).drop("down")
