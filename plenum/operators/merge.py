"""Keyed writes as DataFrame functions: the target's rows after an upsert, a refresh or a clean-up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def collapse(source: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: of each column the last value that isn't null."""
    rest = [c for c in source.columns if c not in (*key, order)]
    return source.groupBy(*key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], preserve: Sequence[str] = (), state: Sequence[str] = ()) -> DataFrame:
    """The target with the source's rows in place of its own of the same key.

    preserve: columns that keep the target's value where the source has none.
    state: columns that only the target decides on, once it has the row (curated flags and notes).
    Each side has one row per key at most.  One full join, partitioned by the key.
    """
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("in_target"))
    s = source.withColumn("in_source", F.lit(True))
    on = None
    for k in key:
        same = s[k].eqNullSafe(t[f"t_{k}"])
        on = same if on is None else on & same
    joined = s.join(t, on, "full")
    cols = []
    for c in target.columns:
        mine = F.col(c) if c in source.columns else F.lit(None)
        if c in state or c not in source.columns:
            new = F.when(F.col("in_target"), F.col(f"t_{c}")).otherwise(mine)
        elif c in preserve:
            new = F.coalesce(mine, F.col(f"t_{c}"))
        else:
            new = mine
        cols.append(F.when(F.col("in_source"), new).otherwise(F.col(f"t_{c}")).alias(c))
    return joined.select(*cols)


def replace_children(target: DataFrame, source: DataFrame, parent: str, key: Sequence[str], flags: Sequence[str], title: str | None = None) -> DataFrame:
    """The target with the children of the source's parents replaced; flags survive where the key does, or else the ``title``, in any case and spacing.

    Parents that the source hasn't, and so those for which it came empty, keep theirs.
    """

    def kept(on: dict[str, Column], prefix: str) -> DataFrame:
        named = target.select(F.col(parent), *[c.alias(n) for n, c in on.items()], *[F.col(f).alias(f"{prefix}{f}") for f in flags])
        return named.groupBy(parent, *on).agg(*[F.max(f"{prefix}{f}").alias(f"{prefix}{f}") for f in flags], F.lit(True).alias(f"{prefix}is"))

    plain = {} if title is None else {"plain_title": F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"\s+", " ")))}
    fresh = source.withColumns(plain).join(kept({k: F.col(k) for k in key}, "key_"), [parent, *key], "left")
    old = {f: F.col(f"key_{f}") for f in flags}
    if plain:
        fresh = fresh.join(kept(plain, "title_"), [parent, "plain_title"], "left")
        old = {f: F.when(F.col("key_is"), F.col(f"key_{f}")).otherwise(F.col(f"title_{f}")) for f in flags}
    fresh = fresh.withColumns({f: F.coalesce(old[f], F.col(f)) for f in flags})
    rest = target.join(source.select(parent).distinct(), parent, "left_anti")
    return rest.select(*target.columns).unionByName(fresh.select(*target.columns))


def drop_obsolete(target: DataFrame, current: DataFrame, key: Sequence[str], protected: Column) -> DataFrame:
    """The target less the rows that current ones no longer have and nothing protects."""
    alive = target.join(current.select(*key).distinct().withColumn("is_current", F.lit(True)), list(key), "left")
    return alive.where(F.coalesce("is_current", F.lit(False)) | F.coalesce(protected, F.lit(False))).select(*target.columns)


def guarded_write(target: DataFrame, source: DataFrame, key: Sequence[str], derived: dict, checks: dict, stamp: str | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the target after the write, rejected rows of the source with ``reasons``): an upsert that keeps dependent columns in step and refuses rows.

    derived: column -> function of ``new``, ``old`` and ``is_insert`` that gives its value; ``new(c)`` and ``old(c)`` are a column's value in the row written and the one
    it replaces, null without one.  They are set in order, each seeing those before.  checks: name -> function of ``value`` (a column's value in the finished row),
    false for a violation, null for none.  stamp: a column that is set to ``now`` where a row replaces one.  A rejected row leaves the stored one as it was.  Each side has
    one row per key at most, and source columns that the target lacks don't count.
    """
    cols = target.columns
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in cols], F.lit(True).alias("in_target"))
    s = source.select(*[(F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType)).alias(f"s_{c}") for c in cols], F.lit(True).alias("in_source"))
    on = None
    for k in key:
        same = F.col(f"s_{k}").eqNullSafe(F.col(f"t_{k}"))
        on = same if on is None else on & same
    met = s.join(t, on, "full")
    is_insert = F.col("in_target").isNull()
    # a column that the source doesn't have keeps its stored value
    fresh = {c: F.col(f"s_{c}") if c in source.columns else F.col(f"t_{c}") for c in cols}
    met = met.select("*", *[v.alias(f"n_{c}") for c, v in fresh.items()])
    for c, make in derived.items():
        met = met.withColumn(f"n_{c}", make(lambda x: F.col(f"n_{x}"), lambda x: F.col(f"t_{x}"), is_insert))
    if stamp is not None:
        met = met.withColumn(f"n_{stamp}", F.when(is_insert, F.col(f"n_{stamp}")).otherwise(now))
    broken = [F.when(~F.coalesce(check(lambda x: F.col(f"n_{x}")), F.lit(True)), F.lit(name)) for name, check in checks.items()]
    met = met.withColumn("reasons", F.filter(F.array(*broken), lambda r: r.isNotNull()) if broken else F.array().cast("array<string>"))
    takes = F.coalesce("in_source", F.lit(False)) & (F.size("reasons") == 0)
    after = met.where(takes | F.col("in_target").isNotNull()).select(*[F.when(takes, F.col(f"n_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in cols])
    refused = met.where(F.col("in_source").isNotNull() & (F.size("reasons") > 0)).select(*[F.col(f"n_{c}").alias(c) for c in cols], "reasons")
    return after, refused


def points_in_step(points: str, text: str) -> dict:
    """Derived columns for a list of points and their text: the text follows the list where that came or changed, else the list follows the text's lines."""
    joined = lambda p: F.array_join(p, "\n")
    lines = lambda t: F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = lambda new, old, ins: new(points).isNotNull() & (ins | ~new(points).eqNullSafe(old(points)))
    told = lambda new, old, ins: new(text).isNotNull() & (ins | ~new(text).eqNullSafe(old(text)))
    return {
        text: lambda new, old, ins: F.when(listed(new, old, ins), joined(new(points))).otherwise(new(text)),
        points: lambda new, old, ins: F.when(told(new, old, ins), lines(new(text))).otherwise(new(points)),
    }


def write_batches(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: str, most_rows: int, most_size: int) -> DataFrame:
    """``df`` with ``batch``: rows in order, a new batch where the next row would exceed the rows or the size; an oversized row goes alone.

    A batch starts where the one before ends, so a group's rows pass one task in order; the task holds the state of one group and
    one Arrow batch, however many rows there are.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, batch, rows, total = None, 0, 0, 0
        for frame in batches:
            out = []
            for own, n in zip(zip(*[frame.column(g).to_pylist() for g in group]), frame.column(size).to_pylist()):
                if own != current:
                    current, batch, rows, total = own, 0, 0, 0
                if rows and (rows >= most_rows or total + (n or 0) > most_size):
                    batch, rows, total = batch + 1, 0, 0
                rows, total = rows + 1, total + (n or 0)
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out, pa.int32())], [*frame.schema.names, "batch"])

    dealt = df.repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(numbered, StructType([*df.schema.fields, StructField("batch", IntegerType())]))


def reconcile_status(df: DataFrame, status: str, effective: Column) -> DataFrame:
    """``df`` with the effective status, and whether it differs from the stored one."""
    return df.withColumn("new_status", effective).withColumn("is_changed", ~F.col("new_status").eqNullSafe(F.col(status)))
