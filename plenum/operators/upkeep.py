"""Upkeep of stored rows: backfills, marks, caps, recoveries, refreshes, and plans that say what changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.bands import last_at_or_before
from plenum.sources.readers import LOOKUP_ROWS
from plenum.sources.stages import staged

#: Characters that a stored text of each type keeps.
STORED_CHARS = {"Minutes": 2_000_000, "raw": 4_000}
STORED_OTHER = 500_000


def source_hash(*parts: Column) -> Column:
    """The SHA-256 of the parts as JSON strings, in order; a missing part counts as empty."""
    told = F.concat_ws(",", *[F.to_json(F.struct(F.coalesce(p.cast("string"), F.lit("")).alias("v"))) for p in parts])
    return F.sha2(told, 256)


def changed_sources(df: DataFrame, stored: DataFrame, key: str, hash_of: Column, known: str = "hashes") -> DataFrame:
    """The rows whose hash is none of those stored for their key (an array: the current and compatible older ones)."""
    kept = stored.select(F.col(key).alias("stored_key"), F.col(known).alias("stored_hashes"))
    joined = df.withColumn("source_hash", hash_of).join(kept, F.col(key) == F.col("stored_key"), "left")
    same = F.coalesce(F.array_contains("stored_hashes", F.col("source_hash")), F.lit(False))
    return joined.where(~same).drop("stored_key", "stored_hashes")


def backfill(df: DataFrame, source: DataFrame, key: str, column: str, candidates: Sequence[str]) -> DataFrame:
    """``df`` with missing values of a column taken from the first of the source's candidates that has one."""
    named = source.select(F.col(key).alias("from_key"), F.coalesce(*candidates).alias("from_value"))
    return df.join(named, F.col(key) == F.col("from_key"), "left").withColumn(column, F.coalesce(column, "from_value")).drop("from_key", "from_value")


def recover_runs(df: DataFrame, status: str, started: str, now: Column, after: str = "60 seconds") -> DataFrame:
    """``df`` with runs that still say running, though they started long ago, failed."""
    stuck = (F.col(status) == "running") & (F.col(started) < now - F.expr(f"INTERVAL {after}"))
    return df.withColumn(status, F.when(stuck, "failed").otherwise(F.col(status)))


def capped_text(text: Column, kind: Column) -> Column:
    """A text as it is stored: cut to what its type may keep."""
    most = F.lit(STORED_OTHER)
    for name, chars in STORED_CHARS.items():
        most = F.when(kind == name, chars).otherwise(most)
    return F.left(text, most)


def once_per_batch(df: DataFrame, batch: str, order: str, payload: str) -> DataFrame:
    """``df`` with a bulky payload only in the first row of each batch that has one; of rows at one place in the order one keeps it."""
    nth = F.row_number().over(Window.partitionBy(batch).orderBy(F.col(payload).isNull(), order))
    return df.withColumn("once_nth", nth).withColumn(payload, F.when(F.col("once_nth") == 1, F.col(payload))).drop("once_nth")


def refresh(target: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """The target with all rows of the owners in ``wanted`` replaced by these."""
    return target.join(wanted.select(owner).distinct(), owner, "left_anti").select(*target.columns).unionByName(wanted.select(*target.columns))


def prefer(df: DataFrame, key: Sequence[str], preferred: Column, order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first that is preferred, or else the first."""
    w = Window.partitionBy(*key).orderBy(F.coalesce(preferred, F.lit(False)).desc(), *order)
    return df.withColumn("prefer_nth", F.row_number().over(w)).where("prefer_nth = 1").drop("prefer_nth")


def rolled_up(df: DataFrame, group: Sequence[str], status: str) -> DataFrame:
    """The status of several runs together: failed if all are, completed if all are, running if any is, else partial."""
    is_ = lambda s: F.col(status) == s
    total = F.when(F.bool_or(is_("running")), "running").when(F.bool_and(is_("failed")), "failed").when(F.bool_and(is_("completed")), "completed").otherwise("partial")
    return df.groupBy(*group).agg(total.alias(status), F.count("*").alias("runs"))


def digest_marks(subscriptions: DataFrame, signals: DataFrame, key: str, topic: str, at: str, mark: str, width: int = 86_400) -> DataFrame:
    """Each subscription with the signals of its topic after its mark, their number, and the mark that sending them sets.

    Signals are counted by topic and instant first; how many there were up to a mark is the running count at the last instant at or before it,
    so the work is the subscriptions and the signals, sorted, and not one times the other.  width: seconds of a topic that one task sweeps.
    """
    counted = signals.where(F.col(topic).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(topic), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).agg(F.count("*").alias("n"))
    sliced = counted.withColumn("part", F.floor(F.col("us") / F.lit(width * 1_000_000)))
    parts = sliced.groupBy(topic, "part").agg(F.sum("n").alias("part_n"))
    before = parts.withColumn("n_before", F.coalesce(F.sum("part_n").over(Window.partitionBy(topic).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("n").over(Window.partitionBy(topic, "part").orderBy("us"))
    running = sliced.withColumn("within", within).join(before, [topic, "part"]).select(topic, "us", (F.col("within") + F.col("n_before")).alias("upto"))
    totals = running.groupBy(topic).agg(F.max("upto").alias("total"), F.max("us").alias("last_us"))
    asked = subscriptions.select(key, topic, mark, F.coalesce(F.unix_micros(F.col(mark).cast("timestamp")), F.lit(0)).alias("us"))
    met = last_at_or_before(asked, running, [topic], "us", ["upto"], width * 1_000_000).join(totals, topic, "left")
    new = F.coalesce(F.col("total") - F.coalesce("upto", F.lit(0)), F.lit(0))
    return met.select(key, topic, mark, new.alias("new_signals"), F.when(new > 0, F.timestamp_micros("last_us")).otherwise(F.col(mark)).alias("new_mark"))


def water_filled(df: DataFrame, group: Sequence[str], size: str, key: str, total: int) -> DataFrame:
    """``df`` with ``granted``: a budget dealt over the group's rows so that small ones get all they ask for and the others equal shares, the first ones the rest."""
    w = Window.partitionBy(*group).orderBy(size, key)
    ranked = df.withColumns({"fill_n": F.count("*").over(Window.partitionBy(*group)), "fill_i": F.row_number().over(w) - 1})
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.floor((F.lit(total) - F.col("fill_before")) / (F.col("fill_n") - F.col("fill_i")))
    # the level is the share of the first row, by size, that asks for more than its share
    ranked = ranked.withColumn("fill_before", before).withColumn("fill_level", F.when(F.col(size) > share, share))
    ranked = ranked.withColumn("fill_level", F.min(F.when(F.col("fill_level").isNotNull(), F.struct("fill_i", "fill_level"))).over(Window.partitionBy(*group)).getField("fill_level"))
    return ranked.withColumn("granted", F.least(F.col(size), F.coalesce("fill_level", F.col(size)))).drop("fill_n", "fill_i", "fill_before", "fill_level")


def nearest(left: DataFrame, right: DataFrame, block: Sequence[str], at: str, key: str, name: str, width: float = 1000) -> DataFrame:
    """``left`` with the key of the right row of its block whose position is nearest; of equals the first.

    The nearest is the last at or before or the first at or after, each found by a sliced sweep; positions and keys keep their types.
    """
    spots = right.groupBy(*block, F.col(at)).agg(F.min(key).alias("spot_key")).select(*block, at, "spot_key", F.col(at).alias("spot_at"))
    lower = last_at_or_before(left, spots, block, at, ["spot_key", "spot_at"], width).withColumnsRenamed({"spot_key": "low_key", "spot_at": "low_at"})
    turned = lambda df: df.withColumn("turned_at", -F.col(at))
    both = last_at_or_before(turned(lower), turned(spots), block, "turned_at", ["spot_key", "spot_at"], width)
    above = F.col("low_at").isNull() | (F.col("spot_at") - F.col(at) < F.col(at) - F.col("low_at"))
    return both.select(*left.columns, F.when(above, F.col("spot_key")).otherwise(F.col("low_key")).alias(name))


def union_by_id(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows of the frames, each key once: that of the first frame that has it, in its own table the smallest row."""
    tagged = None
    for n, df in enumerate(frames):
        one = df.withColumn("union_nth", F.lit(n))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (key, "union_nth")]
    return tagged.groupBy(key).agg(F.min(F.struct("union_nth", *rest)).alias("kept")).select(key, *[F.col(f"kept.{c}") for c in rest])


def without_leaked(links: DataFrame, meeting: str, day: str, url: str, url_day: Column) -> tuple[DataFrame, DataFrame]:
    """(links that stay, links that leak): a url that names a day and is linked from meetings of several days belongs to that day's alone."""
    days = links.select(url, day).where(F.col(url).isNotNull()).distinct()
    several = staged(days.groupBy(url).agg(F.min(day).alias("least_day"), F.max(day).alias("most_day")).where("least_day <> most_day").select(url), "several")
    # links of a url that names no other day stay, whatever else links it; where few urls are shared, no link is shuffled for them
    shared = F.broadcast(several) if several.count() <= LOOKUP_ROWS else several
    told = links.withColumn("named_day", url_day)
    other = F.col("named_day").isNotNull() & ~F.col("named_day").eqNullSafe(F.col(day))
    stay = told.where(~other).union(told.where(other).join(shared, url, "left_anti").select(*told.columns))
    return stay.select(*links.columns), told.where(other).join(shared, url, "left_semi").select(*links.columns, "named_day")


def folded_releases(meetings: DataFrame, key: Sequence[str], meeting: str, is_release: Column, has_agenda: Column, documents: str, text: str) -> DataFrame:
    """``meetings`` with each early release folded into the regular meeting of its body and day, the last with an agenda: documents united, texts joined in order.

    A release without such a meeting stays.  A null in the key is a value like any other.
    """
    told = meetings.withColumns({"is_release": F.coalesce(is_release, F.lit(False)), "is_regular": F.coalesce(has_agenda & ~F.coalesce(is_release, F.lit(False)), F.lit(False))})
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    regular = told.where("is_regular").groupBy(*key).agg(F.max(meeting).alias("owner"))
    owned = told.alias("m").join(regular.alias("r"), same("m", "r"), "left").select("m.*", "r.owner")
    extra = owned.where("is_release AND owner IS NOT NULL").groupBy(F.col("owner").alias("of")).agg(F.array_sort(F.collect_list(F.struct(F.col(meeting).alias("id"), F.col(documents).alias("d"), F.col(text).alias("t")))).alias("more"))
    left = owned.where("NOT is_release OR owner IS NULL").join(extra, F.col(meeting) == F.col("of"), "left")
    docs = F.array_distinct(F.concat(F.coalesce(F.col(documents), F.array().cast(meetings.schema[documents].dataType)), F.flatten(F.transform("more", lambda x: F.coalesce(x["d"], F.array().cast(meetings.schema[documents].dataType))))))
    texts = F.trim(F.regexp_replace(F.concat_ws(" ", F.array(F.col(text)), F.transform("more", lambda x: x["t"])), r"\s+", " "))
    return left.select(*[(F.when(F.col("of").isNotNull(), docs).otherwise(F.col(c)) if c == documents else F.when(F.col("of").isNotNull(), texts).otherwise(F.col(c)) if c == text else F.col(c)).alias(c) for c in meetings.columns])
