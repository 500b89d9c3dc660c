"""Streams of signals: idempotent ingestion, weekly windows, and a keyed rate limiter with its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ANSWER = "key string, id long, at double, allowed boolean, retry_after int"


@dataclass(frozen=True)
class Limit:
    """At most ``count`` events of a key in ``window`` seconds from its first; the next one blocks the key for ``block`` seconds."""

    count: int
    window: float
    block: float

    def step(self, state: tuple | None, at: float) -> tuple[tuple, bool, int]:
        """(window start, events, blocked until) after an event, whether it is allowed, and the seconds to wait if not."""
        start, n, until = state or (at, 0, None)
        if until is not None and until > at:
            return (start, n, until), False, max(1, -int(-(until - at) // 1))
        if start + self.window <= at:
            return (at, 1, None), True, 0
        if n >= self.count:
            return (start, n, at + self.block), False, int(self.block)
        return (start, n + 1, None), True, 0


def _named(events: DataFrame, key: str, row_id: str, at: str) -> DataFrame:
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    return events.select(F.col(key).cast("string").alias("key"), F.col(row_id).cast("long").alias("id"), seconds.alias("at"))


def rate_limit(events: DataFrame, limit: Limit, key: str, row_id: str, at: str) -> DataFrame:
    """Each event's answer.  Keys are dealt over partitions and sorted; a task keeps the state of one key at a time, however many events it has."""

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            told = []
            for k, t in zip(frame["key"], frame["at"]):
                if k != current:
                    current, state = k, None
                state, allowed, wait = limit.step(state, t)
                told.append((allowed, wait))
            yield frame.assign(allowed=[a for a, _ in told], retry_after=[w for _, w in told])

    dealt = _named(events, key, row_id, at).repartition("key").sortWithinPartitions("key", "at", "id")
    return dealt.mapInPandas(answer, _ANSWER)


def rate_limit_stream(events: DataFrame, limit: Limit, key: str, row_id: str, at: str) -> DataFrame:
    """The same over a stream, in the order of arrival by batch and of time within it; a key's state goes when its window and block are over."""

    def answer(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        # a key's events of one batch, in time order
        frame = pd.concat(list(frames)).sort_values(["at", "id"])
        state = None
        if held.exists:
            start, n, until = held.get
            state = (start, n, until if until >= 0 else None)
        told = []
        for t in frame["at"]:
            state, allowed, wait = limit.step(state, t)
            told.append((allowed, wait))
        held.update((state[0], state[1], state[2] if state[2] is not None else -1.0))
        held.setTimeoutDuration(int(1000 * max(limit.window, limit.block)))
        yield pd.DataFrame({"key": k[0], "id": frame["id"].to_numpy(), "at": frame["at"].to_numpy(), "allowed": [a for a, _ in told], "retry_after": [w for _, w in told]})

    grouped = _named(events, key, row_id, at).groupBy("key")
    return grouped.applyInPandasWithState(answer, _ANSWER, "start double, n int, until double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idempotent(signals: DataFrame, key: list[str], at: str, lateness: str = "1 day") -> DataFrame:
    """The first of each key's signals; over a stream, state is kept for as long as a repeat may come late."""
    if signals.isStreaming:
        return signals.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(at))
    return signals.withColumn("signal_nth", first).where("signal_nth = 1").drop("signal_nth")


def weekly(signals: DataFrame, group: list[str], at: str, lateness: str = "1 day") -> DataFrame:
    """Signals by calendar week, from Monday in UTC, and group."""
    if signals.isStreaming:
        signals = signals.withWatermark(at, lateness)
    week = F.window(F.col(at), "7 days", startTime="4 days")  # the epoch was a Thursday
    return signals.groupBy(week.alias("week"), *group).agg(F.count("*").alias("signals")).select(F.col("week.start").alias("week_start"), *group, "signals")
