"""Periodic runs: stretches of words that repeat with a period, found exactly, and texts without the repeats.

A run of period q is a stretch of words in which those q apart are alike; q is its smallest period, and no neighbour extends it.
Only runs of at least ``least_words`` words and ``least_times`` (4 or more) times their period count.  In such a run
lies, for the largest power of two L up to q, a block of L words that starts at a multiple of L and comes again q words
later, with q less than 2 L.  So for each L the aligned blocks are searched across the document with an automaton over word numbers
(for long blocks: over numbers of short windows); an occurrence at a distance from L to below 2 L seeds a stretch, which
is extended word by word both ways.

What keeps this near n log n: a word in a run comes again within its period, so a scale looks only at stretches of
words that do so (``_dense``); a seed inside a stretch already found whose period divides the distance would give the same
stretch again, and is left out.

Defined results: a null or empty text has no runs and collapses to an empty text; repeated rows come out alike; rows without an id
are like any other; an empty table gives an empty result; other columns come along, those with the results' names give
way; texts are read whole, one at a time, so memory follows the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from plenum.llm.common import map_in_arrow, name_of, slices

#: Numbers in the key of a block at most: an automaton walks back along a key's own repeats, so that long keys of like words would cost a square.
KEY_LENGTH = 8
#: Bytes of text whose results go back to Spark together at least.
SLICE_BYTES = 1 << 22
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def number(words: list[bytes]) -> np.ndarray:
    """Words as numbers, in the order of their first places."""
    seen: dict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    return np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))


def _next(codes: np.ndarray) -> np.ndarray:
    """How many words on each word comes again; a number past the end where it doesn't."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), len(codes) + 1, dtype=np.int64)
    again = codes[order[1:]] == codes[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _dense(near: np.ndarray, least: int) -> np.ndarray:
    """A mask of the places in stretches of ``near`` that are at least so long."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    mask = np.zeros(len(near) + 1, dtype=np.int64)
    long = ends - starts >= least
    np.add.at(mask, starts[long], 1)
    np.add.at(mask, ends[long], -1)
    return np.cumsum(mask[:-1]) > 0


def _places(n: int, size: int, where: np.ndarray, stretches: list[tuple[int, int, int]]) -> np.ndarray:
    """Where aligned blocks of ``size`` words start that lie inside ``where`` and may seed a new stretch.

    A block with two more block lengths of the same known stretch after it, whose period is no longer than the block, comes again in
    reach at multiples of that period only: all it could seed is the stretch itself.
    """
    inside = np.concatenate([[0], np.cumsum(where)])
    places = np.arange(0, n - size + 1, size)
    new = inside[places + size] - inside[places] == size
    for start, end, period in stretches:
        if period <= size and end - start >= 3 * size:
            new[-(-start // size) : (end - 3 * size) // size + 1] = False
    return places[new]


def _spans(places: np.ndarray, wide: int, n: int) -> list[tuple[int, int]]:
    """The places with ``wide`` words from each, as spans that don't touch."""
    if not len(places):
        return []
    apart = np.flatnonzero(np.diff(places) > wide)
    starts, lasts = places[np.concatenate([[0], apart + 1])], places[np.concatenate([apart, [len(places) - 1]])]
    return list(zip(starts.tolist(), np.minimum(lasts + wide, n).tolist()))


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows of twice the width, from the names of those of ``width`` words: alike only for like windows."""
    pairs = names[: len(names) - width] * (names.max() + 1) + names[width:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _seeds(names: np.ndarray, width: int, size: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): the blocks of ``size`` words at the places, and how far on each comes again, from ``size`` to below twice that.

    names: a number for the window of ``width`` words at each place, ``size`` being a multiple of the width; a block is a
    key of ``size / width`` such numbers, and the document is searched from each remainder of places by the width.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    blocks: dict[tuple, int] = {}
    own = np.array([blocks.setdefault(tuple(names[b : b + size : width].tolist()), len(blocks)) for b in places], dtype=np.int64)
    for block, n in blocks.items():
        automaton.add_word(block, n)
    automaton.make_automaton()
    found_at, found = [], []
    words = len(names) + width - 1
    for start, end in _spans(places, 3 * size, words):
        for first in range(start, start + width):
            for last, block in automaton.iter(tuple(names[first : end - width + 1 : width].tolist())):
                found_at.append(first + (last + 1) * width - size)
                found.append(block)
    # (block, place) as one sorted number, so that the occurrences in reach of each place are one range
    wide = words + 2 * size + 1
    keys = np.sort(np.array(found, dtype=np.int64) * wide + np.array(found_at, dtype=np.int64))
    base = own * wide + places
    first, stop = np.searchsorted(keys, base + size), np.searchsorted(keys, base + 2 * size)
    many = stop - first
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(places, many), keys[at] - np.repeat(base, many)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first values are alike, looked at in doubling steps."""
    done, step, most = 0, 64, min(len(a), len(b))
    while done < most:
        stop = min(done + step, most)
        differ = a[done:stop] != b[done:stop]
        if differ.any():
            return done + int(differ.argmax())
        done, step = stop, step * 2
    return most


def find_runs(codes: np.ndarray, least_words: int = 6, least_times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if least_times < 4:
        raise ValueError("runs of fewer than four periods can lie between aligned blocks")
    n = len(codes)
    near, names, width = _next(codes), codes, 1
    #: Stretches found so far (start, end, period), and which period each extent has.
    stretches: list[tuple[int, int, int]] = []
    extents: dict[tuple[int, int], int] = {}
    size = 1
    while least_times * size <= n:
        # a run of period q has its words come again on all but its last q: 3 q places, room for a block and its next occurrence
        where = _dense(near < 2 * size, (least_times - 1) * size)
        places = _places(n, size, where, stretches) if where.any() else []
        if len(places):
            reached: dict[int, int] = {}
            while width * KEY_LENGTH < size:
                names, width = _doubled(names, width), 2 * width
            at, distance = _seeds(names, width, size, places)
            new = np.ones(len(at), dtype=bool)
            for start, end, period in stretches:
                if end - start >= 2 * size:
                    low, high = np.searchsorted(at, [start, end])
                    new[low:high] &= (distance[low:high] % period != 0) | (at[low:high] + distance[low:high] + size > end)
            for at, d in zip(at[new].tolist(), distance[new].tolist()):
                if at < reached.get(d, 0):
                    continue  # in the last stretch of this period
                end = at + d + _same(codes[at:], codes[at + d :])
                start = at - _same(codes[:at][::-1], codes[d : at + d][::-1])
                reached[d] = end - d
                if extents.setdefault((start, end), d) == d:
                    stretches.append((start, end, d))
        size *= 2
    return sorted((s, e - s, d) for s, e, d in stretches if e - s >= max(least_words, least_times * d))


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """A mask of the words that some run holds after its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def periodic_runs(docs: DataFrame, text: str = "text", least_words: int = 6, least_times: int = 4) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length and period, in words, by start, then period) and ``collapsed``: the words that aren't repeats, joined by one space."""
    added = [StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    own = docs.select(*[name_of(c) for c in docs.columns if c.lower() not in ("runs", "collapsed") or c == text])
    kept = [f for f in own.schema.fields if f.name.lower() not in ("runs", "collapsed")]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_BYTES):
            found, collapsed = [], []
            for value in part.column(text):
                words = (value.as_py() or "").encode().split()  # of bytes: at ASCII white space alone
                own_runs = find_runs(number(words), least_words, least_times)
                gone = repeats(len(words), own_runs)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own_runs])
                collapsed.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode() if own_runs else b" ".join(words).decode())
            cols = [*[part.column(f.name) for f in kept], pa.array(found, run_type), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*[f.name for f in kept], "runs", "collapsed"])

    return map_in_arrow(own, run, StructType([*kept, *added]))
