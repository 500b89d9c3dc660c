"""Fill-in-middle samples: a document cut in three at token bounds and put together again around markers.

A token is a run of white space with the word after it, or the white space at the end.  The kernel works on whole
slices of Arrow's UTF-8 buffers: a lookup gives each byte's class, the mask of bytes that are space after a byte that
isn't gives the token bounds, cumulative sums that start anew with each row number tokens and code points, and one
``searchsorted`` finds the cuts of all rows.  The order of the parts follows from four numbers of a SHA-256 of the row's id.

Defined results: a null text counts as empty; an empty text, one that holds a marker, and a row without an id stay plain, as does
the share of rows that the numbers leave; repeated rows come out alike; an empty table gives an empty result; other columns
come along, those with the results' names give way; a text of any length is cut as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plenum.llm.common import fresh, map_in_arrow, name_of, slices

#: Bytes of text that a kernel call takes at least; a longer text is one call.
KERNEL_BYTES = 1 << 22
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that start a code point.
_STARTS = (np.arange(256) & 0xC0) != 0x80


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) in a row, and the offsets where each starts and the last ends."""
    whole = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(data) else data, offsets - offsets[0]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mask of the bytes at which a token starts: the first of each row, and white space after something else."""
    space = _IS_SPACE[data]
    starts = np.zeros(len(data), dtype=bool)
    starts[1:] = space[1:] & ~space[:-1]
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return starts


def cuts(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first cut, second cut) of each row, cuts as places in ``data``: after the smaller and the larger of a and b modulo tokens + 1."""
    upto = np.concatenate([[0], np.cumsum(token_starts(data, offsets))])
    before = upto[offsets[:-1]]
    n = upto[offsets[1:]] - before
    first, second = np.minimum(a % (n + 1), b % (n + 1)), np.maximum(a % (n + 1), b % (n + 1))
    # k tokens end where the one after them starts, which is the last place with so many before it; after all tokens, where the row ends
    place = lambda k: np.where(k == n, offsets[1:], np.searchsorted(upto, before + k, side="right") - 1)
    return n, place(first), place(second)


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    Of the rows that may be cut ``fim_percent`` are, and of those ``spm_percent`` with the suffix first.  Markers are of the
    shape ``<...>``, so none can come about where a part meets a marker, and ``restore`` can undo the order.
    """
    for m in markers:
        if len(m) < 3 or m[0] != "<" or m[-1] != ">" or "<" in m[1:] or ">" in m[:-1]:
            raise ValueError(f"a marker starts with its only < and ends with its only >: {m!r}")
    if len(set(markers)) != 3:
        raise ValueError("markers differ")
    added = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    names = {f.name for f in added}
    own = docs.select(*[name_of(c) for c in docs.columns if c.lower() not in names or c in (doc_id, text)])
    drawn = fresh(own, "drawn")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name_of(doc_id).cast("string")), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    kept = [f for f in own.schema.fields if f.name.lower() not in names]
    p, s, m = (x.encode() for x in markers)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(text)
        data, offsets = buffers(texts)
        h = [pc.fill_null(pc.list_element(part.column(drawn), k), -1).to_numpy(zero_copy_only=False) for k in range(4)]
        n, first, second = cuts(data, offsets, np.maximum(h[0], 0), np.maximum(h[1], 0))
        holds = np.zeros(len(part), dtype=bool)
        for marker in markers:
            holds |= pc.fill_null(pc.match_substring(texts, marker), False).to_numpy(zero_copy_only=False)
        plain = (n == 0) | holds | (h[2] < 0) | (h[2] % 100 >= fim_percent)
        spm = ~plain & (h[3] % 100 < spm_percent)
        points = np.concatenate([[0], np.cumsum(_STARTS[data])])
        raw, pieces, ends = memoryview(data), [], [0]
        for at, x, y, end, is_plain, is_spm in zip(*(v.tolist() for v in (offsets[:-1], first, second, offsets[1:], plain, spm))):
            if is_plain:
                parts = (raw[at:end],)
            elif is_spm:
                parts = (s, raw[y:end], p, raw[at:x], m, raw[x:y])
            else:
                parts = (p, raw[at:x], s, raw[y:end], m, raw[x:y])
            pieces += parts
            ends.append(ends[-1] + sum(map(len, parts)))
        output = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer(np.array(ends, dtype=np.int64)), pa.py_buffer(b"".join(pieces))])
        chars = lambda low, high: pa.array(points[high] - points[low], pa.int64(), mask=plain)
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
        found = [pa.array(n, pa.int64()), form, chars(offsets[:-1], first), chars(first, second), output.cast(pa.string())]
        return pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *found], [*[f.name for f in kept], *[f.name for f in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, KERNEL_BYTES):
            yield kernel(part)

    return map_in_arrow(own.withColumn(drawn, numbers), run, StructType([*kept, *added]))


def restore(output: F.Column, form: F.Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> F.Column:
    """The text that ``fill_in_middle`` made an output of that form from."""
    p, s, m = markers
    between = lambda after, before: F.substring_index(F.substring_index(output, after, -1), before, 1)
    last = F.substring_index(output, m, -1)
    psm, spm = F.concat(between(p, s), last, between(s, m)), F.concat(between(p, m), last, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
