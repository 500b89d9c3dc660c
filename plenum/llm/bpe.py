"""Byte-level BPE ids of whole texts, each distinct word merged once, and the bytes back from ids.

A table is read in chunks of rows.  A chunk's texts become sequences of word numbers, in order of position (``_positions``), and its
distinct words, dealt to buckets by their hash, go to the task that has all occurrences of a bucket: there each distinct word
is encoded once (``_word_ids``).  The ids of a chunk's words come back to its sequences, and each text is put together by
position.  A word travels once a chunk, however often the chunk has it, so no frequent word makes a hot group: the rows of one
word are as many as there are chunks, in each bucket alike.

What is shuffled is the words of each chunk, their ids and the numbers of all positions, each deflated.

The table is read twice alike, once for the words and once for the positions; a chunk is named by its place and a digest
of its texts, so that a table which reads otherwise the second time fails and gives no wrong ids.

The vocabulary is read by the driver from its rank file, at most ``MOST_TOKENS`` entries, and broadcast: its size is the file's
and not the data's.  Decoding joins that table, token to bytes, where the ids are.

Defined results: a null or empty text has no ids, and they decode to no bytes; null ids likewise; an id that the vocabulary
lacks makes the decoded value null; repeated rows come out alike; an empty table gives an empty result; other columns come along.
A text is one row and is read whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from plenum.llm.common import map_in_arrow, name_of, slices

MOST_TOKENS = 1 << 20
#: Distinct words that a task keeps the ids of; beyond it the task forgets them, and encodes a word again that it meets again.
MEMO_WORDS = 1 << 20
#: A longer text is cut into words one by one instead of in a list.
LONG_CHARS = 1 << 23
#: Bytes of ids that are decoded together at least.
DECODE_BYTES = 1 << 22
_CHUNK = [StructField("chunk_task", IntegerType()), StructField("chunk_nth", IntegerType()), StructField("chunk_digest", LongType())]


class Vocabulary:
    """A rank file (lines of a base64 token and its rank) and the pattern that cuts texts into words; held by the driver, sent by broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = {}
        with open(path, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                ranks[base64.b64decode(token)] = int(rank)
                if len(ranks) > MOST_TOKENS:
                    raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens isn't broadcast")
        self.pattern, self.ranks = pattern, spark.sparkContext.broadcast(ranks)
        self.name = hashlib.sha256(repr((path, pattern, len(ranks))).encode()).hexdigest()


@lru_cache(maxsize=4)
def _encoder(name: str, pattern: str, ranks) -> tiktoken.Encoding:
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})


def _chunks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[list[pa.RecordBatch], list[str], tuple]]:
    """(rows, texts, name) of chunks that end with the row that fills ``most`` bytes; where batches end makes no difference."""
    task, nth = TaskContext.get().partitionId(), 0
    rows, texts, size, digest = [], [], 0, hashlib.blake2b(digest_size=8)
    for part in slices(batches, text, most // 16):
        rows.append(part)
        start = 0
        for i, value in enumerate(part.column(text).to_pylist()):
            value = value or ""
            texts.append(value)
            raw = value.encode()
            size += len(raw)
            digest.update(b"%d:" % len(raw) + raw)
            if size >= most:
                rows[-1] = part.slice(start, i + 1 - start)
                yield rows, texts, (task, nth, int.from_bytes(digest.digest(), "big", signed=True))
                start, nth = i + 1, nth + 1
                rows, texts, size, digest = [part.slice(start)], [], 0, hashlib.blake2b(digest_size=8)
    if texts:
        yield rows, texts, (task, nth, int.from_bytes(digest.digest(), "big", signed=True))


def _numbered(texts: list[str], pattern: str) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of all texts, in order of first places, and each text as their numbers."""
    cut = regex.compile(pattern)
    seen: dict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    words = lambda t: cut.findall(t) if len(t) < LONG_CHARS else (m[0] for m in cut.finditer(t))
    codes = [np.fromiter(map(seen.__getitem__, words(t)), dtype=np.uint32) for t in texts]
    return list(seen), codes


def _repeat(name: tuple, n: int) -> list[pa.Array]:
    return [pa.array([v] * n, t) for v, t in zip(name, (pa.int32(), pa.int32(), pa.int64()))]


def _deflated(numbers) -> bytes:
    return zlib.compress(np.asarray(numbers, dtype=np.uint32).tobytes(), 1)


def _inflated(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=np.uint32)


def _words_deflated(words: list[str]) -> bytes:
    """How many words, the length of each in bytes, and all of them in a row."""
    raw = [w.encode() for w in words]
    return zlib.compress(np.array([len(raw), *map(len, raw)], dtype=np.uint32).tobytes() + b"".join(raw), 1)


def _words_inflated(blob: bytes) -> list[bytes]:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, dtype=np.uint32, count=1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, dtype=np.uint32, count=n, offset=4))
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def _word_blocks(docs: DataFrame, text: str, pattern: str, chunk_bytes: int, buckets: int) -> DataFrame:
    """(chunk, bucket, numbers, words): the distinct words of each chunk by bucket."""

    def run(batches):
        for _, texts, name in _chunks(batches, text, chunk_bytes):
            words, _ = _numbered(texts, pattern)
            by_bucket: dict[int, list[int]] = defaultdict(list)
            for n, word in enumerate(words):
                by_bucket[zlib.crc32(word.encode()) % buckets].append(n)
            cols = [*_repeat(name, len(by_bucket)), pa.array(list(by_bucket), pa.int32())]
            cols += [pa.array([_deflated(n) for n in by_bucket.values()], pa.binary()), pa.array([_words_deflated([words[n] for n in block]) for block in by_bucket.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    schema = StructType([*_CHUNK, StructField("bucket", IntegerType()), StructField("numbers", BinaryType()), StructField("words", BinaryType())])
    return map_in_arrow(docs, run, schema)


def _word_ids(blocks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(chunk, numbers, counts, ids): the ids of the words of each block one after the other; blocks of a bucket meet in one task, which encodes each of its words once."""
    name, pattern, ranks = vocabulary.name, vocabulary.pattern, vocabulary.ranks

    def run(batches):
        encode, memo = _encoder(name, pattern, ranks).encode_ordinary, {}
        for batch in batches:
            counts, ids = [], []
            for blob in batch.column("words"):
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                own = []
                for word in _words_inflated(blob.as_py()):
                    if word not in memo:
                        memo[word] = encode(word.decode())
                    own.append(memo[word])
                counts.append(_deflated([len(x) for x in own]))
                ids.append(_deflated([i for x in own for i in x]))
            cols = [*[batch.column(f.name) for f in _CHUNK], batch.column("numbers"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    schema = StructType([*_CHUNK, *[StructField(c, BinaryType()) for c in ("numbers", "counts", "ids")]])
    return map_in_arrow(blocks.repartition("bucket"), run, schema)


def _positions(docs: DataFrame, text: str, pattern: str, chunk_bytes: int) -> DataFrame:
    """``docs`` without the text, each row with its chunk and its words' numbers by position."""
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches):
        for rows, texts, name in _chunks(batches, text, chunk_bytes):
            _, codes = _numbered(texts, pattern)
            start = 0
            for part in rows:
                own = codes[start : start + len(part)]
                start += len(part)
                blobs = pa.array([_deflated(c) for c in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *_repeat(name, len(part)), blobs], schema.names)

    schema = StructType([*kept, *_CHUNK, StructField("positions", BinaryType())])
    return map_in_arrow(docs, run, schema)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all pieces one after the other, each of its size from its start on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", chunk_bytes: int = 1 << 24, buckets: int = 1024) -> DataFrame:
    """``docs`` with the text's ids in place of the text: what tiktoken gives without special tokens."""
    rest = [f for f in docs.schema.fields if f.name not in (text, ids) and f.name.lower() != ids.lower()]
    # columns of any names come along under plain ones
    carried = [StructField(f"own_{i}", f.dataType) for i, f in enumerate(rest)]
    plain = docs.select(name_of(text), *[name_of(f.name) for f in rest]).toDF("text", *[f.name for f in carried])
    answers = _word_ids(_word_blocks(plain, "text", vocabulary.pattern, chunk_bytes, buckets), vocabulary)
    asked = _positions(plain, "text", vocabulary.pattern, chunk_bytes)

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda c: np.concatenate([np.zeros(0, np.int64), *[_inflated(x.as_py()) for x in right.column(c)]])
        numbers, counts, all_ids = flat("numbers"), flat("counts"), flat("ids").astype(np.int32)
        sizes = np.zeros(numbers.max(initial=-1) + 1, dtype=np.int64)
        starts = np.zeros_like(sizes)
        sizes[numbers], starts[numbers] = counts, np.cumsum(counts) - counts
        made, ends = [], [0]
        for blob in left.column("positions"):
            codes = _inflated(blob.as_py())
            if len(codes) and (codes.max() >= len(sizes) or not sizes[codes].all()):
                raise RuntimeError("the table of texts read otherwise the second time: write it before it is encoded")
            made.append(all_ids[_gather(starts[codes], sizes[codes])])
            ends.append(ends[-1] + len(made[-1]))
        values = pa.array(np.concatenate(made) if made else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.Table.from_arrays([*[left.column(f.name) for f in carried], lists], schema.names)

    keys = [f.name for f in _CHUNK]
    schema = StructType([*carried, StructField("ids", ArrayType(IntegerType()))])
    joined = asked.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(put_together, schema)
    return joined.toDF(*[f.name for f in rest], ids)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for: the token-byte table joined in each batch, by position."""
    ranks = vocabulary.ranks
    df = df.select(*[name_of(c) for c in df.columns if c.lower() != decoded.lower()])
    schema = StructType([*df.schema.fields, StructField(decoded, BinaryType())])

    def run(batches):
        table = sorted((i, t) for t, i in ranks.value.items())
        pieces = np.frombuffer(b"".join(t for _, t in table), dtype=np.uint8)
        sizes = np.zeros(table[-1][0] + 2 if table else 1, dtype=np.int64)
        known = np.zeros(len(sizes), dtype=bool)
        at = np.array([i for i, _ in table], dtype=np.int64)
        sizes[at], known[at] = [len(t) for _, t in table], True
        starts = np.cumsum(sizes) - sizes
        for part in slices(batches, ids, DECODE_BYTES):
            out = []
            for value in part.column(ids):
                if value.is_valid and value.values.null_count:
                    out.append(None)
                    continue
                own = value.values.to_numpy().astype(np.int64) if value.is_valid else np.zeros(0, np.int64)
                ok = not len(own) or own.min() >= 0 and own.max() < len(known) and known[own].all()
                out.append(pieces[_gather(starts[own], sizes[own])].tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], schema.names)

    return map_in_arrow(df, run, schema)
