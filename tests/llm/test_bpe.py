"""Byte-level BPE against the tiktoken library over whole texts, and the way back."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plenum.llm import bpe, queries

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)


def check(spark, vocabulary, library, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs, vocabulary, **kw), vocabulary).collect()
    found = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in out)
    assert found == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)


def texts(rng, n):
    alphabet = ["a", "the", " the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "中文", "🙂", "'s", "'re", "123", "!", "<|endoftext|>", "Zz", "​", "　"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(n)]


def test_against_the_library(spark, vocabulary, library):
    rows = list(enumerate(texts(random.Random(2), 400)))
    check(spark, vocabulary, library, rows)
    check(spark, vocabulary, library, rows, chunk_bytes=64, buckets=3)


def test_nulls_ties_and_long_texts(spark, vocabulary, library):
    rows = [(1, None), (2, ""), (None, "no id"), (None, None), (3, "same same"), (3, "same same"), (4, " "), (5, "long text of words " * 60_000), (6, "x" * 300_000), (7, " " * 100_000)]
    check(spark, vocabulary, library, rows)
    check(spark, vocabulary, library, rows, chunk_bytes=1000)
    check(spark, vocabulary, library, [])
    check(spark, vocabulary, library, [(1, None), (2, "")])
    check(spark, vocabulary, library, [(9, "one text many times over")] * 500, chunk_bytes=100)


def test_words_one_by_one(spark, vocabulary, library, monkeypatch):
    assert bpe._numbered(["a b a", ""], public_tokenizers.PATTERN)[0] == ["a", " b", " a"]
    monkeypatch.setattr(bpe, "LONG_CHARS", 5)
    assert bpe._numbered(["a b a", "a b ab"], public_tokenizers.PATTERN)[0] == ["a", " b", " a", " ab"]


def test_other_columns(spark, vocabulary):
    docs = spark.sql("SELECT 'x' AS chunk_task, 'hello world' AS text, 1 AS IDS, 2 AS `a.b`, 3 AS positions, array(1, 2) AS decoded")
    out = bpe.encode(docs, vocabulary)
    assert out.columns == ["chunk_task", "a.b", "positions", "decoded", "ids"]
    back = bpe.decode(out, vocabulary)
    assert back.columns == ["chunk_task", "a.b", "positions", "ids", "decoded"]
    assert bytes(back.collect()[0].decoded) == b"hello world"


def test_ids_without_bytes(spark, vocabulary):
    df = spark.sql("SELECT * FROM VALUES (1, array(64, 65)), (2, CAST(NULL AS ARRAY<INT>)), (3, array(64, 99999999)), (4, array(64, NULL)), (5, array(-1)), (6, array()) AS t(i, ids)")
    out = {r.i: r.decoded for r in bpe.decode(df, vocabulary).collect()}
    assert {k: v if v is None else bytes(v) for k, v in out.items()} == {1: b"ab", 2: b"", 3: None, 4: None, 5: None, 6: b""}


def test_a_table_that_changes_fails(spark, vocabulary):
    docs = spark.range(50).select("id", F.concat(F.lit("text "), F.uuid()).alias("text"))
    changing = docs.mapInArrow(_changed, "id long, text string")
    with pytest.raises(Exception, match="read otherwise"):
        bpe.encode(changing, vocabulary).collect()


def _changed(batches):
    import uuid

    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([uuid.uuid4().hex for _ in range(len(b))])], ["id", "text"])


def test_query(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t).hexdigest()
    want = []
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(tuple, queries.op11_bpe(spark, DATA).collect())) == sorted(want)
