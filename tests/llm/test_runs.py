"""Periodic runs against a version that tries every period at every place."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import queries, runs

DATA = "/root/testdata/sf0.001"


def told(words, least_words=6, least_times=4):
    out, extents = [], set()
    for q in range(1, len(words) // least_times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start:
                # smaller periods come first, so an extent that is there has a smaller one
                if i + q - start >= max(least_words, least_times * q) and (start, i + q) not in extents:
                    out.append((start, i + q - start, q))
                    extents.add((start, i + q))
            else:
                i += 1
    return sorted(out)


def made(rng):
    kinds = rng.choice([1, 2, 2, 3, 5, 20])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(120))]
    for _ in range(rng.randrange(3)):
        if len(words) > 4:
            period, at = rng.randrange(1, max(2, len(words) // 4)), rng.randrange(len(words))
            for i in range(at + period, min(len(words), at + rng.randrange(1, 6 * period + 1))):
                words[i] = words[i - period]
    return words


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def test_against_brute_force():
    rng = random.Random(5)
    for _ in range(2000):
        words = made(rng)
        assert runs.find_runs(runs.number([w.encode() for w in words])) == told(words), words
        assert runs.find_runs(runs.number([w.encode() for w in words]), 3, 5) == told(words, 3, 5), words


def test_the_blocks_find_the_runs(monkeypatch):
    codes = np.tile(np.arange(50), 8)
    assert runs.find_runs(codes) == [(0, 400, 50)]
    none = np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(runs, "_seeds", lambda *a: (none, none))
    assert runs.find_runs(codes) == []


def test_long_repeats_take_no_square_time():
    began = time.time()
    assert runs.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    assert runs.find_runs(np.arange(300_000) % 700) == [(0, 300_000, 700)]
    runs.find_runs(np.random.default_rng(1).integers(0, 2, 100_000))
    assert time.time() - began < 60


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, dtype=np.int64), 6, 3)


def test_operator(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(made(rng))) for i in range(200)]
    rows += [(None, "a b " * 9), (201, None), (202, ""), (203, " \n "), (7, "x y é " * 8), (7, "x y é " * 8), (204, "la " * 100_000)]
    out = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        words = [w for w in (t or "").replace("\n", " ").split(" ") if w]
        found = [(0, 100_000, 1)] if i == 204 else told(words)
        want.append((str(i), [*map(list, found)], "la" if i == 204 else collapsed(words, found)))
    assert sorted((str(r.doc_id), [list(x) for x in r.runs], r.collapsed) for r in out) == sorted(want)


def test_empty_table_and_other_columns(spark):
    docs = spark.sql("SELECT 'a a a a a a b' AS text, 1 AS runs, 2 AS `a.b`, 3 AS Collapsed, CAST(NULL AS INT) AS id")
    out = runs.periodic_runs(docs)
    assert out.columns == ["text", "a.b", "id", "runs", "collapsed"]
    assert out.collect()[0].collapsed == "a b"
    assert runs.periodic_runs(docs.where("false")).collect() == []


def test_query(spark):
    import hashlib
    import zlib

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, DATA).collect()}
    assert len(found) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        all_runs, r = told(words), found[doc_id]
        best = min(all_runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert (r.n_runs, r.runs_sha256) == (len(all_runs), sha("".join("%d,%d,%d\n" % x for x in all_runs)))
        assert r.collapsed_sha256 == sha(collapsed(words, all_runs))
