"""Packing: optimal boundaries against all choices, and whole results."""

import random
from collections import Counter
from itertools import combinations

import pytest

from plenum.llm import packing

SCHEMA = "doc_id long, text string"


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


@pytest.mark.parametrize("histogram,k", [({1: 5, 2: 1, 7: 3, 8: 9, 20: 1}, 2), ({3: 1}, 4), ({0: 2, 5: 1, 6: 7, 9: 4, 11: 2, 30: 1}, 3), ({}, 3)])
def test_boundaries_are_optimal(histogram, k):
    bounds = packing.boundaries(histogram, k)
    if not histogram:
        assert bounds == []
        return
    top = max(histogram)
    best = min(padding(histogram, [*c, top]) for r in range(k) for c in combinations([x for x in histogram if x != top], r))
    assert len(bounds) <= k and bounds[-1] == top and padding(histogram, bounds) == best


def test_no_token_is_lost_and_budgets_hold(spark):
    docs = [(i, " ".join(f"t{i}x{j}" for j in range(i * 7 % 45))) for i in range(80)] + [(None, "a b"), (90, None), (91, ""), (92, "w " * 5_000), (3, "again"), (3, "again")]
    out = packing.pack(spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, piece int, tokens string"), max_tokens=20, buckets=4, token_budget=64, group_rows=16, with_text=True).collect()
    want = sorted(w for _, t in docs for w in (t or "").split())
    assert sorted(w for r in out for w in r.text.split()) == want
    assert all(r.n_tokens == len(r.text.split()) <= r.bucket <= 20 for r in out)
    batches = {}
    for r in out:
        batches.setdefault(r.batch, []).append(r)
    for rows in batches.values():
        assert len({r.bucket for r in rows}) == 1 and len(rows) * rows[0].bucket <= 64 and sorted(r.slot for r in rows) == list(range(len(rows)))
    long = sorted((r for r in out if r.doc_id == 92), key=lambda r: r.piece)
    assert len(long) == 250 and [r.start for r in long] == list(range(0, 5_000, 20))
    spans = packing.pack(spark.createDataFrame(docs, SCHEMA), max_tokens=20, buckets=4, token_budget=64, group_rows=16).collect()
    key = lambda r: repr((r.doc_id, r.piece, r.start, r.n_tokens, r.bucket))
    assert sorted(map(key, spans)) == sorted(map(key, out))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_an_id_are_dealt_to_many_groups(spark):
    docs = spark.range(0, 3000, 1, 3).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same text' AS text", "'x' AS row")
    rows = packing.pack(docs, group_rows=100, token_budget=64).collect()
    groups = Counter(r["batch"].rsplit("-", 1)[0] for r in rows)
    assert len(rows) == 3000 and len(groups) == 30 and max(groups.values()) < 200


def test_pieces_keep_the_text(spark):
    rng = random.Random(1)
    texts = ["a\n\nb\tc  d", "  lead and trail \n\t", " \n ", "", None, "one", "é ü\x0b\x0c\r中\xa0文 x", *["".join(rng.choices(" \n\tab.", k=rng.randrange(60))) for _ in range(40)], "word\n" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for with_text in (packing.pieces(docs, max_tokens=3, with_text=True), packing.pack(docs, max_tokens=3, with_text=True)):
        found = {}
        for r in with_text.orderBy("doc_id", "piece").collect():
            found.setdefault(r.doc_id, []).append(r)
        assert {i: "".join(r.text for r in rows) for i, rows in found.items()} == {i: t or "" for i, t in enumerate(texts)}
        for rows in found.values():
            assert [r.n_tokens for r in rows] == [len(r.text.encode().split()) for r in rows]
    plain = packing.pieces(docs, max_tokens=3).collect()
    assert sorted(map(tuple, plain)) == sorted((r.doc_id, r.piece, r.start, r.n_tokens) for r in packing.pieces(docs, max_tokens=3, with_text=True).collect())
