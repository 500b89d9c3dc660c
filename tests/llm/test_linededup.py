"""Line dedup against a brute-force version, and its reversibility."""

import numpy as np
import pytest

from plenum.llm.cuckoo import CuckooFilter
from plenum.llm.linededup import LineStore, dedup_lines

SCHEMA = "doc_id long, text string"


def brute(docs, min_chars=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()], key=repr)


DOCS = [
    (3, "a long enough line\nshort\nanother long line"), (1, " A LONG enough line \nits own sentence here"), (2, None), (4, ""), (None, "a long enough line"),
    (5, "another long line\nanother long line\nshort"), (6, "éééééééééé\nx"), (7, "éééééééééé\n" + "y" * 300_000), (3, "a long enough line\nshort\nanother long line"),
]


def test_whole_table(spark):
    assert rows(dedup_lines(spark.createDataFrame(DOCS, SCHEMA))) == brute(DOCS)


def test_empty_table_and_clashing_columns(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "the same long line", "k", 9, b"z"), (2, "the same long line", "k", 8, b"z")], "doc_id long, text string, line_keys string, n_lines int, key binary")
    out = dedup_lines(odd)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped, r.line_keys) for r in out.collect()) == [(1, "the same long line", 1, 0, "k"), (2, "", 1, 1, "k")]


def test_insertions_and_deletions_are_reversible(spark):
    docs = [(i, "\n".join(f"line number {i * k % 13} of many" for k in range(1, 6))) for i in range(1, 30)]
    first, second = docs[:20], docs[15:]
    store = LineStore(spark, shard_keys=4)
    store.insert(spark.createDataFrame(first, SCHEMA))
    store.insert(spark.createDataFrame(second, SCHEMA))  # five of them again
    assert rows(store.apply(spark.createDataFrame(docs, SCHEMA))) == brute(docs)
    store.delete(spark.createDataFrame([(i,) for i in range(1, 10)], "doc_id long"))
    left = [d for d in docs if d[0] >= 10]
    assert rows(store.apply(spark.createDataFrame(left, SCHEMA))) == brute(left)
    counts = {bytes(r.key): (r.n_docs, r.first) for r in store.counts.collect()}
    assert len(counts) == store.counts.count() and all(n > 0 for n, _ in counts.values())
    store.insert(spark.createDataFrame(docs[:9], SCHEMA))
    assert rows(store.apply(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_cuckoo_filter():
    h = np.random.default_rng(5).integers(0, 2**63, 20_000, dtype=np.uint64)
    f = CuckooFilter.of_capacity(len(h))
    refused = f.insert(h)
    assert not refused.any() and f.contains(h).all()
    other = np.random.default_rng(6).integers(0, 2**63, 100_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.002
    again = CuckooFilter.from_bytes(f.to_bytes())
    again.delete(h[:10_000])
    assert again.contains(h[10_000:]).all() and again.contains(h[:10_000]).mean() < 0.01


def test_full_filter_keeps_what_it_has():
    f = CuckooFilter(np.zeros((4, 4), dtype=np.uint16))
    h = np.random.default_rng(1).integers(0, 2**63, 40, dtype=np.uint64)
    refused = f.insert(h)
    assert refused.sum() >= 24 and f.contains(h[~refused]).all()


@pytest.mark.parametrize("line,counts", [("123456789", False), ("1234567890", True), ("éééééééééé", True), ("ééééééééé", False), ("   1234567890   ", True)])
def test_key_length(line, counts):
    from plenum.llm.linededup import line_key

    assert (line_key(line, 10) is not None) == counts


def test_ids_of_any_type_and_filters_that_are_asked(spark, monkeypatch):
    from plenum.llm import linededup

    text = "a line of several documents\nown line number {0}"
    docs = spark.createDataFrame([(f"d{i:02}", text.format(i)) for i in range(30)] + [(None, text.format(0))], "doc_id string, text string")
    asked, ask = [], linededup.LineStore._ask
    monkeypatch.setattr(linededup.LineStore, "_ask", lambda store, keys, answer: asked.append(store.filters.count()) or ask(store, keys, answer))
    rows = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(docs).collect()}
    assert asked[0] == 0 and min(asked[1:]) > 0
    assert rows["d00"] == (text.format(0), 0) and rows["d07"] == ("own line number 7", 1) and rows[None] == (text.format(0), 0)


def test_more_shards_as_keys_come(spark):
    from plenum.llm.linededup import LineStore

    docs = lambda a, b: spark.range(a, b).selectExpr("id AS doc_id", "concat('a line that all have\n', 'line of document ', id) AS text")
    store = LineStore(spark, shard_keys=50)
    store.insert(docs(0, 20))
    assert store.shards == 1
    store.insert(docs(20, 400))
    assert store.shards == 9 and store.filters.select("shard").distinct().count() == 9
    store.delete(docs(0, 1))
    store.insert(docs(390, 420))
    everything = docs(1, 420)
    assert store.counts.count() == 420 and store.apply(everything).where("n_dropped = 0").select("doc_id").first()[0] == 1
    assert store.apply(everything).selectExpr("sum(n_dropped)").first()[0] == 418
