"""Fill-in-middle against a version with a regular expression per text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plenum.llm import fim

TOKEN = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def told(doc_id, text, fim_percent=50, spm_percent=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if doc_id is None:
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
    if h[3] % 100 < spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.fill_in_middle(docs, **kw).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    found = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in out)
    want = sorted((str(i), a, b, str(c), str(d), e) for (i, t) in rows for a, b, c, d, e in [told(i, t, **kw)])
    assert found == want
    if rows:
        assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)


def test_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "\n", "\t", "\x0b", "é", "ü", "中", "🙂", " ", "\x1c", "<", "P", ">", "<S>"]
    rows = [(i, "".join(rng.choices(alphabet, weights=[5, 5, 4, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0.1], k=rng.randrange(0, 60)))) for i in range(600)]
    check(spark, rows)
    check(spark, rows[:100], fim_percent=100, spm_percent=0)
    check(spark, rows[:100], fim_percent=100, spm_percent=100)


def test_nulls_empty_ties_and_long(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (None, None), (3, "   "), (3, "   "), (4, "one"), (4, "one"), (5, "word " * 200_000), (6, "x" * 3_000_000), (7, "<M> in the text")]
    check(spark, rows, fim_percent=100)
    check(spark, [])


def test_slices_cut_rows_not_texts(spark, monkeypatch):
    monkeypatch.setattr(fim, "KERNEL_BYTES", 16)
    check(spark, [(i, f"text {i} of some words\nand lines {i}") for i in range(50)], fim_percent=100)


def test_other_columns(spark):
    docs = spark.sql("SELECT 7L AS doc_id, 'one two three' AS text, 'x' AS form, 'y' AS drawn, 3 AS `a.b`, 1 AS N")
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "drawn", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.collect()[0]["a.b"] == 3


def test_markers_that_could_come_about(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'x' AS text")
    for bad in [("<P>", "<P>", "<M>"), ("PP", "<S>", "<M>"), ("<P<>", "<S>", "<M>")]:
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, markers=bad)
