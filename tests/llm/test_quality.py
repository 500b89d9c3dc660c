"""Quality measures against plain Python, and the cascade."""

import re
from collections import Counter

from plenum.llm import quality

SCHEMA = "doc_id long, text string"
GOOD = " ".join(f"word{i} and{i % 7} more{i}" for i in range(30)) + ".\nA second line here."
DOCS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "a b c"), (5, GOOD), (6, "the same three " * 40), (7, ("### " * 3 + "word ") * 30), (8, GOOD.upper()),
    (9, "x" * 200_000), (10, "\n".join(["a line that repeats", "other"] * 30)), (11, "é\u00a0è " * 3), (5, GOOD), (None, GOOD), (12, "w " * 60_000),
]


def measure(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def rejected(text):
    n, chars, symbols, dup, rep = measure(text)
    capitals, lines = len(re.findall("[A-Z]", text or "")), (text or "").count("\n") + 1
    return n < 50 or 100 * rep > 50 * n or chars < 2 * n or chars > 12 * n or 10 * symbols > n or 2 * capitals > chars or 2 * dup > lines


def test_measures_and_verdict(spark):
    got = [tuple(r) for r in quality.judge(spark.createDataFrame(DOCS, SCHEMA), measures=quality.BASE).select("doc_id", *quality.BASE, "kept").collect()]
    assert sorted(got, key=repr) == sorted([(i, *measure(t), not rejected(t)) for i, t in DOCS], key=repr)


def test_order_never_changes_a_verdict(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    verdicts = [sorted(((r.doc_id, r.kept) for r in quality.judge(df, rules=rules).collect()), key=repr) for rules in (quality.RULES, quality.RULES[::-1])]
    assert verdicts[0] == verdicts[1]
    order = quality.estimate(df, "text")
    assert {r.name for r, _, _ in order} == {r.name for r in quality.RULES} and all(cost > 0 and 0 <= hits <= 1 for _, cost, hits in order)


def test_keep_with_clashing_columns(spark):
    odd = spark.createDataFrame([(i, t, True, "k", 3) for i, t in DOCS], "doc_id long, text string, kept boolean, rejected_by string, n_words int")
    out = quality.keep(odd)
    assert out.columns == odd.columns and out.count() == sum(not rejected(t) for _, t in DOCS)
    assert {r.n_words for r in out.collect()} == {3}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty, measures=quality.BASE).count() == 0 and quality.keep(empty).count() == 0
