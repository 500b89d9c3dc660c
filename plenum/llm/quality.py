"""Quality rules as a short-circuit cascade, built from DataFrame functions only.

Every rule rejects a text by a few measures.  One pass over a sample tells which texts each rule
rejects and how much work its measures are on them; the rules then stand in one CASE expression, by
rejections per work among the texts that earlier rules left.  A text that one rule rejects isn't
measured for the later ones.  The order never changes a verdict, only what it costs; work is counted
in characters and words, not in seconds, so the same table always gets the same order.

Defined results: a null text counts as empty; an empty text has no words and is rejected by
``few_words``; repeated rows are judged alike, each by itself; an empty table gives an empty
result; a column of the input that is named like a measure or verdict is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import SPACES, UPPER, bind, fresh, words_of

SYMBOLS = "#*$%&|<>"


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: the windows are sorted, so that equal ones are neighbours."""
    windows = F.when(
        F.size(words) > 2,
        F.slice(F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.size(words) - 2),
    ).otherwise(F.array().cast("array<string>"))

    def covered(marked: Column) -> Column:
        same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        at = F.transform(
            marked,
            lambda x, j: F.when(
                same(x, F.get(marked, j + 1)) | same(x, F.get(marked, j - 1)), F.array(x["i"], x["i"] + 1, x["i"] + 2)
            ).otherwise(F.array().cast("array<int>")),
        )
        return F.size(F.array_distinct(F.flatten(at)))

    def count(ws: Column) -> Column:
        marked = F.array_sort(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(bind(marked, covered))

    return bind(windows, count).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


#: Measure -> expression of (text, words).
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.translate(text, SPACES, "")).cast("long"),
    "n_symbols": lambda text, words: (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    "n_dup_lines": lambda text, words: _dup_lines(text),
    "n_repeat_words": lambda text, words: _repeated_words(words),
    "n_capitals": lambda text, words: (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long"),
    "n_lines": lambda text, words: F.size(F.split(text, "\n")).cast("long"),
}
#: What a measure costs for each character and for each word of a text, by the time it takes on long texts.
WORK = {"n_words": (0, 1), "word_chars": (1, 0), "n_symbols": (1, 0), "n_dup_lines": (2, 0), "n_repeat_words": (0, 30), "n_capitals": (1, 0), "n_lines": (1, 0)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``reject`` makes a boolean column from a lookup of measures."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


#: Thresholds are integer ratios, so that SQL engines agree on every text.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 12 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("capitals", lambda m: 2 * m("n_capitals") > m("word_chars")),
    Rule("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
)
#: The rules of a corpus that keeps short texts: only those without any word go for their length.
CORPUS_RULES = (Rule("no_words", lambda m: m("n_words") < 1), *RULES[1:])


def _lookup(text: Column, words: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text, words)


def measures_of(rule: Rule) -> list[str]:
    """The measures that a rule asks for."""
    asked: list[str] = []
    rule.reject(lambda name: asked.append(name) or F.lit(0))
    return sorted(set(asked))


def estimate(df: DataFrame, text: str, rules=RULES, sample_rows: int = 2000, seed: int = 17) -> list[tuple[Rule, float, float]]:
    """The rules in cascade order, each with its work and its share of rejections among the sampled texts that are left.

    The sample has about ``sample_rows`` rows; it only decides the order.  Two jobs: a count, and one pass over the sample.
    """
    n = df.count() if rules else 0
    if n == 0:
        return [(r, 0.0, 0.0) for r in rules]
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.sample(fraction=min(1.0, sample_rows / n), seed=seed)
    told = sample.select(F.length("text").alias("chars"), bind(words_of(F.col("text")), lambda words: F.struct(F.size(words).alias("words"), *[r.reject(_lookup(F.col("text"), words)).alias(f"r{i}") for i, r in enumerate(rules)])).alias("t"))
    flags = [F.col(f"t.r{i}") for i in range(len(rules))]
    rows = told.groupBy(*flags).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("t.words").alias("words")).collect()
    patterns = [([bool(row[i]) for i in range(len(rules))], row["n"], row["chars"], row["words"]) for row in rows]

    def work(rule: Rule, chars: float, words: float) -> float:
        return 1.0 + sum(WORK.get(m, (1, 1))[0] * chars + WORK.get(m, (1, 1))[1] * words for m in measures_of(rule))

    order, left = [], list(range(len(rules)))
    while left:
        total, chars, words = (sum(p[j] for p in patterns) for j in (1, 2, 3))
        hits = {i: sum(p[1] for p in patterns if p[0][i]) / max(total, 1) for i in left}
        cost = {i: work(rules[i], chars, words) for i in left}
        best = max(left, key=lambda i: (hits[i] / cost[i], -cost[i], -i))
        order.append((rules[best], cost[best], hits[best]))
        left.remove(best)
        patterns = [p for p in patterns if not p[0][best]]
    return order


def judge(df: DataFrame, text: str = "text", rules=RULES, measures: list[str] | None = None, sample_rows: int = 2000) -> DataFrame:
    """``df`` with ``rejected_by``, the first rule of the cascade that rejects the text (null: none), and boolean ``kept``.

    measures: measures to return too; without any, a text costs only what the rules before its first rejection need.
    """
    order = [r for r, _, _ in estimate(df, text, rules, sample_rows)]
    measures = measures or []
    whole, judged = F.coalesce(F.col(text), F.lit("")), fresh(df, "judged")

    def verdict(m: Callable[[str], Column]) -> Column:
        first = F
        for r in order:
            first = first.when(r.reject(m), F.lit(r.name))
        return (first if order else F.lit(None).cast("string")).alias("rejected_by")

    # words and measures are bound, not columns of their own: a filter on the verdict that the optimizer moves down computes them once
    def of(words: Column) -> Column:
        lazily = _lookup(whole, words)
        if not measures:
            return F.struct(verdict(lazily))
        return bind(
            F.struct(*[lazily(n).alias(n) for n in measures]),
            lambda known: F.struct(*[known[n].alias(n) for n in measures], verdict(lambda n: known[n] if n in measures else lazily(n))),
        )

    replaced = {c.lower() for c in [*measures, "rejected_by", "kept"]}
    out = df.withColumn(judged, bind(words_of(whole), of))
    added = [F.col(f"{judged}.{n}").alias(n) for n in [*measures, "rejected_by"]]
    return out.select(*[c for c in df.columns if c.lower() not in replaced], *added, F.col(f"{judged}.rejected_by").isNull().alias("kept"))


def keep(df: DataFrame, text: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with the columns of ``df``, whatever their names."""
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    kept = judge(plain, f"c{df.columns.index(text)}", rules, None, sample_rows).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
