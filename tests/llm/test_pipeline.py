"""All stages of the pipeline against a brute-force version on a small fixture."""

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(3, 9)))
    vocabulary = [word() for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, shared = text(40), text(12)
    texts = [text(n) for n in (60, 300, 120, 2500, 80)]
    texts += [texts[1] + "\n" + shared, texts[1] + " " + text(1), shared + "\n" + text(70)]
    texts += [text(30) + " " + item + " " + text(30), text(9), "", None, texts[0], texts[0], text(60) + "\n" + shared.upper()]
    return [(i, t, "en", "hot", len(t or "")) for i, t in enumerate(texts)], [(7, item)]


def _expected(rows, items):
    kept = {i: t for i, t, *_ in rows if (t or "").split()}
    holders = {}
    for i, t in sorted(kept.items()):
        for line in t.split("\n"):
            key = line.strip().lower()
            if len(key) >= 10:
                holders.setdefault(key, []).append(i)
    alone = lambda i, line: holders.get(line.strip().lower(), [i])[0] == i
    kept = {i: "\n".join(x for x in t.split("\n") if alone(i, x)) for i, t in kept.items()}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    sets, group = {i: shingles(t.lower().split()) for i, t in kept.items()}, {i: i for i in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {i: t.split() for i, t in kept.items() if group[i] == i and not any(x in t for _, x in items)}


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    where, (rows, items) = str(tmp_path_factory.mktemp("pipeline")), _docs()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, _expected(rows, items)


def test_run(spark, fixture):
    where, expected = fixture
    pieces = sorted(corpus_pipeline.run(spark, where).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    found = {}
    for r in pieces:
        assert r["start"] == len(found.get(r["doc_id"], [])) and r["n_tokens"] == len(r["text"].split()) <= r["bucket"]
        found.setdefault(r["doc_id"], []).extend(r["text"].split())
    assert found == expected
    assert len({(r["batch"], r["slot"]) for r in pieces}) == len(pieces)


def test_stages_bear_any_columns(spark, fixture):
    where, _ = fixture
    names = ["kept_id", "leaked_id", "fp", "root", "digest", "judged", "line_keys", "line_doc", "rejected_by", "n_words", "words", "windows", "start"]
    rows = [(1, "a few words that nobody else has", "en", None, 5, *names), (None, None, None, None, None, *names), (2, "", "en", "s", 0, *names)]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, where)
        assert kept.dtypes == docs.dtypes and 1 in {r["doc_id"] for r in kept.collect()}


def test_stages_keep_the_columns(spark, fixture):
    where, _ = fixture
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, where).dtypes == empty.dtypes
