"""Toxicity: learned from document labels, measured on documents kept out, sentences located."""

import random

from plenum.llm.toxicity import START_BIAS, classify, fit

BAD = ["vileword", "nastyword", "grimword"]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(f"plain{rng.randrange(60)}" for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 8))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(BAD).upper() + "!"
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents_and_sentences(spark):
    docs, labels = corpus()
    extra = [(1000, None), (1001, ""), (None, "a vileword here"), (1002, "plain1 " * 50_000), (1002, "plain1 " * 50_000)]
    table = spark.createDataFrame([(i, t, "x", 7) for i, t in docs + extra], "doc_id long, text string, score string, toxic_spans int")
    known = spark.createDataFrame([*labels[:250], (5, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    out = classify(table, known)
    rows = out.collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    scores, truth = {r.doc_id: r for r in rows}, dict(labels)
    held = [i for i in truth if i >= 250]
    right = sum((scores[i].score >= 0.3) == bool(truth[i]) for i in held)
    assert right >= 0.97 * len(held)
    assert scores[1000].score == scores[1001].score < 0.1 and scores[None].score > 0.3
    texts = dict(docs)
    for i in held:
        for s in scores[i].toxic_spans:
            assert any(b in texts[i][s.start : s.end].lower() for b in BAD)
    found = sum(any(b in texts[i][s.start : s.end].lower() for b in BAD for s in scores[i].toxic_spans) for i in held if truth[i])
    assert found >= 0.95 * sum(truth[i] for i in held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 < classify(docs, labels).first().score < 0.05
    assert classify(docs.limit(0), labels).count() == 0
    assert fit([], []) == ({}, START_BIAS)


def test_noisy_or_and_its_gradient():
    """Loss and derivative against the formula, document by document."""
    import numpy as np

    from plenum.llm.toxicity import noisy_or_loss

    rng = np.random.default_rng(2)
    doc_of, y, z = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1.0, 0.0, 1.0, 0.0]), rng.normal(size=7)

    def slow(z):
        total = 0.0
        for d in range(4):
            p = 1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z[doc_of == d]])
            total -= np.log(p if y[d] else 1 - p)
        return total / 4

    loss, g = noisy_or_loss(z, doc_of, y)
    assert abs(loss - slow(z)) < 1e-9
    for i in range(7):
        step = 1e-6 * (np.arange(7) == i)
        assert abs((slow(z + step) - slow(z - step)) / 2e-6 - g[i]) < 1e-6


def test_columns_of_any_name_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a vileword here", 3, 4, 5), (None, None, 1, 1, 1)], "doc_id long, text string, sample_id int, label int, id int")
    labels = spark.createDataFrame([(1, 1, 9, "x")], "doc_id long, toxic int, label int, text string")
    assert classify(docs, labels).columns == [*docs.columns, "toxic_spans", "score"] and classify(docs, labels).count() == 2
    assert classify(docs.limit(0), labels.limit(0)).count() == 0
