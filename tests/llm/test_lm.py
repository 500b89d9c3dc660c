"""The language model: counts and base scores against brute force, and properties of the recurrent part."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plenum.llm import gru, lm

TEXTS = ["The cat sat", "the dog\tsat on the mat", None, "", "É unseen CAT words", "the " * 90 + "end", "the cat sat"]


def test_base_score_is_the_formula(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("score", F.lit("extra"))
    model = lm.fit(docs.where("doc_id <> 4"), vocab=6, head=8, rounds=1)
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    seen = Counter(w for i, t in enumerate(TEXTS) if i != 4 for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    rows = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        assert math.isclose(rows[i]["base_score"], base, rel_tol=1e-9)
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n)
        assert rows[i]["score"] < 0
    assert math.isclose(rows[2]["score"], rows[3]["score"], rel_tol=1e-6)
    assert math.isclose(rows[0]["score"], rows[6]["score"], rel_tol=1e-6)


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = lm.score(docs, lm.fit(docs.where("false"))).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {(3, 0, 0), (1, 0, 0)}
    assert all(r["base_score"] == 0 for r in rows)  # no token, no end: 0.5 / (0 + 0.5)


def test_long_words_find_their_counts_by_join(spark):
    long = "x" * 500
    docs = spark.createDataFrame([(1, f"{long} a {long}"), (2, "a b"), (3, None)], "doc_id long, text string")
    model = lm.fit(docs)
    assert long.encode() not in model.lexicon.rank and b"a" in model.lexicon.rank
    c, total = {long: 2, "a": 2, "b": 1}, 8
    log = lambda n: math.log10((n + 0.5) / (total + 0.5 * 5))
    for r in lm.score(docs, model).collect():
        words = {1: [long, "a", long], 2: ["a", "b"], 3: []}[r.doc_id]
        assert r.n_known == len(words) + 1 and abs(r.base_score - sum(log(c[w]) for w in words) - log(3)) < 1e-9


def _model():
    model, rng = gru.new_model(np.arange(128.0) + 1, hidden=8), np.random.default_rng(1)
    return {name: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for name, v in model.items()}


def test_probabilities_sum_to_one():
    h = np.random.default_rng(2).standard_normal((3, 8)).astype(np.float32)
    each = np.array([gru._log_probs(_model(), h, np.full(3, t)) for t in range(128)])
    assert np.allclose(np.exp(each).sum(axis=0), 1, atol=1e-4)


def test_state_is_carried_over_windows_and_lanes_do_not_mix():
    rng, model = np.random.default_rng(3), _model()
    texts = [rng.integers(0, 128, n).astype(np.int32) for n in (0, 1, 31, 32, 33, 200)]
    together = gru.log_likelihoods(model, texts, lanes=2)
    for text, found in zip(texts, together):
        h, total = np.zeros((1, 8), dtype=np.float32), 0.0
        for given, want in zip([gru.END, *text], [*text, gru.END]):
            states, h = gru._run(model, np.array([[given]]), np.zeros((1, 1), dtype=bool), h)
            total += gru._log_probs(model, states[0], np.array([want]))[0]
        assert math.isclose(found, total, rel_tol=1e-4)


def test_training_lowers_the_loss():
    texts = [np.tile(np.array([5, 9, 70], dtype=np.int32), 60) for _ in range(30)]
    start = gru.new_model(np.ones(128), hidden=8)
    assert gru.log_likelihoods(gru.train(start, texts), texts).sum() > gru.log_likelihoods(start, texts).sum()


def test_gradients_against_differences():
    rng, model = np.random.default_rng(5), {name: v.astype(np.float64) for name, v in _model().items()}
    texts = [rng.integers(2, 128, n).astype(np.int32) for n in (3, 40, 12)]
    inputs, targets, used, fresh, _ = next(gru.Lanes(texts, 2).windows())
    h = 0.1 * rng.standard_normal((2, 8))
    loss = lambda m: gru.gradients(m, inputs, targets, used, fresh, h)[2]
    found = gru.gradients(model, inputs, targets, used, fresh, h)[0]
    for name, g in found.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        up, down = ({n: v.copy() for n, v in model.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert math.isclose((loss(up) - loss(down)) / 2e-2, g[at], rel_tol=0.05), name


def test_a_very_long_text_among_short_ones():
    """Memory follows the tokens: as [lanes, longest] these texts would take gigabytes."""
    import tracemalloc

    rng = np.random.default_rng(6)
    texts = [rng.integers(2, 128, n).astype(np.int32) for n in (300_000, *[5] * 255)]
    model = gru.new_model(np.ones(128), hidden=4)
    tracemalloc.start()
    found = gru.log_likelihoods(model, texts, lanes=256)
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    assert math.isclose(found[0], gru.log_likelihoods(model, texts[:1])[0], rel_tol=1e-4) and (found < 0).all()


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty, lm.fit(empty)).count() == 0


def test_every_training_text_reaches_the_recurrent_part(spark, monkeypatch):
    monkeypatch.setattr(lm, "_MEAN_OF", 2)
    docs = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("start "), F.repeat(F.lit("common words "), 120)).alias("text"))
    dealt, kind = [], type(docs)
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n: dealt.append((df.count(), n)) or deal(df, n))
    model = lm.fit(docs, vocab=6, head=8, rounds=1, worker_tokens=200_000)
    assert dealt == [(4000, 5)]  # five workers, averaged in three levels
    assert all(np.isfinite(v).all() for v in model.parameters.values())
