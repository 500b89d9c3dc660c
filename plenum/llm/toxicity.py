"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of the words it has; a document is toxic if any of its
sentences is: its score is the noisy-or 1 - prod(1 - sentence score).  The weights are trained from
document labels through that formula, by Adam with a lasso step until the loss no longer falls, on at
most ``sample_rows`` labelled documents drawn by a hash of their id; equal texts in it count as one.  All texts are then scored
whole, and the sentences that reach ``threshold`` by themselves are located.

Features are the words, lower-cased and stripped of punctuation, and their first 4 to 7 letters, for
inflected words; only those that ``min_docs`` sampled documents have can get a weight, so the
model's size is bounded by the sample.

Defined results: a null or empty text has one empty sentence and so the lowest score there is;
labels of null, and ids without a document, teach nothing; a document with several labels counts as
toxic if one says so; without any labels left all scores are that of the initial bias; repeated rows
are scored alike; an empty table gives an empty result; columns named score or toxic_spans are
replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import discard, materialize

_SENTENCE = re.compile(r"[^.!?\n]+")
_PUNCTUATION = str.maketrans({c: " " for c in "\"'`,;:()[]{}<>|/\\#$%&*+=~^_-–—…«»“”„‘’¡¿"})
START_BIAS = -5.0


#: Lengths of the word beginnings that are features beside the words: inflected words share them.
STEMS = range(4, 8)
_CACHED = 200_000


def sentence_words(sentence: str) -> list[str]:
    return sentence.lower().translate(_PUNCTUATION).split()


def word_features(word: str) -> list[str]:
    """The word, and its proper beginnings marked as such."""
    return [word, *[word[:k] + "-" for k in STEMS if len(word) > k]]


def sentence_features(sentence: str) -> set[str]:
    return {f for w in set(sentence_words(sentence)) for f in word_features(w)}


class Weigher(dict):
    """Word -> the sum of its features' weights, kept for a bounded number of words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = x = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return x


def _log_miss(z: np.ndarray | float):
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0.0, z)


def noisy_or_loss(z: np.ndarray, doc_of: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean loss of documents with sentence logits ``z``, and its derivative by each of them."""
    miss = np.bincount(doc_of, weights=_log_miss(z), minlength=len(y))  # log of the chance that no sentence is toxic
    hit = np.maximum(-np.expm1(miss), 1e-12)
    loss = -np.where(y > 0, np.log(hit), miss).mean()
    # the derivative by z is the sentence's score, times 1 for clean documents and -(1 - p) / p for toxic ones
    pull = np.where(y > 0, -np.exp(miss) / hit, 1.0) / len(y)
    return float(loss), np.exp(z + _log_miss(z)) * pull[doc_of]


def fit(
    texts: list[str], labels: list[int], min_docs: int = 3, rate: float = 0.1, lasso: float = 1e-4, tolerance: float = 1e-3, stretch: int = 50, most_rounds: int = 20_000
) -> tuple[dict[str, float], float]:
    """Weights by word and the bias, from texts and 0/1 labels.

    Training ends when a stretch of rounds lowers the penalised loss by less than ``tolerance`` of it; ``most_rounds`` only guards
    against a fit that never settles.  Within a stretch only those weights move that aren't zero or whose gradient may make them so.
    """
    seen: dict[str, int] = {}
    for t, y in zip(texts, labels):
        seen[t] = max(seen.get(t, 0), int(y))
    y = np.array(list(seen.values()), dtype=np.float64)
    if not len(y):
        return {}, START_BIAS
    df: Counter[str] = Counter()
    for t in seen:
        df.update(sentence_features(t))
    index = {f: i for i, f in enumerate(sorted(f for f, n in df.items() if n >= min_docs))}
    doc_of, at, words = array("i"), array("i"), array("i")
    for d, t in enumerate(seen):
        for s in _SENTENCE.findall(t) or [""]:
            own = [index[f] for f in sentence_features(s) if f in index]
            at.extend([len(doc_of)] * len(own))
            words.extend(own)
            doc_of.append(d)
    doc_of, at, words = (np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, dtype=np.int32) for x in (doc_of, at, words))
    n, sentences = len(index), len(doc_of)
    w, b = np.zeros(n), START_BIAS
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    best, k = np.inf, 0
    while k < most_rounds:
        z = b + np.bincount(at, weights=w[words], minlength=sentences)
        _, g = noisy_or_loss(z, doc_of, y)
        moving = (w != 0) | (np.abs(np.bincount(words, weights=g[at], minlength=n)) > 0.5 * lasso)
        own = np.flatnonzero(moving)
        place = np.cumsum(moving) - 1
        kept = moving[words]
        own_at, own_words, own_w = at[kept], place[words[kept]], w[own]
        slots, least = np.append(own, n), np.inf
        own_m, own_v = m[slots], v[slots]
        for _ in range(stretch):
            k += 1
            z = b + np.bincount(own_at, weights=own_w[own_words], minlength=sentences)
            loss, g = noisy_or_loss(z, doc_of, y)
            least = min(least, loss + lasso * np.abs(own_w).sum())
            grad = np.append(np.bincount(own_words, weights=g[own_at], minlength=len(own)), g.sum())
            own_m, own_v = 0.9 * own_m + 0.1 * grad, 0.99 * own_v + 0.01 * grad**2
            scale = np.sqrt(own_v / (1 - 0.99**k)) + 1e-6
            step = rate * (own_m / (1 - 0.9**k)) / scale
            own_w, b = own_w - step[:-1], b - step[-1]
            own_w = np.sign(own_w) * np.maximum(np.abs(own_w) - rate * lasso / scale[:-1], 0.0)
        w[own], m[slots], v[slots] = own_w, own_m, own_v
        if least > best * (1 - tolerance):
            break
        best = least
    return {word: float(w[i]) for word, i in index.items() if w[i]}, float(b)


def score_text(text: str | None, weigher: Weigher, bias: float, threshold: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score, and start, end and score of each sentence that reaches the threshold alone."""
    miss, spans, sure = 0.0, [], 0
    for s in _SENTENCE.finditer(text or ""):
        sure += 1
        z = min(bias + sum(map(weigher.__getitem__, set(sentence_words(s[0])))), 30.0)
        miss += math.log1p(math.exp(z))
        if z > -20 and (p := 1 / (1 + math.exp(-z))) >= threshold:
            spans.append((s.start(), s.end(), p))
    if not sure:
        miss = math.log1p(math.exp(bias))
    return -math.expm1(-miss), spans


def sample_labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample_rows: int) -> DataFrame:
    """(text, label): at most ``sample_rows`` labelled ids, drawn by hash, with their texts."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    drawn = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "id").select("text", "label")


def train(sample: DataFrame, **options) -> tuple[dict[str, float], float]:
    """Fits the bounded sample inside one task and returns the model."""

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for frame in frames for r in zip(frame["text"], frame["label"])]
        weights, bias = fit([t for t, _ in rows], [y for _, y in rows], **options)
        yield pd.DataFrame([*weights.items(), ("", bias)], columns=["word", "weight"])

    rows = sample.coalesce(1).mapInPandas(fitted, "word string, weight double").collect()
    model = {r["word"]: r["weight"] for r in rows}
    return model, model.pop("", START_BIAS)


def score(docs: DataFrame, model: tuple[dict[str, float], float], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``toxic_spans``, the sentences (start, end, score) that reach ``threshold``."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,score:double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        weigher = Weigher(shared.value)
        rows = [score_text(t, weigher, bias, threshold) for t in texts]
        return pd.DataFrame({"score": [r[0] for r in rows], "spans": [[{"start": a, "end": b, "score": p} for a, b, p in r[1]] for r in rows]})

    plain = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "toxic_spans") and c != text])
    return plain.withColumn("toxic_spans", scored(F.col(text))).withColumns({"score": F.col("toxic_spans.score"), "toxic_spans": F.col("toxic_spans.spans")})


def classify(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 6_000) -> DataFrame:
    """``docs`` with score and toxic_spans, learned from ``labels`` (doc_id, label) of the documents ``train_on`` (default: all)."""
    sample = materialize(sample_labelled(docs if train_on is None else train_on, labels, doc_id, text, label, sample_rows), "toxic-sample")
    model = train(sample)
    discard(sample)
    return score(docs, model, text)
