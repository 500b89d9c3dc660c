"""Scores whole texts by a gated recurrent language model and by plain word frequencies.

Tokens are the words of the text, A-Z lower-cased, and one end.

1. Every word of every training text is counted, by batch and then by a shuffle.
2. The ``vocab`` most frequent words get a token of their own in the recurrent model (gru.py), all
   others share one; ``head`` words, a bounded number, are looked up inside tasks.
3. The model is trained on all training texts: workers run over their own part from common
   parameters, whose mean, weighted by tokens, is formed in Spark and starts the next round.
4. Every text is scored whole, lanes of texts side by side, the state carried across windows.  Words
   outside the head travel to their counts by a join; none of those is frequent enough to be hot.

A word outside the vocabulary has the probability of the shared token times its frequency among the
words outside, so that the model's probabilities sum to one over all words.

Defined results: a null or empty text has only its end; unseen words count c = 0; repeated rows are
scored alike; a null id is scored like any other; without training texts the model knows no words;
an empty table gives an empty result; further columns are ignored; a text may have any length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm import gru
from plenum.llm.common import materialize

#: Bytes of the longest word that tasks are told of.
WORD_BYTES = 64
_BLOCK = 4096  # parameters of a row while means are formed
_MEAN_OF = 64  # workers whose parameters a task averages at once
_LANE_TOKENS = 4_000_000  # tokens that a task lays in lanes at once, beside one text of any length


def words(text: str | None) -> list[bytes]:
    """The words of a text: of bytes, so that only ASCII letters and white space count as such."""
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter[bytes] = Counter()
            for t in batch.column(0).to_pylist():
                c.update(words(t))
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], ["word", "c"])

    return docs.select(text).mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """What tasks need to know of the counts: bounded by the number of head words."""

    rank: dict[bytes, int]
    log_base: np.ndarray  # log10 frequency by rank
    vocab: int  # words with a token of their own: the ranks below
    ends: int  # training texts
    tokens: int  # N
    distinct: int  # V

    def log10(self, c: float) -> float:
        return math.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def ids(self, found: np.ndarray) -> np.ndarray:
        """Model tokens of words by their rank (-1: not in the head)."""
        return np.where((found >= 0) & (found < self.vocab), found + 2, gru.UNKNOWN).astype(np.int32)

    def ranks(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))


@dataclass(frozen=True)
class LanguageModel:
    lexicon: Lexicon
    counts: DataFrame  # (word, c), of all training words
    log_outside: float  # log10 of the frequency of all words outside the vocabulary
    parameters: dict[str, np.ndarray]


def _frequent(counts: DataFrame, head: int) -> DataFrame:
    """The words of ``counts`` that can be among the ``head`` most frequent: few more than these, and dealt over few tasks' results.

    Words are counted by magnitude, an eighth of a power of two each, of which there are some hundreds.
    """
    size = F.floor(8 * F.log2("c"))
    sizes = sorted(((r["size"], r["n"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, 0
    for least, n in sizes:
        total += n
        if total >= head:
            break
    return counts.where(size >= least)


def fit(docs: DataFrame, text: str = "text", vocab: int = 1022, head: int = 131_072, hidden: int = 16, worker_tokens: int = 2_000_000, rounds: int = 1) -> LanguageModel:
    """A model of the given training texts; the recurrent part, too, is trained on every one of them.

    vocab, head: words with a token of their own in the recurrent model, and words whose counts tasks know; words of more than
    ``WORD_BYTES`` have neither, so what is broadcast has a bound in bytes, and find their counts by a join.
    worker_tokens: tokens from which a worker makes one set of parameters; their number grows with the corpus.
    """
    spark = docs.sparkSession
    counts = materialize(count_words(docs, text), "word-counts")
    n_words, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    ends = docs.count()
    n_words = n_words or 0
    top = [(bytes(r["word"]), r["c"]) for r in _frequent(counts.where(F.length("word") <= WORD_BYTES), head).orderBy(F.desc("c"), "word").limit(head).collect()]
    lexicon = Lexicon({w: i for i, (w, _) in enumerate(top)}, np.array([]), min(vocab, len(top)), ends, n_words + ends, distinct + (ends > 0))
    lexicon = Lexicon(lexicon.rank, np.array([lexicon.log10(c) for _, c in top]), lexicon.vocab, ends, lexicon.tokens, lexicon.distinct)

    own = np.zeros(-(-(vocab + 2) // gru.WIDTH) * gru.WIDTH)
    own[gru.END] = ends
    own[2 : lexicon.vocab + 2] = [c for _, c in top[: lexicon.vocab]]
    own[gru.UNKNOWN] = n_words - own[2:].sum()
    inside = (10 ** lexicon.log_base[: lexicon.vocab]).sum() + 10 ** lexicon.log10(ends)
    model = gru.new_model(own, hidden)

    texts = docs.select(F.col(text).alias("text"))
    workers = max(1, round(n_words / worker_tokens))
    lex = spark.sparkContext.broadcast(lexicon)
    means = "block int, n long, values array<float>"

    for _ in range(rounds if n_words else 0):
        start = spark.sparkContext.broadcast(model)

        def trained(frames: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            known = lex.value
            texts = [known.ids(known.ranks(words(t))) for frame in frames for t in frame["text"]]
            n = sum(map(len, texts)) + len(texts)
            vector = gru.pack(gru.train(start.value, texts) if n else start.value)
            blocks = [vector[i : i + _BLOCK] for i in range(0, len(vector), _BLOCK)]
            yield pd.DataFrame({"block": range(len(blocks)), "n": n, "values": blocks})

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            weights = np.maximum(frame["n"].to_numpy(dtype=np.float64), 1e-9)
            average = np.average(np.stack(frame["values"].to_list()), axis=0, weights=weights)
            return pd.DataFrame({"block": frame["block"].iloc[:1], "n": [int(frame["n"].sum())], "values": [average.astype(np.float32)], "part": frame["part"].iloc[:1]})

        parts = texts.repartition(workers).mapInPandas(trained, means).withColumn("part", F.spark_partition_id())
        left = workers
        while left > 1:  # a task averages the parameters of few workers, in as many levels as it takes
            left = -(-left // _MEAN_OF)
            parts = parts.withColumn("part", F.floor(F.col("part") / _MEAN_OF).cast("int")).groupBy("block", "part").applyInPandas(mean, means + ", part int")
        merged = parts.collect()
        vector = np.concatenate([np.asarray(r["values"], dtype=np.float32) for r in sorted(merged, key=lambda r: r["block"])])
        model = gru.unpack(vector, model)
    return LanguageModel(lexicon, counts, math.log10(max(1 - inside, 1e-12)), model)


def score(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10 probabilities."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.lexicon, model.parameters))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, parameters = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, known, base, unknown_base, unknown, tails, sizes = ([] for _ in range(7))
            likely, waiting, laid = [], [], 0
            for t in texts:
                ws = words(t)
                at = lexicon.ranks(ws)
                frequent = lexicon.log_base[at[at >= 0]]
                tail = [ws[i] for i in np.flatnonzero(at < 0)]
                n.append(len(ws))
                known.append(len(frequent))
                base.append(float(frequent.sum()))
                unknown_base.append(float(lexicon.log_base[at[at >= lexicon.vocab]].sum()))
                unknown.append(int(((at < 0) | (at >= lexicon.vocab)).sum()))
                tails += tail
                sizes.append(len(tail))
                waiting.append(lexicon.ids(at))
                laid += len(ws) + 1
                if laid >= _LANE_TOKENS:
                    likely.append(gru.log_likelihoods(parameters, waiting))
                    waiting, laid = [], 0
            likely.append(gru.log_likelihoods(parameters, waiting))
            cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(unknown_base, pa.float64()),
                    pa.array(unknown, pa.int64()), pa.array(np.concatenate(likely) / math.log(10), pa.float64()), pa.ListArray.from_arrays(cuts, pa.array(tails, pa.binary())),
                ],
                ["rid", "doc_id", "n", "known", "base", "unknown_base", "unknown", "likely", "tail"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, n long, known long, base double, unknown_base double, unknown long, likely double, tail array<binary>"
    # the number of a row is its place in the input; it is written with the row before anything is joined to it
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done = materialize(numbered.mapInArrow(scored, schema), "lm-scored")

    lexicon = model.lexicon
    tail = done.select("rid", F.explode("tail").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    met = tail.join(model.counts, "word", "left").select("rid", "times", F.coalesce("c", F.lit(0)).alias("c"))
    log_base = F.log10((F.col("c") + 0.5) / F.lit(lexicon.tokens + 0.5 * (lexicon.distinct + 1)))
    sums = met.groupBy("rid").agg(F.sum(F.col("times") * log_base).alias("tail_base"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("tail_known"))
    both = done.drop("tail").join(sums, "rid", "left").na.fill(0, ["tail_base", "tail_known"])
    return both.select(
        "doc_id",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.col("tail_known") + F.lit(int(lexicon.ends > 0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_base") + F.lit(lexicon.log10(lexicon.ends))).alias("base_score"),
        (F.col("likely") + F.col("unknown_base") + F.col("tail_base") - F.col("unknown") * F.lit(model.log_outside)).alias("score"),
    )
