"""Length-bucketed batches for training: optimal bucket boundaries, then token-budget batches.

Documents are cut into pieces of at most ``max_tokens`` tokens (here: words).  The histogram of
piece lengths, which has at most ``max_tokens + 1`` rows, goes to the driver; dynamic programming
finds the ``buckets`` boundaries with the least padding over all pieces.  A batch holds as many
pieces as the token budget takes when each is padded to its bucket's boundary.

Batches form inside groups of about ``group_rows`` pieces of one bucket, dealt by a hash of the row's
own number and not of its values, so that no window holds a whole bucket, nor all rows of an id that
repeats; each group ends with one batch that may not be full.

Defined results: a null or empty text is one piece of no tokens; repeated rows are packed once each;
a null doc_id is packed like any other; ties in length are ordered by doc_id and piece; an empty
table gives an empty result; a very long text becomes many pieces and loses no token; a piece's text is the
original one from its first token's white space on, so the pieces of a text in order are the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import SPACES, bind, materialize, words_of


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper bounds, at most ``buckets`` of them, that minimise the sum of (bound - length) over the histogram."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    # padding to bound j of lengths i..j is bound * their number less their sum; the sums of all lengths are the same for any choice
    best = np.where(np.arange(len(lengths) + 1) == 0, 0.0, np.inf)
    cuts = []
    for _ in range(min(buckets, len(lengths))):
        new, cut = np.full_like(best, np.inf), np.zeros(len(best), dtype=np.int64)
        for j in range(1, len(best)):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j])
            cut[j] = np.argmin(cost)
            new[j] = cost[cut[j]]
        cuts.append(cut)
        best = new
    out, j = [], len(lengths)
    for cut in reversed(cuts):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_tokens: int = 2048, with_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, n_tokens[, text]): the pieces of each row, from token ``start`` on."""
    if not with_text:
        cut = docs.select(F.col(doc_id).alias("doc_id"), F.size(words_of(F.col(text))).alias("size"))
        at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / max_tokens)).cast("int")))
        placed = cut.select("doc_id", "size", at.alias("piece"))
        return placed.select("doc_id", "piece", (F.col("piece") * max_tokens).alias("start"), F.least(F.lit(max_tokens), F.col("size") - F.col("piece") * max_tokens).alias("n_tokens"))
    # each token with the white space before it, and what is left at the end: the pieces of a text in order are the text
    whole = F.coalesce(F.col(text), F.lit(""))
    spaced = F.regexp_extract_all(whole, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    end = F.substring(whole, F.length(F.rtrim(whole, F.lit(SPACES))) + 1, F.length(whole))

    def sliced(tokens: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(tokens) - 1) / max_tokens)).cast("int")
        own = lambda i: F.slice(tokens, i * max_tokens + 1, max_tokens)
        piece = lambda i: F.struct(F.size(own(i)).alias("n_tokens"), F.concat(F.array_join(own(i), ""), F.when(i == last, end).otherwise("")).alias("text"))
        return F.transform(F.sequence(F.lit(0), last), piece)

    placed = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(bind(spaced, sliced)).alias("piece", "own"))
    return placed.select("doc_id", "piece", (F.col("piece") * max_tokens).alias("start"), "own.n_tokens", "own.text")


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_tokens: int = 2048,
    buckets: int = 8,
    token_budget: int = 16384,
    group_rows: int = 2048,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, batch, slot[, text]): every piece, its bucket's padded length, its batch and its place there."""
    # numbered while it is written: the number is a value from then on
    cut = materialize(pieces(docs, doc_id, text, max_tokens, with_text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds = boundaries(histogram, buckets)
    if not bounds:
        bounds = [max_tokens]
    groups = [-(-sum(n for x, n in histogram.items() if low < x <= high) // group_rows) or 1 for low, high in zip([-1, *bounds], bounds)]
    rank = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("n_tokens")))
    placed = cut.withColumn("b", rank).withColumn("bucket", F.get(F.array(*[F.lit(b) for b in bounds]), F.col("b")))
    placed = placed.withColumn("group", F.pmod(F.xxhash64("row"), F.get(F.array(*[F.lit(g) for g in groups]), F.col("b"))))
    nth = F.row_number().over(Window.partitionBy("bucket", "group").orderBy("n_tokens", "doc_id", "piece", "row")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("int")
    numbered = placed.withColumn("nth", nth).withColumn("room", room)
    batch = F.concat_ws("-", "bucket", "group", F.floor(F.col("nth") / F.col("room")))
    out = numbered.select("*", batch.alias("batch"), (F.col("nth") % F.col("room")).alias("slot"))
    return out.select("doc_id", "piece", "start", "n_tokens", "bucket", "batch", "slot", *(["text"] if with_text else []))
