"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the line, stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased; keys under
``min_chars`` code points never count.  A key that several documents hold keeps its lines in the
smallest doc_id that holds it and loses them in all others.

The store has three tables in the shared folder, written anew by each change:

* postings (key, doc_id): which document holds which key;
* counts (key, n_docs, first, shard, seq): the exact reference count and first holder of each key;
* filters (shard, seq, blob): cuckoo filters over the keys of each shard.

Inserting documents asks the filters first.  What they deny is new and only appended; what they may
hold is looked up in the counts, which are exact.  A shard that is full gets a further filter; seq
tells which one a key is in, so deleting takes the right entry out.  Deleting documents lowers the
counts, names the next holder and takes keys nobody holds any more out of the filters: the lines
of the documents left come back as if the deleted ones had never been there.

When an insertion brings more keys than the shards are meant for, twice over, the keys are dealt to
more shards and the filters made anew from the counts.  ``dedup_lines`` inserts a table in two parts:
the keys of the second ask the filters that hold those of the first.

Keys are MD5 digests.  A key of very many documents is counted map-side before it is shuffled; its
postings are joined by a join that adaptive execution can split; a shard holds distinct keys only.

Defined results: a null or empty text has one empty line; rows without a doc_id are neither counted
nor changed; repeated rows of a doc_id are one document, each row losing the same lines; ids may have any type that can be ordered; inserting a
document again changes nothing; empty tables give empty results; the text may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import discard, fresh, materialize
from plenum.llm.cuckoo import CuckooFilter

_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The digest of a line's key; None if the key is too short to count."""
    key = line.encode().strip(_SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return md5(key, usedforsecurity=False).digest()


def _postings(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, found = [], []
            for i, t in enumerate(frame["text"]):
                own = {line_key(x, min_chars) for x in (t or "").split("\n")} - {None}
                rows += [i] * len(own)
                found += own
            yield pd.DataFrame({"key": found, "doc_id": frame["doc_id"].take(rows).to_numpy()})

    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return named.mapInPandas(keys, f"key binary, doc_id {kind}").distinct()


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)[:, 0]


def _inserted(new: pd.DataFrame, chain: pd.DataFrame, sure: bool = False) -> pd.DataFrame:
    """Of one shard: for each key whether a filter may hold it (seq -1), or else the seq of the filter it went into; and the filters.

    sure: the keys are known to be new, whatever the filters say.
    """
    chain = chain.sort_values("seq")
    filters = [CuckooFilter.from_bytes(b) for b in chain["blob"]]
    keys = list(new["key"])
    h = _hashes(keys)
    seen = np.zeros(len(h), dtype=bool)
    for f in () if sure else filters:
        seen |= f.contains(h)
    seq = np.full(len(h), -1)
    todo = np.flatnonzero(~seen)
    at = max(len(filters) - 1, 0)
    while len(todo):
        if at == len(filters):
            filters.append(CuckooFilter.of_capacity(2 * max(len(todo), len(filters[-1].table) if filters else 0)))
        refused = filters[at].insert(h[todo])
        seq[todo[~refused]] = at
        todo, at = todo[refused], at + 1
    shard = (new if len(new) else chain)["shard"].iloc[0]
    out = [pd.DataFrame({"shard": shard, "key": keys, "seq": seq, "blob": None})]
    out.append(pd.DataFrame({"shard": shard, "key": None, "seq": range(len(filters)), "blob": [f.to_bytes() for f in filters]}))
    return pd.concat(out, ignore_index=True)


def _deleted(gone: pd.DataFrame, chain: pd.DataFrame) -> pd.DataFrame:
    """The filters of one shard without the keys of ``gone``."""
    blobs = []
    for seq, blob in zip(chain["seq"], chain["blob"]):
        f = CuckooFilter.from_bytes(blob)
        f.delete(_hashes(gone["key"][gone["seq"] == seq]))
        blobs.append(f.to_bytes())
    return chain.assign(blob=blobs)


_FILTERS = "shard int, seq int, blob binary"


class LineStore:
    """The lines of the documents inserted and not deleted."""

    def __init__(self, spark: SparkSession, min_chars: int = 10, shard_keys: int = 100_000, id_type: str = "bigint"):
        """shard_keys: keys a shard is meant for; id_type: the type of document ids."""
        self.spark, self.min_chars, self.shard_keys, self.id_type = spark, min_chars, shard_keys, id_type
        self.shards = 0
        self.postings = spark.createDataFrame([], f"key binary, doc_id {id_type}")
        self.counts = spark.createDataFrame([], f"key binary, n_docs long, first {id_type}, shard int, seq int")
        self.filters = spark.createDataFrame([], _FILTERS)

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    def _ask(self, keys: DataFrame, answer) -> DataFrame:
        """The answers of the filters to ``keys``, and the filters afterwards, of every shard."""
        asked = self._sharded(keys.select("key")).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        told = asked.applyInPandas(lambda new, chain: answer(new, chain), "shard int, key binary, seq int, blob binary")
        return materialize(told, "line-answers")

    def _replace(self, **tables: DataFrame) -> None:
        """Takes on new tables; the files of the old ones go, so frames made from the store must be written before it changes."""
        for name, new in tables.items():
            old = getattr(self, name)
            setattr(self, name, new)
            if old is not new:
                discard(old)

    def _reshard(self, keys: int) -> None:
        """Deals all keys to as many shards as they need now and makes the filters anew."""
        self.shards = max(1, -(-keys // self.shard_keys))
        empty = self.spark.createDataFrame([], _FILTERS)
        told = self._sharded(self.counts.select("key")).groupBy("shard").cogroup(empty.groupBy("shard"))
        answers = materialize(told.applyInPandas(lambda new, chain: _inserted(new, chain, sure=True), "shard int, key binary, seq int, blob binary"), "line-answers")
        counts = self.counts.drop("shard", "seq").join(answers.where("key IS NOT NULL").select("key", "shard", "seq"), "key")
        filters = materialize(answers.where("key IS NULL").select("shard", "seq", "blob"), "line-filters")
        self._replace(counts=materialize(counts.select("key", "n_docs", "first", "shard", "seq"), "line-counts"), filters=filters)
        discard(answers)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Adds the documents' lines."""
        new, first_time = materialize(_postings(docs, doc_id, text, self.min_chars), "line-postings"), not self.shards
        if not first_time:
            own, new = new, materialize(new.join(self.postings, ["key", "doc_id"], "left_anti"), "line-postings")
            discard(own)
        delta = materialize(new.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first")), "line-delta")
        n_keys = delta.count()
        if first_time:
            self.shards = max(1, -(-n_keys // self.shard_keys))
        elif (total := n_keys + self.counts.count()) > 2 * self.shards * self.shard_keys:
            self._reshard(total)
        answers = self._ask(delta, _inserted)
        told = delta.join(answers.where("key IS NOT NULL").select("key", "shard", "seq"), "key")
        if first_time:
            # written, so that a join with the postings deals both sides anew and adaptive execution can split a hot key
            counts = materialize(told.select("key", "n_docs", "first", "shard", "seq"), "line-counts")
            self._replace(counts=counts, postings=new, filters=materialize(answers.where("key IS NULL").select("shard", "seq", "blob"), "line-filters"))
            discard(answers, delta)
            return
        added = told.where("seq >= 0").select("key", "n_docs", "first", "shard", "seq")
        maybe = materialize(told.where("seq < 0").select("key", "n_docs", "first"), "line-maybe")
        known = maybe.alias("m").join(self.counts.alias("c"), "key")
        merged = known.select("key", F.expr("m.n_docs + c.n_docs AS n_docs"), F.expr("least(m.first, c.first) AS first"), "shard", "seq")
        self._replace(filters=materialize(answers.where("key IS NULL").select("shard", "seq", "blob"), "line-filters"))
        # what a filter seems to hold and the counts don't have is new after all, and gets an entry of its own
        false = materialize(maybe.join(self.counts, "key", "left_anti"), "line-false")
        forced = self._ask(false, partial(_inserted, sure=True))
        late = false.join(forced.where("key IS NOT NULL").select("key", "shard", "seq"), "key")
        rest = self.counts.join(maybe, "key", "left_anti")
        counts = materialize(added.unionByName(merged).unionByName(late).unionByName(rest), "line-counts")
        filters = materialize(forced.where("key IS NULL").select("shard", "seq", "blob"), "line-filters")
        self._replace(counts=counts, filters=filters, postings=materialize(self.postings.unionByName(new), "line-postings"))
        discard(answers, delta, maybe, false, forced, new)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Takes the documents with these ids out again."""
        ids = ids.select(F.col(doc_id).cast(self.id_type).alias("doc_id")).distinct()
        gone = materialize(self.postings.join(ids, "doc_id", "left_semi"), "line-gone")
        left = materialize(self.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "line-postings")
        fewer = gone.groupBy("key").agg(F.count("*").alias("less"), F.min("doc_id").alias("gone_first"))
        touched = materialize(self.counts.join(fewer, "key").withColumn("n_docs", F.expr("n_docs - less")), "line-touched")
        orphans = touched.where("n_docs > 0 AND first = gone_first").select("key")
        heirs = left.join(orphans, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
        again = touched.where("n_docs > 0").join(heirs, "key", "left").withColumn("first", F.coalesce("heir", "first"))
        cols = ["key", "n_docs", "first", "shard", "seq"]
        rest = self.counts.join(touched, "key", "left_anti")
        dead = touched.where("n_docs = 0").select("key", "shard", "seq")
        filters = dead.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_deleted, _FILTERS)
        counts = materialize(again.select(cols).unionByName(rest.select(cols)), "line-counts")
        self._replace(counts=counts, filters=materialize(filters, "line-filters"), postings=left)
        discard(gone, touched)

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` with ``text`` less the lines that go, and n_lines and n_dropped."""
        repeated = self.counts.where("n_docs > 1").select("key", "first")
        drops = self.postings.join(repeated, "key").where("doc_id <> first").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
        lost, holder = fresh(docs, "line_keys"), fresh(docs, "line_doc")
        drops = drops.select(F.col("doc_id").alias(holder), F.col("keys").alias(lost))
        plain = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped") and c not in (doc_id, text)])
        joined = plain.join(drops, plain[doc_id] == F.col(holder), "left").drop(holder)
        result, min_chars = fresh(joined, "line_result"), self.min_chars

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def less(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
            rows = []
            for t, gone in zip(texts, keys):
                lines = (t or "").split("\n")
                if gone is None:
                    rows.append((t, len(lines), 0))
                    continue
                gone = set(gone)
                kept = [x for x in lines if line_key(x, min_chars) not in gone]
                rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        done = joined.withColumn(result, less(F.col(text), F.col(lost)))
        kept = [F.col(f"{result}.text").alias(c) if c == text else F.col(c) for c in plain.columns]
        return done.select(*kept, f"{result}.n_lines", f"{result}.n_dropped")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` less the lines that documents with smaller ids hold: inserted in two parts, dealt by a hash of the id."""
    store = LineStore(docs.sparkSession, min_chars, id_type=docs.schema[doc_id].dataType.simpleString())
    part = F.pmod(F.xxhash64(doc_id), F.lit(2))
    store.insert(docs.where(part == 0), doc_id, text)
    store.insert(docs.where(part == 1), doc_id, text)
    return store.apply(docs, doc_id, text)
