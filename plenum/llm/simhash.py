"""SimHash near-duplicates by multi-index hashing.

Words are runs of anything but ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; shingles are some words
joined by a space (fewer words: the whole sequence; none: no shingle).  A bit of a fingerprint is 1
if it is 1 in over half of the shingles' hashes, repeats included.

``near_duplicates`` links fingerprints of 64 bits that differ in at most ``radius``.  A fingerprint
is cut into two halves; of two linked ones, some half differs in at most ``radius // 2`` bits.
Every distinct fingerprint is entered in a table under both halves and asks for all values in the
Hamming ball of that radius around each half; what is found is verified over all 64 bits.

``similar_texts`` links texts by the share of their five-word shingles, 0.8 or more.  Fingerprints of
384 bits or more are cut into segments, entered in a table; every text asks for the ball of one bit
around each; what is found is verified over all bits and then by the exact similarity of the shingle
sets.  A segment is some bits shorter than the logarithm of the number of texts, so that a table
entry stays short at any size, and there are so many segments that 0.92 of pairs of similarity 0.8
meet, and more of those more alike; at most 0.03 of these are more than ``most`` bits apart.

Large groups: the members of one table entry are first compared with few of them only, and what is
linked so is contracted; the joins over whole balls then only yield pairs of different
components, never the pairs inside a dense group.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows
and equal texts are one node; a null doc_id never names a component unless all its documents have
none; empty tables give empty results; a very long text is hashed in chunks.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from plenum.llm.components import connected_components
from plenum.llm.common import discard, fresh, materialize

_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)
_CHUNK = 1 << 16
#: Share of differing bits of two texts of similarity 0.8, whose shingle sets have a cosine of 0.8 * 2 / 1.8, and of such pairs that must meet.
_APART, _MEETING = math.acos(1.6 / 1.8) / math.pi, 0.92
#: Rows of (node, digest, id) up to which a join may broadcast them: 32 MB at most.
BROADCAST_ROWS = 500_000
#: Rounds in which the members of an entry of ``similar_texts`` are compared with few of them.
PIVOT_ROUNDS = 2
#: Members of an entry with which all others are compared in a round of ``similar_texts``.
PIVOTS = 4


def _hashes(words: list[bytes], k: int):
    """The hashes of all k-word shingles, in chunks."""
    shingles = map(b" ".join, zip(*[words[i:] for i in range(k)])) if len(words) >= k else iter([b" ".join(words)])
    n = max(len(words) - k + 1, 1)
    for at in range(0, n, _CHUNK):
        yield np.fromiter(map(_xxh64, shingles), dtype="<u8", count=min(_CHUNK, n - at))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: ASCII case and ASCII white space only


def _majority(parts, longs: int) -> np.ndarray:
    """64 bits per long: 1 where over half of the hashes have 1; further longs mix the hashes anew."""
    votes, n = np.zeros(64 * longs, dtype=np.int64), 0
    for h in parts:
        mixed = [h]
        for _ in range(longs - 1):
            x = mixed[-1] + np.uint64(0x9E3779B97F4A7C15)  # a step of the SplitMix64 generator
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed.append(x ^ (x >> np.uint64(31)))
        bits = np.unpackbits(np.stack(mixed, axis=1).view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
        n += len(h)
    return 2 * votes > n


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's three-word shingles."""
    words = _words(text)
    return int(np.packbits(_majority(_hashes(words, 3), 1), bitorder="little").view("<u8")[0]) if words else 0


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """``fingerprint`` of each text, as a signed 64-bit integer with the same bits."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of the given number of bits."""
    return [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def _halves(fp) -> list:
    """Both halves of a fingerprint, each with a bit that tells which half it is."""
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))]


def hamming_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints ``fp`` of ``nodes`` that differ in at most ``radius`` bits and have different ``root``."""
    ball = F.array(*[F.lit(m).cast("long") for m in _ball(32, radius // 2)])
    entered = nodes.select("fp", "root", F.explode(F.array(*_halves(F.col("fp")))).alias("key"))
    asked = entered.select("root", "fp", F.explode(F.transform(ball, lambda m: m.bitwiseXOR(F.col("key")))).alias("key"))
    x, y = asked.alias("x"), entered.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & near)
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))


def _neighbours(nodes: DataFrame) -> DataFrame:
    """(a, b): fingerprints that differ in one bit, looked up whole."""
    flips = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    asked = nodes.select(F.col("fp").alias("a"), F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("fp"))
    return asked.where("a < fp").join(nodes, "fp").select("a", F.col("fp").alias("b"))


def _pivot_links(rooted: DataFrame, radius: int, turn: int) -> DataFrame:
    """(a, b): roots of fingerprints with a common half that are near the entry's pivot, which is drawn anew by each turn."""
    entered = rooted.select("fp", "root", F.explode(F.array(*_halves(F.col("fp")))).alias("key"))
    drawn = F.struct(F.xxhash64("fp", F.lit(turn)).alias("draw"), "fp", "root")
    pivots = entered.groupBy("key").agg(F.min(drawn).alias("p"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= radius
    return entered.join(pivots, "key").where(near & (F.col("root") != F.col("p.root"))).select(F.col("root").alias("a"), F.col("p.root").alias("b"))


def _contracted(rooted: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """``rooted`` (node, root, ...) with the roots that ``links`` (a, b) between roots leave."""
    merged = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(merged, "root", "left").select(node, F.coalesce("top", "root").alias("root"))


def components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root): every distinct ``fp`` of ``prints`` with the least fingerprint reachable over links of ``radius`` bits."""
    nodes = materialize(prints.select("fp").distinct(), "fps")
    if not radius:
        return nodes.withColumn("root", F.col("fp"))
    first = _neighbours(nodes)
    if radius > 1:
        first = first.union(_pivot_links(nodes.withColumn("root", F.col("fp")), radius, 0))
    near = connected_components(first).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(near, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "fps")
    discard(nodes)
    return _contracted(rooted, hamming_links(rooted, radius).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``; component_id is the smallest doc_id reachable."""
    prints = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "prints")
    roots = components(prints, radius)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = materialize(roots.join(firsts, "fp"), "classes")
    tops = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(tops, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- texts by similarity

def segmentation(texts: int) -> tuple[int, int, int, int]:
    """Bits of a segment, segments, longs of a fingerprint, and the differing bits up to which two of that many texts are candidates."""
    bits = max(16, math.ceil(math.log2(max(texts, 1))) - 6)
    meet = (1 - _APART) ** bits + bits * _APART * (1 - _APART) ** (bits - 1)
    segments = math.ceil(math.log(1 - _MEETING) / math.log(1 - meet))
    longs = max(6, -(-segments // (64 // bits)))  # no segment reaches from one long into the next
    return bits, segments, longs, round(64 * longs * _APART + 2 * math.sqrt(64 * longs * _APART * (1 - _APART)))


_LONGS = ArrayType(LongType())


def _long_prints(bits: int, segments: int, longs: int, shingle: int):
    """A function of texts: the table keys of each segment, which tell its place too, and all bits of the fingerprint."""
    weights, place = 1 << np.arange(bits, dtype=np.int64), np.arange(segments, dtype=np.int64) << bits

    @F.pandas_udf(StructType().add("keys", _LONGS).add("bits", _LONGS))
    def prints(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = _words(t)
            b = _majority(_hashes(words, shingle), longs) if words else np.zeros(64 * longs, dtype=bool)
            rows.append((b.reshape(longs, 64)[:, : 64 // bits * bits].reshape(-1, bits)[:segments] @ weights | place, np.packbits(b, bitorder="little").view("<i8")))
        return pd.DataFrame(rows, columns=["keys", "bits"])

    return prints


@F.pandas_udf(BinaryType())
def _shingle_sets(texts: pd.Series, ks: pd.Series) -> pd.Series:
    """The sorted distinct hashes of each text's shingles."""
    return pd.Series([np.unique(np.concatenate(list(_hashes(w, k)))).tobytes() if (w := _words(t)) else b"" for t, k in zip(texts, ks)])


@F.pandas_udf(DoubleType())
def _similarities(left: pd.Series, right: pd.Series) -> pd.Series:
    """Common shingles by all shingles of two sorted sets; 1 for two empty ones."""
    out = []
    for a, b in zip(left, right):
        x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
    return pd.Series(out)


def _near(x: str, y: str, longs: int, most: int) -> Column:
    """Whether two fingerprints of so many longs differ in at most ``most`` bits."""
    return sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(longs)), F.lit(0)) <= most


def _first_met(key: str, x: str, y: str, bits: int, segments: int) -> Column:
    """Whether no segment before the key's own is within one bit too: a pair comes out once."""
    per, own, mask = 64 // bits, F.shiftright(key, bits), F.lit((1 << bits) - 1)
    apart = lambda s: F.bit_count(F.shiftright(F.get(x, s // per).bitwiseXOR(F.get(y, s // per)), s % per * bits).bitwiseAND(mask))
    later = F.lit(True)
    for s in range(segments - 1):
        later = later & ((own <= s) | (apart(s) > 1))
    return later


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b, ra, rb) of nodes and their roots that are similar by their shingles."""
    near = materialize(pairs, "near-pairs")
    asked = near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(nodes.select("node", "digest", "first"), "node")
    asked = materialize(asked, "asked-texts")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    # the row of the first id stands for all rows with its text
    found = texts.join(few, "digest").where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(found.select("node", _shingle_sets("text", F.lit(shingle)).alias("own")), "shingle-sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("own").alias(f"{name}_own"))
    met = near.join(side("a"), "a").join(side("b"), "b")
    links = materialize(met.where(_similarities("a_own", "b_own") >= similarity).select("ra", "rb"), "links")
    discard(near, asked, sets)
    return links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(digest, first, root): every distinct text by its digest, with the smallest doc_id that has it and its component."""
    bits, segments, longs, most = segmentation(docs.count())
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    printed = texts.select("digest", _long_prints(bits, segments, longs, shingle)("text").alias("p")).groupBy("digest").agg(F.min("p").alias("p"))
    nodes = materialize(printed.join(firsts, "digest").select(F.monotonically_increasing_id().alias("node"), "digest", "first", "p.keys", "p.bits"), "texts")
    rooted = materialize(nodes.select("node", F.col("node").alias("root")), "text-roots")

    def contract(pairs: DataFrame) -> None:
        nonlocal rooted
        links = _verified(pairs, nodes, texts, shingle, similarity)
        was, rooted = rooted, materialize(_contracted(rooted, links, "node"), "text-roots")
        discard(was)

    def entries() -> DataFrame:
        return nodes.join(rooted, "node").select("node", "root", "bits", F.explode("keys").alias("key"))

    pair = [F.col(c).alias(n) for c, n in (("x.node", "a"), ("y.node", "b"), ("x.root", "ra"), ("y.root", "rb"))]
    for turn in range(PIVOT_ROUNDS):
        x = entries()
        drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "root", "bits")
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS)).alias("slot")
        y = x.groupBy("key", slot).agg(F.min(drawn).alias("p")).select("key", "p.node", "p.root", "p.bits").alias("y")
        met = x.alias("x").join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _near("x.bits", "y.bits", longs, most))
        contract(met.select(*pair).distinct())

    entered = entries()
    ball = F.array(*[F.lit(m).cast("long") for m in _ball(bits, 1)])
    asked = entered.select("node", "root", "bits", F.explode(F.transform(ball, lambda m: m.bitwiseXOR(F.col("key")))).alias("key"))
    x, y = asked.alias("x"), entered.alias("y")
    differ = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    once = _near("x.bits", "y.bits", longs, most) & _first_met("x.key", "x.bits", "y.bits", bits, segments)
    contract(x.join(y, (F.col("x.key") == F.col("y.key")) & differ & once).select(*pair).distinct())
    return nodes.select("node", "digest", "first").join(rooted, "node").select("digest", "first", "root")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of similar texts: that with the smallest doc_id.

    Of equal rows with that doc_id one stays; different texts of one doc_id are judged each by itself, and of similar ones the
    first by digest stays.  Rows without a doc_id name no document that could be kept for them; they stay.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    found = similar_texts(named, doc_id, text, shingle, similarity)
    one = found.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("k"))
    digest, kept_id, kept = fresh(docs, "digest_of"), fresh(docs, "kept_id"), fresh(docs, "kept_digest")
    one = one.select(F.col("k.first").alias(kept_id), F.col("k.digest").alias(kept))
    marked = named.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    first = marked.join(one, (F.col(doc_id) == F.col(kept_id)) & (F.col(digest) == F.col(kept)), "left_semi").dropDuplicates([doc_id, digest])
    return first.drop(digest).unionByName(docs.where(F.col(doc_id).isNull()))
