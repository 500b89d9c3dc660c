"""Benchmark decontamination by SimHash of item-sized windows, built from DataFrame functions only.

Words are the runs of anything but ``[\\x20\\x09-\\x0D]`` of the lower-cased text; shingles are
``k`` words (an item with fewer words is one shingle).  A shingle weighs as much as it occurs.  The
similarity of an item and a window of as many words is the weight both share by the weight of
either; pairs of at least ``similarity`` are reported.

1. A window can only be that similar if enough of its shingles occur in items of its size.  Of all
   places where a window could lie, those are taken that hold as many: between two neighbouring
   hits the first hit of a window is the same, so the places follow from the sorted hits alone.
2. Windows and items get 64-bit SimHash fingerprints of their weighted shingles.
3. Fingerprints are cut into ``radius + 1`` blocks.  Two that differ in at most ``radius`` bits
   agree in some block, so an equi-join on a block and its value finds every such pair.  Blocks are
   short at this radius, and alone would let nearly all windows and items of a size meet.  So a
   window asks only for items with one of whose rarest shingles it may overlap: all but the fewest
   shingles that must be shared are an item's prefix, and a similar window holds one of these.
4. The candidates' similarity is computed exactly, from the shingles themselves.

A window of similarity 0.8 differs by about 10 bits from its item, with a deviation of 3; the radius
of 20 leaves it out less than once in a thousand times.

Defined results: null and empty texts, and items without words, match nothing; a document shorter
than an item is compared whole; of a document's windows for an item the most similar is returned,
of equals the first; rows without an id are not judged; repeated rows of a doc_id count as one
document; empty tables give empty results; columns beside id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import SPACE_RE, bind, discard, fresh, materialize

#: Rows of (hash, size) or document ids up to which a join may broadcast them: 32 MB at most.
BROADCAST_ROWS = 1_000_000
#: Starts of a document whose windows are cut in one row.
WINDOWS_PER_ROW = 1024


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_RE), "")


def _slices(words: Column, k: Column | int) -> Column:
    """All k-word shingles, or the whole sequence if it is shorter; none of no words."""
    k = F.lit(k) if isinstance(k, int) else k
    whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    many = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) > k, many).otherwise(whole)


def _position_hashes(words: Column, k: int) -> Column:
    """The hash of the k words from each position on."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.when(F.size(words) >= k, F.slice(hashes, 1, F.size(words) - k + 1)).otherwise(F.array().cast("array<long>"))


def _simhash(shingles: Column) -> Column:
    """Bit b is 1 if it is 1 in over half of the shingles' hashes, repeats included."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def bits(hs: Column) -> Column:
        ones = lambda b: F.aggregate(hs, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        powers = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
        set_bits = F.transform(powers, lambda p, b: F.when(2 * ones(b) > F.size(hs), p).otherwise(F.lit(0).cast("long")))
        return F.aggregate(set_bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return bind(hashes, bits)


def _tagged(shingles: Column) -> Column:
    """Shingles with the number of equal ones before them, so that sets of these are the multisets."""
    return F.transform(shingles, lambda s, i: F.struct(s.alias("s"), F.size(F.filter(F.slice(shingles, 1, i), lambda t: t == s)).alias("n")))


def _starts(ps: Column, size: Column, n: Column, length: int, similarity: tuple[int, int]) -> Column:
    """All starts of windows of n words that hold enough of the sorted hits ``ps`` for that similarity."""
    a, b = similarity
    theirs = n - length + 1
    mine = F.least(theirs, size - length + 1)  # shingles of a window: fewer in a document shorter than the item
    need = F.greatest(F.lit(1), F.ceil(a * (mine + theirs) / F.lit(a + b)).cast("int"))

    def between(first: Column, i: Column) -> Column:
        """The starts after the hit before ``first`` and up to it, as far as the last hit needed is inside."""
        low = F.greatest(F.lit(0), F.get(ps, i + need - 1) - mine + 1, F.coalesce(F.get(ps, i - 1) + 1, F.lit(0)))
        high = F.least(first, F.greatest(F.lit(0), size - n))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    firsts = F.slice(ps, 1, F.greatest(F.lit(0), F.size(ps) - need + 1))
    return F.flatten(F.transform(firsts, between))


def _block_masks(radius: int) -> list[int]:
    """radius + 1 masks that cut 64 bits into blocks."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(cuts, cuts[1:])]


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _prefixes(sized: DataFrame, length: int, similarity: tuple[int, int]) -> DataFrame:
    """(item_id, n, h): of each item its rarest shingles, so many that no window without one of them is similar enough."""
    a, b = similarity
    hashed = sized.select("item_id", "n", F.explode(_position_hashes(F.col("words"), length)).alias("h"))
    often = hashed.groupBy("h").agg(F.count("*").alias("often"))
    ranked = hashed.join(often, "h").groupBy("item_id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("hs"))
    spare = F.size("hs") - F.ceil(a * F.size("hs") / F.lit(b)).cast("int") + 1
    return ranked.select("item_id", "n", F.explode(F.array_distinct(F.transform(F.slice("hs", F.lit(1), spare), lambda x: x["h"]))).alias("h"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    similarity: tuple[int, int] = (4, 5),
    radius: int = 20,
) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window of each pair that reaches ``similarity`` (a ratio)."""
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), _words(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    named = named.withColumn("n", F.size("words")).withColumn("shingles", _slices(F.col("words"), k))
    known = materialize(named.select("item_id", "n", "words", "shingles", _simhash(F.col("shingles")).alias("fp")), "items")

    # where an item's shingles stand, by the shingle's length: k, and that of each shorter item
    lengths = [k] + [r["n"] for r in known.where(F.col("n") < k).select("n").distinct().collect()]
    worded = docs.withColumn("words", _words(F.col("text")))
    windows = asked = None
    written = []
    for length in lengths:
        sized = known.where(F.col("n") >= k if length == k else F.col("n") == length)
        spots = sized.select("n", F.explode(_position_hashes(F.col("words"), length)).alias("h")).distinct()
        spots = _small(spots)  # made anew from the written items: as many small files as partitions would cost more
        placed = worded.select("doc_id", F.size("words").alias("size"), F.posexplode(_position_hashes(F.col("words"), length)).alias("p", "h"))
        hits = materialize(placed.join(spots, "h"), "hits")
        written.append(hits)
        sorted_hits = hits.groupBy("doc_id", "size", "n").agg(F.sort_array(F.collect_set("p")).alias("ps"))
        laid = sorted_hits.select("doc_id", "n", F.explode(_starts(F.col("ps"), F.col("size"), F.col("n"), length, similarity)).alias("start"))
        # a window over p starts at most its own length before p
        zone = F.floor(F.col("p") / F.col("n")).cast("int")
        met = hits.join(_prefixes(sized, length, similarity), ["n", "h"])
        asks = met.select("doc_id", "n", "item_id", F.explode(F.array(zone, zone - 1)).alias("zone"))
        windows, asked = (laid, asks) if windows is None else (windows.unionByName(laid), asked.unionByName(asks))
    windows = materialize(windows.distinct(), "windows")
    asked = asked.distinct()

    hit = _small(windows.select("doc_id").distinct())
    texts = worded.join(hit, "doc_id", "left_semi").select("doc_id", "words")
    near_by = F.floor(F.col("start") / WINDOWS_PER_ROW)
    per_doc = windows.groupBy("doc_id", near_by).agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    cut = texts.join(per_doc, "doc_id").select(
        "doc_id", F.explode(F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), F.slice("words", w["start"] + 1, w["n"]).alias("words")))).alias("w")
    )
    cut = cut.select("doc_id", "w.start", "w.n", _slices(F.col("w.words"), k).alias("shingles"))
    cut = materialize(cut.withColumn("fp", _simhash(F.col("shingles"))), "window-fps")

    masks = _block_masks(radius)
    blocks = lambda fp: F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("block", "value")
    # each distinct fingerprint of a zone once
    prints = cut.select("doc_id", "n", F.floor(F.col("start") / F.col("n")).cast("int").alias("zone"), "fp").distinct()
    x = prints.select("doc_id", "n", "zone", "fp", blocks(F.col("fp"))).alias("x")
    y = asked.join(known.select("item_id", "fp"), "item_id").select("doc_id", "n", "zone", "item_id", "fp", blocks(F.col("fp"))).alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    agreed = F
    for b, m in enumerate(masks):
        agreed = agreed.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(b))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("doc_id", "n", "zone", "block", "value")]
    on = same[0] & same[1] & same[2] & same[3] & same[4]
    # a pair comes out at the first block it agrees in
    near = x.join(y, on & (F.col("x.block") == agreed) & (F.bit_count(differ) <= radius)).select("x.doc_id", "x.n", "x.zone", "x.fp", "y.item_id").distinct()

    theirs = known.select("item_id", F.col("shingles").alias("theirs"))
    own = cut.select("doc_id", "start", "n", F.floor(F.col("start") / F.col("n")).cast("int").alias("zone"), "fp", "shingles")
    pairs = near.join(own, ["doc_id", "n", "zone", "fp"]).join(theirs, "item_id")
    shared = F.size(F.array_intersect(_tagged(F.col("shingles")), _tagged(F.col("theirs"))))
    weighed = pairs.select("doc_id", "item_id", "start", "n", shared.alias("both"), (F.size("shingles") + F.size("theirs")).alias("all"))
    # both / (all - both) >= a / b, in integers
    a, b = similarity
    enough = weighed.where(F.col("both") * (a + b) >= F.col("all") * a).withColumn("similarity", F.col("both") / (F.col("all") - F.col("both")))
    best = enough.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n")).alias("w"))
    best = best.select("doc_id", "item_id", F.col("w.start").cast("long").alias("start"), F.col("w.n").cast("long").alias("n_words"), (-F.col("w.s")).alias("similarity"))
    found = materialize(best, "leaks")
    discard(known, windows, cut, *written)
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document matches no item; rows without a doc_id stay."""
    leaked = fresh(docs, "leaked_id")
    found = contaminated(docs, items, doc_id, text, **options).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(_small(found), F.col(doc_id) == F.col(leaked), "left_anti")
