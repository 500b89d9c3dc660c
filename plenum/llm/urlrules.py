"""URL rules by a sort-merge range join, built from DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains.  The canonical key of a
host and path is the host's labels reversed, a zero byte, then the path.  A url asks once for each
of its host's ancestors, so that a rule fits exactly where its key is a prefix of an asked key:
where the asked key lies in the interval from the rule's key to that key followed by byte FF,
which no UTF-8 text contains.  Such intervals nest or are disjoint.

Asked keys and interval ends are sorted together within key ranges of about equal size.  A running
sum of starts and ends is the height of the stack of active rules; the rule on top of the stack is
the last one that started at that height.  A rule that reaches over a range's lower bound is
started again there: it is one of the bound's own prefixes.

The sweep holds each asked key once: neither a hot url nor the many hosts of a domain that ask for
the same key make a range large.  Its answers are joined back to the distinct (host, path) pairs that
asked, and these to the urls, by plain equi-joins that adaptive execution can split.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
gets the default verdict; repeated urls are judged alike; rules with the same host and path count
as one, block before allow; a rule with a null host or path is ignored; empty tables give empty
results; columns of the input named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import ascii_lower, discard, materialize

#: Sorted after everything that continues a key.
_LAST = bytearray([255])
#: Bytes of a key that a range bound takes over; any byte string can be a bound.
_BOUND_BYTES = 200


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("\0"), path), "UTF-8")


def _bounds(keys: DataFrame, ranges: int, sample_rows: int) -> list[bytes]:
    """Lower bounds of key ranges, from a bounded sample of distinct keys; they only spread the work."""
    drawn = keys.orderBy(F.xxhash64("key")).limit(sample_rows).select(F.substring("key", 1, _BOUND_BYTES).alias("key")).collect()
    drawn = sorted(bytes(r["key"]) for r in drawn)
    step = max(1, len(drawn) // ranges)
    return sorted({b"", *drawn[step::step]})


def judge_urls(
    df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None, sample_rows: int = 8192
) -> DataFrame:
    """``df`` with host, path, rule (``host`` + ``path`` of the longest that fits, or null) and verdict.

    rules: host string, path string, verdict string (allow or block).
    ranges: key ranges of the sweep; by default twice the session's shuffle partitions.
    """
    spark = df.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col(url))
    # explicit stages: the distinct pairs are read by the sample, the sweep and nothing else
    placed = df.drop(*[c for c in df.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url])
    placed = placed.withColumns({"host": host, "path": path})
    pairs = materialize(placed.select("host", "path").distinct(), "url-pairs")

    labels = F.reverse(F.split("host", r"\."))
    asked = pairs.select(
        "host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n")
    ).select("host", "path", _key(F.slice(labels, 1, F.col("n")), F.col("path")).alias("key"))
    known = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(_key(labels, F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    )

    keys = materialize(asked.select("key").distinct(), "url-keys")
    bounds = _bounds(keys, ranges, sample_rows)
    lower = F.array(*[F.lit(bytearray(b)) for b in bounds])
    at = lambda key: F.size(F.filter(lower, lambda b: b <= key))
    info = F.struct("rule", "verdict").alias("info")
    start, ask, end = 1, 2, 0
    first = known.select(at(F.col("key")).alias("range"), "key", F.lit(start).alias("kind"), info)
    last = known.select(at(F.concat("key", F.lit(_LAST))).alias("range"), F.concat("key", F.lit(_LAST)).alias("key"), F.lit(end).alias("kind"), info)
    bounded = spark.range(1).select(F.posexplode(lower).alias("at", "bound")).where(F.length("bound") > 1).select((F.col("at") + 1).alias("range"), "bound")
    prefixes = bounded.select("range", F.explode(F.sequence(F.lit(1), F.length("bound") - 1)).alias("n"), "bound").select("range", F.expr("substring(bound, 1, n)").alias("key"))
    again = prefixes.join(known, "key").select("range", "key", F.lit(start).alias("kind"), info)
    probes = keys.select(at(F.col("key")).alias("range"), "key", F.lit(ask).alias("kind"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("info"))

    moves = F.when(F.col("kind") == start, 1).when(F.col("kind") == end, -1).otherwise(0)
    in_order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = first.unionByName(again).unionByName(last).unionByName(probes).withColumn("height", F.sum(moves).over(in_order))
    at_height = Window.partitionBy("range", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("kind") == start, F.col("info")), ignorenulls=True).over(at_height)
    found = swept.withColumn("top", top).where((F.col("kind") == ask) & (F.col("height") > 0)).select("key", "top")
    longest = F.max(F.struct(F.length("top.rule").alias("n"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))
    met = asked.join(materialize(found, "url-answers"), "key")
    judged = materialize(met.groupBy("host", "path").agg(longest.alias("best")).select("host", "path", "best.rule", "best.verdict"), "url-judged")
    discard(pairs, keys)
    out = placed.join(judged, ["host", "path"], "left")
    added = ["host", "path", "rule", "verdict"]
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*[c for c in placed.columns if c not in added], *added)
