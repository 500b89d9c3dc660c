"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two aggregations to a minimum and two equi-joins, so a node with very many
neighbours is summed map-side and split by adaptive execution.  Rounds are written to the shared
folder; nothing but a row count and a checksum reaches the driver.  Edges are read in as many
partitions as their count fills, so that a round over few edges is one task without exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import discard, materialize

#: Edges that a partition holds, 16 bytes each: a graph of no more is read as one partition.
PARTITION_EDGES = 200_000


def _print(edges: DataFrame) -> tuple:
    """Row count and checksum: equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(from_a: DataFrame, above: bool) -> DataFrame:
    """Links each neighbour (above: only the greater ones) of every node to the least of the node and its neighbours."""
    least = from_a.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = from_a.join(least, "a")
    out = met.where(F.col("b") > F.col("a")) if above else met
    linked = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not above:
        linked = linked.union(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), where root is the least node reachable.

    Edges may repeat and point either way; self loops are ignored; without edges the result is empty.
    """
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(turned, "edges")
    seen = _print(now)
    while seen[0]:
        parts = max(1, -(-seen[0] // PARTITION_EDGES))
        now = now.coalesce(parts)
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        large = materialize(_star(both, above=True), "edges").coalesce(parts)
        small = materialize(_star(large, above=False), "edges")
        was, seen = seen, _print(small)
        discard(now, large)
        now = small
        if seen == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
