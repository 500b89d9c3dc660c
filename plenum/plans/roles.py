"""The driver's tables in their civic roles: nations are jurisdictions, customers meetings, orders cards.

``SQL`` states the same roles as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.sources.readers import table

CARDS = """cards AS (SELECT o_orderkey AS card_id, o_custkey AS meeting_id, o_orderpriority = '1-URGENT' AS is_featured, o_orderstatus <> 'P' AS is_published,
  o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS sort_at, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority AS category FROM orders)"""
MEETINGS = "meetings AS (SELECT c_custkey AS meeting_id, c_name AS title, c_nationkey AS jurisdiction, c_mktsegment AS body FROM customer)"
ITEMS = """items AS (SELECT l_orderkey AS card_id, l_linenumber AS number, l_partkey AS part, l_suppkey AS supplier, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_returnflag AS flag, l_linestatus AS line_status, CAST(l_shipdate AS TIMESTAMP) AS shipped FROM lineitem)"""


def with_roles(select: str, *roles: str) -> str:
    """A statement over the given roles."""
    return f"WITH {', '.join(roles)}\n{select}"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("meeting_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_featured"),
        (F.col("o_orderstatus") != "P").alias("is_published"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("sort_at"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderpriority").alias("category"),
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("meeting_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("jurisdiction"), F.col("c_mktsegment").alias("body")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("card_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").cast("timestamp").alias("shipped"),
    )
