"""Readers: projected scans, shards read as one table, key lookups, missing columns, JSON stages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys up to which a lookup may broadcast them.
LOOKUP_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a folder, or only some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shards(spark: SparkSession, paths: dict[str, str], shard: str = "shard") -> DataFrame:
    """Tables of the same shape, one per shard, as one; columns that a shard lacks are null."""
    frames = [spark.read.parquet(p).withColumn(shard, F.lit(name)) for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones are null, others go."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def lookup(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``df`` with one of the keys; a counted small key set is broadcast."""
    distinct = keys.select(*on).distinct()
    small = distinct.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return df.join(F.broadcast(distinct) if small else distinct, list(on), "left_semi")


def json_stage(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    """The JSON files that a stage left, at the first of the paths that there is."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.schema(schema).option("multiLine", True).json(path)
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")
