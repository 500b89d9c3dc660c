"""What the training-text operators share: tables, materialised steps and small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A run of what separates words, and the same characters one by one.
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary one; on a cluster that is an error, as no folder is known to be shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="plenum-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders that ``materialize`` wrote inside each open ``scratch``.
_scratches: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, and survives lost executors.

    What a returned frame still reads stays there, like a checkpoint's files; ``discard`` and ``scratch`` delete the rest.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``materialize`` returned and nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes on leaving what was materialised inside, less what is taken out of the list that it gives."""
    _scratches.append(own := [])
    try:
        yield own
    finally:
        _scratches.remove(own)
        _delete(spark, own)


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, and only where the result is needed."""
    return F.transform(F.array(value), use)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def name_of(column: str) -> Column:
    """The column of exactly that name, which may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices that each hold no more than ``most`` bytes of text, or values of a list, or one row."""
    for batch in batches:
        values = batch.column(column)
        lengths = pc.list_value_length(values) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_in_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any names, dots and backquotes among them."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batch.rename_columns(names) for batch in batches):
            yield out.rename_columns([f"c{i}" for i in range(out.num_columns)])

    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, plain).toDF(*schema.names)
