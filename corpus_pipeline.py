"""A training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage works on all its predecessor kept; its result is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of documents: after lines went,
``n_chars`` counts the code points of the text that is left.

Texts of other stages may be null or empty, ids may be null or repeated; what that means is stated
by the operator each stage calls.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decontam, linededup, packing, quality, simhash
from plenum.llm.common import materialize, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects; short texts are no junk, so only those without any word go for their length."""
    return quality.keep(docs, rules=quality.CORPUS_RULES)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less the lines that a document with a smaller doc_id has too."""
    kept = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.col("n_dropped") > 0
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their texts, in length buckets and token-budget batches."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No SQL: fingerprints, components and optimal buckets are beyond it; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            was, done = done, written.pop()  # the stage's result stays until the next one is written
            written += [was] if was else []
    return STAGES[-1][1](spark, docs, sf_dir)
