"""The corpus pipeline: stages over the documents table, each written as Parquet and reread by the next.

Toxic documents go; of equal texts one stays; of each group of near-duplicates one stays; the rest are mixed to source weights
(documents may drop out or repeat there); the mix is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modeflow.llm.common import held_out, prepare, stored, table
from modeflow.llm.exact import exact_dedup
from modeflow.llm.minhash import near_dedup
from modeflow.llm.mixing import mixed_rows
from modeflow.llm.packing import pack
from modeflow.llm.toxicity import filter_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.3; learned from labelled documents whose crc32(doc_id) mod 4 is not 2."""
    prepare(spark)
    return filter_toxic(docs, table(spark, sf_dir, "labels"), ~held_out(4, 2))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each distinct text."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8."""
    prepare(spark)
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to source weights 1, 2, 3; a document appears as often as the mix takes it."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    prepare(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the scores nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
