"""From raw documents to token sequences: the stages of a training-data pipeline, each a table of its own.

Every stage but the last returns the columns of ``documents``; all of them see whole texts and all rows that their
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph import durable
from loomgraph.llm import decontaminate, near_dedup, quality_pu, secret_scan
from loomgraph.llm.frames import table
from loomgraph.llm.packing import pack
from loomgraph.llm.queries import public_vocabulary

#: SQL cannot express these stages; tests hold the pipeline against a plain one.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject."""
    labels = table(spark, sf_dir, "labels")
    return quality_pu.good(docs, quality_pu.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; of repeated rows, one."""
    return near_dedup.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secret_scan.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, **public_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

