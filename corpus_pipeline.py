"""Documents to a training mixture: quality, near-dedup, decontamination, secrets, mixing.

Each stage takes all rows its predecessor kept. Every stage but the last returns the columns of
`documents`; the last adds the block, slot and position of the mixture. Empty tables stay empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein import ship
from skein.llm import decontaminate, golay_dedup, mixing, quality, secrets
from skein.llm._common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model learns from labelled rows of the stage's own input. Null texts are scored as empty."""
    ship(spark)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, of its repeated rows one.

    Null texts count as empty; rows without a doc_id stay.
    """
    ship(spark)
    return golay_dedup.first_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go; null texts leak nothing."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced within the text; every document stays, null texts as they are."""
    ship(spark)
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mixture of sources, repeated rows each its own; a null source counts as ''."""
    ship(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: The model, the fingerprints and the index can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
