"""A corpus pipeline of five stages, each calling one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return rows of ``docs`` with all their columns as they came, whatever
their names; the last returns the shard of each document.

Defined cases: null and empty texts are clean, have no near copies but each
other, are not contaminated and take part in the mix with 0 words; a null id
stays null; rows with equal id and text share every decision; empty tables stay
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from lumenfold.llm.common import Scope, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold. Learns from the labelled rows outside the held-out fold."""
    model = toxicity.train_on_folds(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the smallest id."""
    return jaccard_join.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose words are not hit by benchmark windows for a twentieth or more."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of its source takes it, up to three times or not at all."""
    return mixing.resample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: MinHash bands and learned scores are no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scope(spark) as tables:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.release(docs)  # what the stage and those before it have written
        return STAGES[-1][1](spark, docs, sf_dir)
