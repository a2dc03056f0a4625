"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All but the last return the columns of ``documents``; the last returns counts and checksums a row of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import mixing, near_dup, pieces, toxicity
from nearfield.llm.common import small_batches, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the non-negative PU classifier scores under the threshold."""
    return toxicity.cleaned(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over five words."""
    return near_dup.deduplicated(docs, 5, 80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, encoded and decoded."""
    small_batches(spark)
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]

#: Training, minimum hashing and byte-pair merging have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
