"""The training-data pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read back as the next stage's ``docs``.  All but the last return the columns
of ``documents``:

    quality        rejected documents go
    near_dedup     one document of each group of near copies stays
    suffix_dedup   passages that repeat (``PASSAGE_BYTES`` bytes or more) are cut out of the texts
    mix            documents as often as the mix of sources takes them
    segment        sampled segmentations of every document, with their decoding checked
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import piece_sampling, quality_bands, simhash, source_mix, suffix_dedup
from storyloom.llm.common import ship_package
from storyloom.llm.queries import PIECES, vocabulary
from storyloom.session import ensure_checkpoint_dir

#: The least length of a repeated passage: 50 words of five bytes, the space included.
PASSAGE_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_bands.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return suffix_dedup.deduplicate(docs, min_bytes=PASSAGE_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return source_mix.mix(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return piece_sampling.digest(piece_sampling.sample_segmentations(docs, vocabulary(PIECES), decoded=True))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", repeated_passages), ("mix", mix), ("segment", segment)]

#: The stages hash, compress and sample; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' tables lie in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
