"""Corpus pipeline: from raw documents to mixed, deduplicated token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.bpe import bpe_round_trip
from flowloom.llm.common import workspace, written
from flowloom.llm.cotraining import fit, with_quality
from flowloom.llm.exact_dedup import deduplicated
from flowloom.llm.mixing import mixed
from flowloom.llm.ngram_join import one_per_component

# The stages fit models and sample: SQL states none of the rows; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; its labels come from the table beside the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = with_quality(docs, fit(docs, labels), name="__quality")
    return scored.where("__quality.keep").select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return one_per_component(docs, n=5, num=80, den=100)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with the digests of its ids and of the text they decode to."""
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram join", near_stage),
          ("source mix", mix_stage), ("byte-pair encoding", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again as the next one's input."""
    folder = workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
