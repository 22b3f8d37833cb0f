"""A corpus pipeline: each stage takes what its predecessor kept and calls one operator of siftline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import copies, decontaminate, mixing, tokenfile, toxicity
from siftline.llm.common import Stash, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models, learnt from labels that aren't held out, score below the threshold."""
    return toxicity.drop(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity 0.8), the document with the smallest id."""
    return copies.dedupe(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files; what the files hold, by document."""
    return tokenfile.encode_and_index(spark, docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("token ids", token_files)]

#: Scores, fingerprints and tokenizers have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stash = Stash(spark, "pipeline")
    for _, stage in STAGES:
        docs = stash.keep(stage(spark, docs, sf_dir))
    return docs
