"""A corpus made ready for training: STAGES, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm.bpe import encode_documents
from themeloom.llm.common import Scratch
from themeloom.llm.exact import drop_exact
from themeloom.llm.minhash import drop_near
from themeloom.llm.mixing import mix_sources
from themeloom.llm.quality import drop_rejected, fit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on the labels of sf_dir, rejects."""
    return drop_rejected(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of what is left of them, in shuffled shards."""
    return mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return encode_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("byte-level BPE", encode)]

#: SQL can't express the classifier, MinHash or BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
            scratch.drop(before)
    return docs
