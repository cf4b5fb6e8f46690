"""Tables to read, and the relations that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions import hash_vector
from themeloom.operators import bags, importance, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def read_corpus(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """doc_id, text from Parquet or JSON with those columns, or from text files: a line a document, keyed by its hash and content."""
    if format == "text":
        return spark.read.text(path).select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("text"))
    if format not in ("parquet", "json", "orc", "csv"):
        raise ValueError(f"format {format!r} isn't parquet, json, orc, csv or text")
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    return reader.format(format).load(path)


def language_topics(docs: DataFrame) -> DataFrame:
    """doc_id, topic_id: languages in order, from 0."""
    return text.factorize(docs, "doc_id", "lang")


def dtm(docs: DataFrame, min_df: int = 10) -> DataFrame:
    """doc_id, term, tf, read from bags that are counted once, however often a plan reads them."""
    return bags.cells(bags.bags(docs, min_df))


def topic_terms(docs: DataFrame) -> DataFrame:
    return importance.topic_counts(dtm(docs), language_topics(docs))


def soft_topics(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, topic_id, weight: shares drawn by a hash, a stand-in for a model's output."""
    topic = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = docs.select("doc_id", topic.alias("topic_id"))
    first = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("topic_id").cast("string"))), 1, 1)
    rows = rows.withColumn("w", F.instr(F.lit("0123456789abcdef"), first).cast("double"))
    return rows.select("doc_id", "topic_id", (F.col("w") / F.sum("w").over(Window.partitionBy("doc_id"))).alias("weight"))


def term_vectors(vocab: DataFrame) -> DataFrame:
    return vocab.select("term", hash_vector("term").alias("v"))


def document_vectors(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, v: sums of the terms' vectors times their counts, whole numbers."""
    rows = counts.join(vectors, "term")
    sums = [F.sum(F.col("tf") * F.col("v")[i]).alias(f"x{i}") for i in range(32)]
    return rows.groupBy("doc_id").agg(*sums).select("doc_id", F.array(*(f"x{i}" for i in range(32))).alias("v"))
