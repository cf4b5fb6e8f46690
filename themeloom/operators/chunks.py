"""Documents as windows of tokens: ragged vectors are just more rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import hash_vector, terms


def windows(docs: DataFrame, size: int = 50, step: int = 40) -> DataFrame:
    """doc_id, chunk (its first token), n, v: unit mean of the token vectors; the last windows may be short."""
    rows = docs.select("doc_id", terms("text").alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("chunk"), "w")
    part = rows.select("doc_id", "chunk", F.explode(F.slice("w", F.col("chunk") + 1, size)).alias("term"))
    vectors = part.select("term").distinct().select("term", hash_vector("term").alias("v"))
    sums = part.join(vectors, "term").groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[i]).cast("double").alias(f"x{i}") for i in range(32)))
    length = F.sqrt(sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(1, 32)), F.col("x0") * F.col("x0")))
    return sums.withColumn("l", length).select("doc_id", "chunk", "n", F.array(*(F.when(F.col("l") > 0, F.col(f"x{i}") / F.col("l")).otherwise(0.0) for i in range(32))).alias("v"))


def pool(rows: DataFrame, how: Callable[[Column], Column] = F.avg) -> DataFrame:
    """doc_id, topic_id, weight: chunk rows (doc_id, chunk, topic_id, weight) pooled by document; NaN counts as missing."""
    return rows.groupBy("doc_id", "topic_id").agg(how(F.nanvl("weight", F.lit(None))).alias("weight"))
