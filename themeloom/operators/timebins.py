"""Time bins and everything by bin: the bin is one more grouping column, so no pass over the data is made a bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators import importance


def bin_equal(rows: DataFrame, micros: str, bins: int, key: str = "doc_id") -> DataFrame:
    """key, bin: equal bins from the least to the greatest time, the last edge one microsecond beyond it; lower edges belong to a bin."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    box = rows.agg(F.min(micros).alias("lo"), (F.max(micros) + 1).alias("hi"))
    at = F.floor((F.col(micros) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    return rows.crossJoin(F.broadcast(box)).select(key, F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))


def bin_edges(rows: DataFrame, micros: str, edges: Sequence[int], key: str = "doc_id") -> DataFrame:
    """key, bin between explicit edges, [edge, next edge). A time outside them is an error when it is met."""
    if list(edges) != sorted(set(edges)) or len(edges) < 2:
        raise ValueError("edges must rise, and be two or more")
    outside = (F.col(micros) < edges[0]) | (F.col(micros) >= edges[-1])
    at = sum((F.col(micros) >= e).cast("int") for e in edges) - 1
    return rows.select(key, F.when(outside, F.raise_error(F.lit("a time lies outside the bins' edges")).cast("int")).otherwise(at).alias("bin"))


def slices(edges: DataFrame) -> DataFrame:
    """bin, start, end from an edge table (edge)."""
    w = Window.orderBy("edge")
    return edges.select((F.row_number().over(w) - 1).alias("bin"), F.col("edge").alias("start"), F.lead("edge").over(w).alias("end")).where("end is not null")


def importance_over_time(dtm: DataFrame, labels: DataFrame, bins: DataFrame) -> DataFrame:
    """bin, topic_id, term, weight: c-TF-IDF of each bin's documents under global labels."""
    counts = importance.topic_counts(dtm, labels.join(bins, "doc_id"), "bin")
    return importance.ctf_idf(counts, False, "bin")


def soft_importance_over_time(dtm: DataFrame, soft: DataFrame, bins: DataFrame) -> DataFrame:
    """The same with soft topic weights: soft c-TF-IDF by bin."""
    counts = importance.soft_counts(dtm, soft.join(bins, "doc_id"), "bin")
    n_docs = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n_docs"))
    tf = F.col("tf") / (F.sum(F.abs("tf")).over(Window.partitionBy("bin", "topic_id")) + importance.EPS)
    idf = F.log(F.col("n_docs") / (F.sum(F.abs("tf")).over(Window.partitionBy("bin", "term")) + importance.EPS))
    return counts.join(F.broadcast(n_docs), "bin").select("bin", "topic_id", "term", (tf * idf).alias("weight"))


def share_over_time(labels: DataFrame, bins: DataFrame) -> DataFrame:
    """bin, topic_id, importance: the topic's share of the bin's documents."""
    n = labels.join(bins, "doc_id").groupBy("bin", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("bin", "topic_id", (F.col("n") / F.sum("n").over(Window.partitionBy("bin"))).alias("importance"))


def topics_over_time(weights: DataFrame, k: int = 5) -> DataFrame:
    """bin, topic_id, words: the k top terms with a weight other than 0; "Topic not present." where there are none."""
    ranked = weights.where("weight <> 0 and not isnan(weight)").withColumn("rank", F.row_number().over(Window.partitionBy("bin", "topic_id").orderBy(F.desc(F.round("weight", 6)), "term"))).where(F.col("rank") <= k)
    words = ranked.groupBy("bin", "topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("words"))
    every = weights.select("bin").distinct().crossJoin(F.broadcast(weights.select("topic_id").distinct()))
    return every.join(words, ["bin", "topic_id"], "left").select("bin", "topic_id", F.coalesce("words", F.lit("Topic not present.")).alias("words"))
