"""Names, descriptions and summaries of topics, with a text generator that callers bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import clean
from themeloom.operators import ranking


def prompts(weights: DataFrame, k: int = 10, documents: DataFrame | None = None) -> DataFrame:
    """topic_id, prompt: a topic's top words, and perhaps its representative documents (topic_id, rank, document)."""
    best = ranking.top(weights, ["topic_id"], k=k)
    out = best.groupBy("topic_id").agg(F.concat(F.lit("Name this topic. Its keywords are: "), ranking.joined(best, ["topic_id"], F.col("term"))).alias("prompt"))
    if documents is None:
        return out
    told = documents.groupBy("topic_id").agg(ranking.joined(documents, ["topic_id"], clean("document"), "\n").alias("told"))
    return out.join(told, "topic_id", "left").select("topic_id", F.concat("prompt", F.coalesce(F.concat(F.lit("\nDocuments:\n"), "told"), F.lit(""))).alias("prompt"))


def generate(rows: DataFrame, generator: Callable[[list[str]], list[str]], column: str = "prompt", to: str = "answer") -> DataFrame:
    """rows with the generator's answers; it gets batches of prompts on the executors, where a model or a service client is made."""

    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(generator(part.tolist()), dtype=object)

    return rows.withColumn(to, F.pandas_udf(work, "string")(column))


def analyze(weights: DataFrame, generator: Callable[[list[str]], list[str]] | None = None, k: int = 2) -> DataFrame:
    """topic_id, name. Without a generator a name is the topic's k top words; the outlier topic is "Outliers"."""
    if generator is None:
        best = ranking.top(weights, ["topic_id"], k=k)
        word = F.concat(F.upper(F.substring("term", 1, 1)), F.expr("substring(term, 2)"))
        named = best.groupBy("topic_id").agg(ranking.joined(best, ["topic_id"], word, " and ").alias("name"))
    else:
        named = generate(prompts(weights), generator, to="name").select("topic_id", "name")
    return named.select("topic_id", F.when(F.col("topic_id") == -1, F.lit("Outliers")).otherwise(F.col("name")).alias("name"))


def signed_names(weights: DataFrame, k: int = 2) -> DataFrame:
    """topic_id, name of topics with a negative side: positive words, a slash, negative words."""
    high, low = analyze(weights, k=k), analyze(weights.withColumn("weight", -F.col("weight")), k=k)
    return high.join(low.withColumnRenamed("name", "low"), "topic_id").select("topic_id", F.concat_ws("/", "name", "low").alias("name"))
