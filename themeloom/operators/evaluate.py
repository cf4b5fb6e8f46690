"""Measures of topics and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import cosine


def diversity(words: DataFrame) -> DataFrame:
    """Share of distinct words among the topics' top words (topic_id, term)."""
    return words.agg((F.countDistinct("term") / F.count(F.lit(1))).alias("diversity"))


def coherence(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """topic_id, coherence: mean cosine of the pairs of a topic's words."""
    rows = words.join(vectors, "term")
    a, b = rows.select("topic_id", F.col("term").alias("s"), F.col("v").alias("x")), rows.select("topic_id", F.col("term").alias("t"), F.col("v").alias("y"))
    return a.join(b, "topic_id").where("s < t").groupBy("topic_id").agg(F.avg(cosine("x", "y")).alias("coherence"))


def agreement(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Fowlkes-Mallows index, homogeneity and completeness, all from the contingency table."""
    cell = rows.groupBy(F.col(truth).alias("a"), F.col(found).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra, rb, total = cell.groupBy("a").agg(F.sum("n").alias("na")), cell.groupBy("b").agg(F.sum("n").alias("nb")), cell.agg(F.sum("n").alias("t"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda n, of: -F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col(of)))
    joint = cell.join(ra, "a").join(rb, "b").crossJoin(total).agg(pairs("n").alias("tp"), entropy("n", "nb").alias("hab"), entropy("n", "na").alias("hba"))
    one, two = (x.crossJoin(total).agg(pairs(c).alias(f"p{c}"), entropy(c, "t").alias(f"h{c}")) for x, c in ((ra, "na"), (rb, "nb")))
    share = lambda top, below: F.when(F.col(below) > 0, 1 - F.col(top) / F.col(below)).otherwise(1.0)
    return joint.crossJoin(one).crossJoin(two).select((F.col("tp") / F.sqrt(F.col("pna") * F.col("pnb"))).alias("fmi"), share("hab", "hna").alias("homogeneity"), share("hba", "hnb").alias("completeness"))
