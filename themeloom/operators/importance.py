"""Importance of terms to topics. counts: topic_id, term, tf (long); soft: doc_id, topic_id, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def topic_counts(dtm: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """topic_id, term, tf; further keys of labels, such as a time bin, are kept. dtm may be bags, which are joined a document a row."""
    if "terms" in dtm.columns:
        each = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
        return dtm.join(labels, "doc_id").select("topic_id", *keys, each).groupBy("topic_id", "term", *keys).agg(F.sum("tf").alias("tf"))
    return dtm.join(labels, "doc_id").groupBy("topic_id", "term", *keys).agg(F.sum("tf").alias("tf"))


def soft_counts(dtm: DataFrame, soft: DataFrame, *keys: str) -> DataFrame:
    """topic_id, term, tf: counts weighted by the documents' topic weights."""
    return dtm.join(soft, "doc_id").groupBy("topic_id", "term", *keys).agg(F.sum(F.col("tf") * F.col("weight")).alias("tf"))


def ctf_idf(counts: DataFrame, normalized: bool = False, *keys: str) -> DataFrame:
    """tf * ln(1 + A / f), A the mean count of a topic, f the term's in all; normalized: tf is a share of the topic's. A count of 0 has weight 0."""
    term, topic, whole = Window.partitionBy("term", *keys), Window.partitionBy("topic_id", *keys), Window.partitionBy(*keys) if keys else None
    per_topic = counts.groupBy("topic_id", *keys).agg(F.sum("tf").alias("n"))
    mean = per_topic.groupBy(*keys).agg((F.sum("n") / F.count(F.lit(1))).alias("a")) if keys else per_topic.agg((F.sum("n") / F.count(F.lit(1))).alias("a"))
    rows = counts.withColumn("f", F.sum("tf").over(term))
    rows = rows.join(F.broadcast(mean), list(keys)) if whole is not None else rows.crossJoin(F.broadcast(mean))
    tf = F.try_divide("tf", F.sum("tf").over(topic)) if normalized else F.col("tf").cast("double")
    return rows.select(*keys, "topic_id", "term", F.coalesce(tf * F.log(1 + F.try_divide("a", "f")), F.lit(0.0)).alias("weight"))


def soft_ctf_idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(T / sum of |T| in the topic) * ln(n_docs / sum of |T| of the term). n_docs: one row, column n_docs."""
    topic, term = Window.partitionBy("topic_id"), Window.partitionBy("term")
    tf = F.col("tf") / (F.sum(F.abs("tf")).over(topic) + EPS)
    idf = F.log(F.col("n_docs") / (F.sum(F.abs("tf")).over(term) + EPS))
    return counts.crossJoin(F.broadcast(n_docs)).select("topic_id", "term", (tf * idf).alias("weight"))


def dense(counts: DataFrame, topics: DataFrame, vocab: DataFrame) -> DataFrame:
    """topic_id, term, tf with zeros: topics x vocabulary, never documents x vocabulary."""
    grid = vocab.select("term").crossJoin(F.broadcast(topics.select("topic_id").distinct()))
    return grid.join(counts, ["topic_id", "term"], "left").select("topic_id", "term", F.coalesce("tf", F.lit(0)).alias("tf"))


def npmi(full: DataFrame, mass: DataFrame, smoothing: float = 5, compat: bool = False) -> DataFrame:
    """Normalised pointwise mutual information of term and topic. full: dense counts; mass: topic_id, m (the documents' weight).

    The denominator is -log2(p(w|t) p(t)); compat: -(log2 p(w|t) - log2 p(t)). Where it is 0 (one topic of one term) the weight is 0.
    """
    s = F.lit(float(smoothing))
    per_topic, per_term = Window.partitionBy("topic_id"), Window.partitionBy("term")
    p_t = mass.select("topic_id", ((F.col("m") + s) / F.sum(F.col("m") + s).over(Window.partitionBy())).alias("p_t"))
    rows = full.withColumn("p_wt", (F.col("tf") + s) / F.sum(F.col("tf") + s).over(per_topic)).withColumn("f", F.sum("tf").over(per_term))
    totals = full.groupBy("term").agg((F.sum("tf") + s).alias("f")).agg(F.sum("f").alias("all"))
    rows = rows.crossJoin(F.broadcast(totals)).join(F.broadcast(p_t), "topic_id").withColumn("p_w", (F.col("f") + s) / F.col("all"))
    top = F.log2("p_wt") - F.log2("p_w")
    below = -(F.log2("p_wt") - F.log2("p_t")) if compat else -(F.log2("p_wt") + F.log2("p_t"))
    return rows.select("topic_id", "term", F.when(below != 0, top / below).otherwise(0.0).alias("weight"))


def fighting_words(full: DataFrame, prior: float | None = None) -> DataFrame:
    """z-scores of log-odds, topic against the rest, with a Dirichlet prior: the corpus's counts, or a number for all terms."""
    term, topic = Window.partitionBy("term"), Window.partitionBy("topic_id")
    rows = full.withColumn("f", F.sum("tf").over(term).cast("double")).withColumn("n1", F.sum("tf").over(topic).cast("double"))
    rows = rows.withColumn("a", F.col("f") if prior is None else F.lit(float(prior)))
    totals = full.groupBy("term").agg(F.sum("tf").cast("double").alias("f")).agg(F.sum("f").alias("n"), (F.sum("f") if prior is None else F.count(F.lit(1)) * F.lit(float(prior))).alias("a0"))
    rows = rows.crossJoin(F.broadcast(totals)).withColumn("y1", F.col("tf") + F.col("a")).withColumn("y2", F.col("f") - F.col("tf") + F.col("a"))
    delta = F.log(F.col("y1") / (F.col("n1") + F.col("a0") - F.col("y1"))) - F.log(F.col("y2") / (F.col("n") - F.col("n1") + F.col("a0") - F.col("y2")))
    return rows.select("topic_id", "term", (delta / F.sqrt(1 / F.col("y1") + 1 / F.col("y2"))).alias("weight"))


def bm25(dtm: DataFrame, b: float = 0.7, k1: float = 8) -> DataFrame:
    """doc_id, term, weight. The mean length is that of the documents with terms; an empty table gives no rows.

    Document frequencies are counted with partial sums and joined, so the rows of a common term never meet in one task.
    """
    doc = Window.partitionBy("doc_id")
    stats = dtm.groupBy("doc_id").agg(F.sum("tf").alias("len")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("mean"))
    df = dtm.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = dtm.withColumn("len", F.sum("tf").over(doc)).join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k = F.lit(1.0 - b) + F.lit(float(b)) * F.col("len") / F.col("mean")
    return rows.select("doc_id", "term", (idf * (F.col("tf") * F.lit(float(k1 + 1))) / (F.col("tf") + F.lit(float(k1)) * k)).alias("weight"))


def axial(coords: DataFrame, mode: str = "combined") -> DataFrame:
    """Importance from a term's coordinates (topic_id, term, x): axial: x; angular: x / norm; combined: x**2 * angular."""
    if mode not in ("axial", "angular", "combined"):
        raise ValueError(f"feature importance {mode!r} isn't axial, angular or combined")
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("term")))
    angular = F.when(size > 0, F.col("x") / size).otherwise(0.0)
    return coords.select("topic_id", "term", {"axial": F.col("x"), "angular": angular, "combined": F.col("x") * F.col("x") * angular}[mode].alias("weight"))


def combined(npmi_rows: DataFrame, cosine_rows: DataFrame) -> DataFrame:
    """sqrt of the product of (1 + npmi) / 2 and (1 + cosine) / 2."""
    rows = npmi_rows.withColumnRenamed("weight", "n").join(cosine_rows.withColumnRenamed("weight", "c"), ["topic_id", "term"])
    return rows.select("topic_id", "term", F.sqrt((1 + F.col("n")) / 2 * ((1 + F.col("c")) / 2)).alias("weight"))
