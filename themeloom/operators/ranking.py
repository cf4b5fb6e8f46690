"""Top-k lists, names and tables. Every order breaks ties by id or term, so lists don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import clean


def top(rows: DataFrame, keys: list[str], score: str = "weight", tie: str = "term", k: int = 10, lowest: bool = False) -> DataFrame:
    """rows with rank 1 .. k by group; Spark limits each group before the shuffle."""
    by = F.asc(score) if lowest else F.desc(score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by, tie))).where(F.col("rank") <= k)


def joined(rows: DataFrame, keys: list[str], item: Column, sep: str = ", ") -> Column:
    """The group's items in order of rank as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]), sep)


def topic_names(weights: DataFrame, k: int = 4, overrides: DataFrame | None = None) -> DataFrame:
    """topic_id, name: the id and the k top terms, joined by underscores; overrides (topic_id, name) win."""
    best = top(weights, ["topic_id"], k=k)
    names = best.groupBy("topic_id").agg(F.concat(F.col("topic_id").cast("string"), F.lit("_"), joined(best, ["topic_id"], F.col("term"), "_")).alias("name"))
    if overrides is None:
        return names
    return names.join(F.broadcast(overrides.withColumnRenamed("name", "other")), "topic_id", "left").select("topic_id", F.coalesce("other", "name").alias("name"))


def topics_table(weights: DataFrame, k: int = 10, scores: bool = False, negative: bool = False) -> DataFrame:
    """topic_id, highest (and lowest): lists of terms, with scores of two places in brackets if asked for."""
    item = F.format_string("%s(%.2f)", "term", "weight") if scores else F.col("term")
    best = top(weights, ["topic_id"], k=k)
    out = best.groupBy("topic_id").agg(joined(best, ["topic_id"], item).alias("highest"))
    if negative:
        worst = top(weights, ["topic_id"], k=k, lowest=True)
        out = out.join(worst.groupBy("topic_id").agg(joined(worst, ["topic_id"], item).alias("lowest")), "topic_id")
    return out


def representative_documents(soft: DataFrame, docs: DataFrame, k: int = 5, negative: bool = False) -> DataFrame:
    """topic_id, side, rank, doc_id, weight, document (cleaned): the k documents of greatest, and perhaps least, weight."""
    parts = [top(soft, ["topic_id"], tie="doc_id", k=k).withColumn("side", F.lit("highest"))]
    if negative:
        parts.append(top(soft, ["topic_id"], tie="doc_id", k=k, lowest=True).withColumn("side", F.lit("lowest")))
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("topic_id", "side", "rank", "doc_id", "weight", clean("text").alias("document"))


def argmax_label(soft: DataFrame) -> DataFrame:
    """doc_id, topic_id of the greatest weight; the least id among equals."""
    return soft.groupBy("doc_id").agg(F.max_by("topic_id", F.struct(F.col("weight"), -F.col("topic_id"))).alias("topic_id"))


def share(soft: DataFrame, mode: str = "sum") -> DataFrame:
    """topic_id, share. sum: of the topics' summed weights; mean: mean weight; rows: sums of weights normalised by document."""
    rows = soft
    if mode == "rows":
        total = F.sum("weight").over(Window.partitionBy("doc_id"))
        rows = soft.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0))
    sums = rows.groupBy("topic_id").agg((F.avg("weight") if mode == "mean" else F.sum("weight")).alias("share"))
    return sums if mode == "mean" else sums.select("topic_id", F.coalesce(F.try_divide("share", F.sum("share").over(Window.partitionBy())), F.lit(0.0)).alias("share"))


def decay(soft: DataFrame) -> DataFrame:
    """rank, low, median, high: quantiles, at 2.5, 50 and 97.5 %, of the documents' normalised weights in falling order.

    Weights count at six places, so a rank has a million distinct values at most, and their counts, not the documents, are what a task holds.
    A document whose weights sum to 0 has weights of 0.
    """
    by = Window.partitionBy("doc_id")
    rows = soft.withColumn("w", F.round(F.coalesce(F.try_divide("weight", F.sum("weight").over(by)), F.lit(0.0)), 6)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("w"), "topic_id")))
    return rows.groupBy("rank").agg(*(F.percentile("w", F.lit(q)).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))))


def export_table(rows: DataFrame, order: list[str], format: str = "markdown") -> DataFrame:
    """line_no, line of a small table as csv (text in quotes), markdown or latex."""
    if format not in ("csv", "markdown", "latex"):
        raise ValueError(f"format {format!r} isn't csv, markdown or latex")
    text = {c for c, t in rows.dtypes if t == "string"}
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    if format == "csv":
        cells = [F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')) if c in text else x for c, x in zip(rows.columns, cells, strict=True)]
        heads, line = [",".join(f'"{c}"' for c in rows.columns)], F.concat_ws(",", *cells)
    elif format == "latex":
        heads, line = [" & ".join(rows.columns) + r" \\", r"\hline"], F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\"))
    else:
        heads = ["| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    top_lines = rows.sparkSession.createDataFrame(list(enumerate(heads)), "line_no int, line string")
    body = rows.select((F.row_number().over(Window.orderBy(*order)) - 1 + len(heads)).alias("line_no"), line.alias("line"))
    return top_lines.union(body)
