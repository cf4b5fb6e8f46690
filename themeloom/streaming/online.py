"""Online fitting: micro-batches of a stream update topics kept as versioned tables; event-time windows and sessions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators import packed, text
from themeloom.operators.factor import TINY, gram, multiply, start, times
from themeloom.sources.store import settle


def online_step(h: DataFrame | None, batch: DataFrame, k: int, decay: float = 0.7, inner: int = 10) -> DataFrame:
    """H (term, h0 ..) after a batch of cells (doc_id, term, x).

    New terms join the vocabulary with hashed starts; W of the batch is solved under H, then H takes one multiplicative step
    on the batch, mixed with what it was. A term that the batch lacks keeps its row; an empty batch changes nothing.
    """
    terms = batch.select("term").distinct()
    fresh = start(terms if h is None else terms.join(h, "term", "left_anti"), "term", k, "h")
    h = settle(fresh if h is None else h.unionByName(fresh))
    if (cells := packed.of(settle(packed.pack(batch)), k, start, multiply, h)) is not None:
        for _ in range(inner):
            cells.step(cells.h, cells.h.T @ cells.h)
        n, ww, _ = cells.sums()
        moved = np.where(cells.seen[:, None], cells.h * decay + multiply(cells.h, n, ww) * (1 - decay), cells.h)
        return settle(cells.terms(moved))
    w = start(batch.select("doc_id").distinct(), "doc_id", k, "w")
    cells = settle(batch.join(h, "term"))
    hh = gram(h, "h", k)
    for _ in range(inner):
        sums = cells.join(w, "doc_id").groupBy("doc_id").agg(*(F.sum(F.col("x") * F.col(f"h{i}")).alias(f"n{i}") for i in range(k)), *(F.first(f"w{i}").alias(f"w{i}") for i in range(k)))
        w = settle(sums.select("doc_id", *((F.col(f"w{i}") * F.col(f"n{i}") / F.greatest(times("w", hh, i), F.lit(TINY))).alias(f"w{i}") for i in range(k))))
    ww = gram(w, "w", k)
    tops = cells.join(w, "doc_id").groupBy("term").agg(*(F.sum(F.col("x") * F.col(f"w{i}")).alias(f"n{i}") for i in range(k)))
    moved = h.join(tops, "term", "left")
    step = [F.col(f"h{i}") * F.col(f"n{i}") / F.greatest(times("h", ww, i), F.lit(TINY)) for i in range(k)]
    return settle(moved.select("term", *(F.when(F.col("n0").isNull(), F.col(f"h{i}")).otherwise(F.col(f"h{i}") * decay + s * (1 - decay)).alias(f"h{i}") for i, s in enumerate(step))))


def fit_stream(stream: DataFrame, path: str, k: int, **knobs):
    """A started query that keeps H at path/batch=<id>: a batch that runs again writes the same folder anew.

    stream: doc_id, text. A failing batch stops the query, and restarting it resumes from the last version.
    """

    def update(docs: DataFrame, batch: int) -> None:
        spark = docs.sparkSession
        cells = settle(text.doc_terms(text.tokens(docs)).withColumnRenamed("tf", "x").withColumn("x", F.col("x").cast("double")))
        before = latest(spark, path, batch, k)
        if cells.isEmpty() and before is None:
            return
        online_step(before, cells, k, **knobs).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, before: int, k: int) -> DataFrame | None:
    """The last H written before that batch."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(jpath) if s.getPath().getName().startswith("batch=")]
    found = [b for b in found if b < before and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/batch={max(found)}").select("term", *(f"h{i}" for i in range(k))) if found else None


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total by event-time window; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n of a user's events no further than the gap apart."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")
