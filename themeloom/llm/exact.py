"""Exact duplicates by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import Scratch, small

FIRST_DIGIT = 512
GROWTH = 4


def radix_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: int = FIRST_DIGIT, growth: int = GROWTH, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Rows of docs as struct `row`, with `keep_id` and `n_copies` of its group of equal texts.

    Round t splits every group by its next digit, a run of bytes (first, then growth times longer each round). A group of
    one leaves at once; one whose texts ended in the digit is a group of equal texts. Only counts by digit are
    aggregated, so a text repeated any number of times is combined before the shuffle; equality is that of the bytes.
    Most rows are alone after the first digit: a hash of the digits that have company, broadcast if it is small, lets
    them go without a shuffle of their text (a hash shared by chance only sends a row on to the exact comparison).

    null text: equals nothing, each such row is its own group. Empty text: a text like any other. null doc_id: sorts after
    all others; keep_id is null only if all ids of the group are. Repeated rows count as copies. Ties have no effect:
    keep_id is the least id. An empty table gives no rows; other columns ride inside `row`, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).cast("string").cast("binary").alias("rest"), F.lit(0).cast("long").alias("gid"))
    lone = lambda df: df.select("row", F.col(f"row.{doc_id}").alias("keep_id"), F.lit(1).cast("long").alias("n_copies"))
    digit = lambda width: F.substring("rest", 1, width)

    def counted(df: DataFrame, width: int) -> DataFrame:
        """gid, digit of the groups that have company, with what becomes of each."""
        keyed = df.where("rest is not null").select("gid", digit(width).alias("digit"), F.col(f"row.{doc_id}").alias("id"))
        groups = keyed.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("keep_id")).where("n_copies > 1")
        return scratch.write(groups.withColumns({"next": F.monotonically_increasing_id(), "ended": F.length("digit") < width}))

    width = first
    groups = counted(base, width)
    n = groups.count()
    hashes = small(groups.select(F.xxhash64("digit").alias("h")).distinct(), n, 16, broadcast_bytes)
    hashed = base.withColumn("h", F.xxhash64(digit(width)))
    hashed = hashed.withColumn("h", F.when(F.col("rest").isNotNull(), F.col("h")))
    out = lone(hashed.join(hashes, "h", "left_anti"))
    cur = hashed.join(hashes, "h", "left_semi").drop("h")
    while n:
        told = cur.withColumn("digit", digit(width)).join(groups, ["gid", "digit"], "left")
        told = scratch.write(told.select("row", F.expr(f"substring(rest, {width + 1})").alias("rest"), "n_copies", "keep_id", "next", "ended"))
        out = out.union(lone(told.where("ended is null"))).union(told.where("ended").select("row", "keep_id", "n_copies"))
        cur = told.where("not ended").select("row", "rest", F.col("next").alias("gid"))
        if width > first:
            scratch.drop(groups)  # the first one is still read for its hashes
        width *= growth
        groups = counted(cur, width)
        n = groups.count()
        if not n:
            out = out.union(lone(cur))
    return out


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **knobs) -> DataFrame:
    """doc_id, keep_id (least id of the same text), n_copies, kept. See radix_groups for edge cases."""
    out = radix_groups(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **knobs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "n_copies", F.col("row.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **knobs) -> DataFrame:
    """docs with one row of each group of equal texts, that of the least doc_id. Rows of a null text all stay."""
    out = radix_groups(docs, text, doc_id, **knobs)
    lone = out.where("n_copies = 1").select("row.*")
    # The group's text is its key here; only winners come this far, and rows repeated with their id meet again.
    best = out.where((F.col("n_copies") > 1) & F.col(f"row.{doc_id}").eqNullSafe(F.col("keep_id")))
    best = best.select("row.*").dropDuplicates([doc_id, text])
    return lone.union(best)
