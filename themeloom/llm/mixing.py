"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import ready, small

log = logging.getLogger(__name__)
SHARDS, BLOCK, TEMPERATURE, SEED = 32, 32, 0.5, 20240
BUCKET = 20_000
#: Documents of a shard at most, about, from SHARDS shards on; blocks that the tree deals at most (the generator takes 10 ** 9).
SHARD_ROWS, MOST_BLOCKS = 1 << 16, 1 << 29
#: Sources that together hold less than this share of all documents are drawn whole and don't bound the others.
RARE = 0.1


def quotas(counts: Mapping[str, int], weights: Mapping[str, float] | None, temperature: float, total: int | None = None) -> dict[str, int]:
    """Documents to draw of each source, none twice.

    With weights: as many in all as their exact proportions allow. Sources absent from counts or of weight 0 draw nothing.
    Without: a source weighs count ** temperature, and a small one can't shrink the others: each draws rate * weight, or all it has
    if that is less. The rate is such that total documents (or all, if fewer) are drawn, or, without a total, the least at which
    the sources drawn whole hold RARE of all documents or more. The shares are rounded by largest remainders, ties by name.
    """
    w = {s: float(n) ** temperature if weights is None else float(weights.get(s, 0)) for s, n in counts.items() if n}
    w = {s: x for s, x in w.items() if x > 0}
    if not w:
        return {}
    if weights is not None:
        most = min(counts[s] / x for s, x in w.items())
    else:
        most = _rate({s: counts[s] for s in w}, w, total)
    exact = {s: min(float(counts[s]), most * x) for s, x in w.items()}
    out = {s: int(x + 1e-9) for s, x in exact.items()}
    spare = int(sum(exact.values()) + 1e-9) - sum(out.values())
    for s in sorted(w, key=lambda s: (out[s] - exact[s], s))[: max(0, spare)]:
        out[s] = min(out[s] + 1, counts[s])
    return out


def _rate(counts: Mapping[str, int], w: Mapping[str, float], total: int | None) -> float:
    """Documents a unit of weight, for sources that draw at most what they have."""
    order = sorted(counts, key=lambda s: (counts[s] / w[s], s))
    left, weight, whole = sum(counts.values()), sum(w.values()), 0
    if total is None:
        for s in order:
            whole += counts[s]
            if whole >= RARE * left:
                return counts[s] / w[s]
    for s in order:
        if whole + weight * counts[s] / w[s] >= total:
            return (total - whole) / weight
        whole, weight = whole + counts[s], weight - w[s]
    return counts[order[-1]] / w[order[-1]]


def split(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source by shard, shape (shards, sources).

    A node halves its shards; the left half's blocks are a multivariate-hypergeometric draw of its share. Each node has its own random stream, so any subtree can be
    made alone.
    """
    out = np.zeros((shards, len(blocks)), np.int64)

    def node(lo: int, hi: int, here: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = here
            return
        mid, total = (lo + hi) // 2, int(here.sum())
        # Blocks are dealt evenly: shard i ends at total * i / shards of the whole.
        left = total * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, left, method="marginals")
        node(lo, mid, draw)
        node(mid, hi, here - draw)

    node(0, shards, np.asarray(blocks, np.int64))
    return out


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, shards: int | None = None, block: int = BLOCK, seed: int = SEED, bucket: int = BUCKET, total: int | None = None, keep: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """`row` (struct of docs' columns, or those of keep), shard, order: the rows drawn, by output shard (sort a shard by order); and how many shards there are.

    Rows of a source are ranked by a keyed hash: ranks are exact although no task sorts a whole source, since the hash's top
    bits split it in buckets whose counts are added up. Consecutive ranks form blocks; shard k takes the next
    disjoint run of blocks that the splitting tree gives it, so a source's quota is met to the row.

    Without `shards` there are SHARDS, or one for each SHARD_ROWS documents drawn if that is more; blocks grow beyond MOST_BLOCKS of them.

    null source: a source of its own. The hash is of doc_id and source, so other columns, whatever their names, change nothing; where doc_id is null it is
    of the whole row. Repeated rows: each counts and may be drawn; rows of one doc_id rank by a hash of the row, then in any order, which only equal
    rows can have. Empty table: no rows. Other columns ride inside `row`.
    """
    spark = docs.sparkSession
    ready(spark)
    tag = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("s"), c.cast("string")))
    counts = {r[0]: r[1] for r in docs.groupBy(tag(F.col(source)).alias("s")).count().collect()}
    want = quotas(counts, None if weights is None else {"n" if k is None else f"s{k}": v for k, v in weights.items()}, temperature, total)
    log.info("rows drawn by source, of rows there: %s", {s[1:] if s != "n" else None: (want.get(s, 0), n) for s, n in sorted(counts.items())})
    names = sorted(want)
    block = max(block, -(-sum(want.values()) // MOST_BLOCKS))
    shards = shards or max(SHARDS, -(-sum(want.values()) // SHARD_ROWS))
    n_blocks = np.array([-(-want[s] // block) for s in names], np.int64)
    ends = split(n_blocks, shards, seed).cumsum(0) if names else np.zeros((shards, 0), np.int64)
    bits = min(40, max(0, int(np.ceil(np.log2(max(1, max(counts.values(), default=1) / bucket))))))

    whole = F.xxhash64(*(F.col(f"`{c}`").cast("string") if "map" in t else F.col(f"`{c}`") for c, t in docs.dtypes))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), tag(F.col(source)).alias("s"), F.col(doc_id).alias("id"), whole.alias("whole"))
    hashed = rows.withColumn("key", F.shiftrightunsigned(F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), "whole", "s")).otherwise(F.xxhash64(F.lit(seed), "id", "s")), 1))
    hashed = hashed.withColumn("bucket", F.shiftright("key", 63 - bits))
    cells = hashed.groupBy("s", "bucket").count()
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("s", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    known = spark.createDataFrame([(s, i, want[s]) for i, s in enumerate(names)], "s string, source_no int, want long")
    n_cells = sum(min(1 << bits, n) for n in counts.values())
    cells = cells.join(small(known, len(names), 40), "s")
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("s", "bucket").orderBy("key", "id", "whole")))
    ranked = ranked.join(small(cells, n_cells, 60), ["s", "bucket"]).withColumn("rank", F.col("rank") + F.col("before") - 1).where("rank < want")

    @F.pandas_udf("int")
    def shard_of(source_no: pd.Series, rank: pd.Series) -> pd.Series:
        no, at = source_no.to_numpy(), rank.to_numpy() // block
        out = np.zeros(len(no), np.int32)
        for i in np.unique(no):
            out[no == i] = np.searchsorted(ends[:, i], at[no == i], "right")
        return pd.Series(out)

    return ranked.select("row", shard_of("source_no", "rank").alias("shard"), F.xxhash64(F.lit(seed + 1), "key", "rank").alias("order")), shards


def mix_plan(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", **knobs) -> DataFrame:
    """doc_id, source, shard, position (0, 1, .. in the shard after its local shuffle) of every document that mix_sources() draws with the same knobs."""
    out, _ = mixed(docs, source, doc_id, keep=[doc_id, source], **knobs)
    w = Window.partitionBy("shard").orderBy("order", "doc_id")
    return out.select(F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{source}`").alias("source"), "shard", "order").select("doc_id", "source", "shard", (F.row_number().over(w) - 1).alias("position"))


def mix_sources(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", **knobs) -> DataFrame:
    """The documents drawn, their columns as they are: partition k is shard k in its shuffled order."""
    out, shards = mixed(docs, source, doc_id, **knobs)
    return out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order").select("row.*")


__all__ = ["mix_plan", "mix_sources", "mixed", "quotas", "split"]
