"""Near duplicates: minima of universal hashes, banding, signature verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import Scratch, binary, chunks, grouped, mix, runs, small, spans_hash, utf8

HASHES, BANDS, SHINGLE, SIMILAR, TILE = 128, 32, 3, 0.6, 256
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = 1
_STEPS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def coefficients(hashes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """a and b of h(x) = (a x + b mod 2**64) >> 32, strongly universal on 32-bit x."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, hashes, dtype=np.uint64), rng.integers(0, 2**64, hashes, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit keys of the shingles of k words, and their counts by row; a row of fewer words has one shingle of all."""
    starts, ends = runs(_WORD[data], offsets)
    words = spans_hash(data, starts, ends)
    first = np.searchsorted(starts, offsets[:-1])
    n = np.diff(np.append(first, len(starts)))
    total = np.zeros(len(words), np.uint64)
    after = np.repeat(first + n, n) - np.arange(len(words))  # words from here to the row's end
    for j in range(k):
        total[: len(words) - j] += np.where(after[: len(words) - j] > j, words[j:] * _STEPS[j % 64], np.uint64(0))
    keep = (after >= k) | ((np.repeat(n, n) < k) & (after == np.repeat(n, n)))
    return mix(total[keep]) >> np.uint64(32), np.where(n >= k, n - k + 1, np.minimum(n, 1))


def signatures(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, block: int = 1 << 15) -> np.ndarray:
    """Minima by row and hash function, uint32; a row of no words has a row of the largest value."""
    out = np.full((len(offsets) - 1, len(a)), 0xFFFFFFFF, np.uint32)
    for i, j in chunks(offsets, block * 6):
        keys, n = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        rows = np.flatnonzero(n)
        if not len(rows):
            continue
        first = np.zeros(len(rows), np.int64)
        np.cumsum(n[rows][:-1], out=first[1:])
        values, least = np.empty_like(keys), np.empty((len(a), len(rows)), np.uint64)
        for h in range(len(a)):
            np.multiply(keys, a[h], out=values)
            values += b[h]
            np.minimum.reduceat(values, first, out=least[h])
        out[i + rows] = (least >> np.uint64(32)).T
    return out


def signed(docs: DataFrame, text: str, doc_id: str, hashes: int, k: int) -> DataFrame:
    """doc_id and the signature's bytes; rows without a doc_id or without words are left out."""
    a, b = coefficients(hashes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sig = signatures(data, offsets, a, b, k)
            some = ~(sig == 0xFFFFFFFF).all(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), binary(sig[some])], ["doc_id", "sig"])

    src = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return src.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(text).alias("text")).mapInArrow(work, "doc_id long, sig binary")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the least node of its component), for the nodes of edges (a, b); alternating large-star and small-star.

    Large-star links a node's greater neighbours to its least; small-star its smaller ones and itself. Each pass is a
    group-by, written to the shared folder; the loop ends when a pass changes no edge.
    """
    cur = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = scratch.write(linked.where("u <> v").distinct())
        sums = [x.select(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() for x in (cur, after)]
        scratch.drop(cur, large)
        cur = after
        if sums[0] == sums[1]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joins(sigs: np.ndarray, label: np.ndarray, cut: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows that agree in `least` places or more: enough to join all groups (rows of one label are one) that such pairs join.

    Pairs are those of one row before `cut` and one from there on; cut = len(sigs): all pairs.
    """
    n, a, b = len(sigs), [], []
    label = np.unique(label, return_inverse=True)[1].reshape(-1)
    for i in range(n - 1 if cut == n else cut):
        low = i + 1 if cut == n else cut
        other = np.flatnonzero(label[low:] != label[i]) + low
        if len(other):
            other = other[(sigs[other] == sigs[i]).sum(1) >= least]
            found, first = np.unique(label[other], return_index=True)
            a.append(np.full(len(first), i))
            b.append(other[first])
            label[np.isin(label, found)] = label[i]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def agreeing(pairs: DataFrame, reps: DataFrame, hashes: int, similar: float) -> DataFrame:
    """Of pairs (a, b) those whose signatures agree in that share of the places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(utf8(batch.column(c))[0].tobytes(), np.uint32).reshape(-1, hashes) for c in (2, 3))
            keep = pa.array((x == y).sum(1) >= similar * hashes)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], ["a", "b"])

    rows = pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def linked(reps: DataFrame, scratch: Scratch, hashes: int, bands: int, similar: float) -> tuple[DataFrame, DataFrame]:
    """Verified edges (a, b), and pairs (a, b) that have the same components: those that all alike pairs of documents sharing a band have.

    First every member of a bucket is compared with the bucket's least id: a join, so no task has a bucket, and a group of thousands of near copies
    costs one comparison a member. Buckets that this leaves in several components are then compared whole, in tiles of two
    blocks of TILE members at most, where only members of different components are compared.
    """
    width = hashes * 4 // bands
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    rows = reps.select("doc_id", F.explode(keys).alias("key"))
    buckets = scratch.write(rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    members = scratch.write(rows.join(small(buckets, buckets.count(), 32), "key"))
    star = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = scratch.write(agreeing(star, reps, hashes, similar))
    found = scratch.write(components(first, scratch))
    known = members.where("rows > 2").join(small(found, found.count(), 24), F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    known = scratch.write(known)
    left = scratch.write(known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("blocks")).where("low <> high"))
    scratch.drop(buckets, members)
    pairs = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not (n := left.count()):
        return first, pairs
    tiles = known.join(small(left.select("key", "blocks"), n, 24), "key").withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "block", "doc_id", "root").join(reps, "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            tile, block, ids, root = (t.column(i).to_numpy() for i in range(4))
            sigs = np.frombuffer(utf8(t.column(4))[0].tobytes(), np.uint32).reshape(-1, hashes)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            ends = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                x, y = joins(sigs[i:j], root[i:j], int(np.searchsorted(block[i:j], block[i], "right")), similar * hashes)
                a.append(ids[i + x])
                b.append(ids[i + y])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    tiles = tiles.select("tile", "block", "doc_id", "root", "sig").repartition("tile").sortWithinPartitions("tile", "block", "doc_id")
    second = scratch.write(tiles.mapInArrow(work, "a long, b long").distinct())
    return first.union(second), pairs.union(second)


def near_edges(reps: DataFrame, scratch: Scratch, hashes: int, bands: int, similar: float, rounds: int = 2) -> DataFrame:
    """Verified edges (a, b) that join the documents that all verified pairs of documents sharing a band would join. rounds has no effect any more."""
    return linked(reps, scratch, hashes, bands, similar)[0]


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hashes: int = HASHES, bands: int = BANDS, shingle: int = SHINGLE, similar: float = SIMILAR) -> tuple[DataFrame, Scratch]:
    """doc_id, group_id, links of the documents in groups of two rows or more; group_id is the group's least doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sigs = scratch.write(signed(docs, text, doc_id, hashes, shingle))
    same = scratch.write(sigs.groupBy(F.md5("sig").alias("d")).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    n = same.count()
    reps = scratch.write(sigs.withColumn("d", F.md5("sig")).join(same.select("d", F.col("rep").alias("doc_id")), ["d", "doc_id"]).select("doc_id", "sig").dropDuplicates(["doc_id"]))
    edges, pairs = linked(reps, scratch, hashes, bands, similar)
    roots = components(pairs, scratch)
    copies = sigs.select("doc_id", F.md5("sig").alias("d")).join(small(same.where("n > 1"), n, 60), "d").select("doc_id", "rep").distinct()
    # Members: copies of a signature, then the representatives' components; an id with two texts joins their groups.
    members = copies.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("root", "rep").alias("group_id"))
    members = members.union(roots.join(copies, F.col("node") == F.col("doc_id"), "left_anti").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id")))
    copies = copies.where("doc_id <> rep")
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).union(copies.select(F.explode(F.array("doc_id", "rep")).alias("doc_id")))
    rows = members.select("doc_id", "group_id", F.lit(0).alias("link")).union(ends.select("doc_id", F.lit(None).cast("long"), F.lit(1)))
    return scratch.write(rows.groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.sum("link").alias("links"))), scratch


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **knobs) -> DataFrame:
    """doc_id, group_id (least id of its group of near copies), links, kept; one row a row of docs.

    links counts the verified links that hold the document in its group: at most one a member to a bucket's least id, those that join what is still
    apart, and one from each copy of a signature to the least id of it. A document outside groups has 0.
    Texts count as lower-case words of letters and digits. null, empty or wordless text and null doc_id: a group of its own, kept
    (group_id is its doc_id). A text of fewer words than a shingle is one shingle. Repeated rows of an id are one
    document. Ties: the least id stays. An empty table gives no rows; other columns don't matter.
    """
    groups, _ = near_groups(docs, text, doc_id, **knobs)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    out = ids.join(groups, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))


def drop_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **knobs) -> DataFrame:
    """docs with one document of each group of near copies, that of the least doc_id; all columns as they are."""
    groups, scratch = near_groups(docs, text, doc_id, **knobs)
    n = groups.count()
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).cast("long").alias("k"))
    alone = flat.join(small(groups.select(F.col("doc_id").alias("k")), n, 16), "k", "left_anti").select("row.*")
    first = flat.join(small(groups.where("doc_id = group_id").select(F.col("doc_id").alias("k")), n, 16), "k", "left_semi")
    return alone.union(first.groupBy("k").agg(F.min_by("row", F.xxhash64(F.col("row").cast("string"))).alias("row")).select("row.*"))
