"""Quality by nearest-neighbour voting over latent-semantic vectors of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import BLOCK, chunks, mix, ready, runs, spans_hash, utf8

SAMPLE, DIMS, FEATURES, NEIGHBOURS, SIZE = 4000, 64, 4096, 15, 1 << 18
#: A document stays if its neighbours' share of good is at least GOOD and that of toxic, the rarer label, below TOXIC.
GOOD, TOXIC = 0.5, 0.35
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(33)]] = 0
_KIND[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SMALL, _CAPITAL = np.zeros(256, np.int32), np.zeros(256, np.int32)
_SMALL[97:123] = _CAPITAL[65:91] = 1
_CAPS, _AGAIN = 101, 301
#: Cosines that differ by less are equal.
_TIE = 1e-5


def features(data: np.ndarray, offsets: np.ndarray, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of each feature of each row; with index, features are index[f] and those of -1 are left out.

    Features are hashed lower-case words and runs of marks, and, in eighths, the shares of shouted words and of tokens that repeat one of
    the two before.
    """
    starts, ends = runs(_KIND[data], offsets)
    keys = spans_hash(_LOWER[data], starts, ends)
    n_rows = len(offsets) - 1
    row = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(row, minlength=n_rows)
    word = _KIND[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    if len(starts):
        edges = np.stack([starts, ends], 1).ravel()
        low, high = (np.add.reduceat(np.append(t[data], 0), edges)[::2] for t in (_SMALL, _CAPITAL))
        shout = word & (low == 0) & (high > 1)
    else:
        shout = word
    again = np.zeros(len(keys), bool)
    for lag in (1, 2):
        again[lag:] |= (keys[lag:] == keys[:-lag]) & (row[lag:] == row[:-lag])
    some = np.flatnonzero(n)
    shares = [(base + np.minimum(8, 8 * np.bincount(row[flag], minlength=n_rows)[some] // n[some])) for base, flag in ((_CAPS, shout), (_AGAIN, again))]
    ids = np.concatenate([(mix(keys) % np.uint64(SIZE - 1024)).astype(np.int64) + 1024, *shares])
    row = np.concatenate([row, some, some])
    if index is not None:
        ids = index[ids]
        row, ids = row[ids >= 0], ids[ids >= 0]
    both, count = np.unique(row * SIZE + ids, return_counts=True)
    return both // SIZE, both % SIZE, count


@dataclass
class Model:
    index: np.ndarray  # feature -> its place among those kept, or -1
    project: np.ndarray  # kept features x dims, weights included
    vectors: np.ndarray  # labelled documents x dims, unit rows
    good: np.ndarray
    toxic: np.ndarray
    prior: tuple[float, float]

    def embed(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, ids, count = features(data, offsets, self.index)
        out = np.zeros((len(offsets) - 1, self.project.shape[1]), np.float32)
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = np.add.reduceat(self.project[ids] * np.log1p(count).astype(np.float32)[:, None], first, axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 1e-6)

    def vote(self, vectors: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Shares of good and of toxic among the k labelled documents of greatest cosine, and those as near as the last of them, weighted by it."""
        good, toxic = np.full(len(vectors), self.prior[0]), np.full(len(vectors), self.prior[1])
        k = min(k, len(self.vectors))
        n = len(self.vectors)
        labels = np.stack([self.good, self.toxic], 1).astype(np.float32) if k else None
        for i in range(0, len(vectors), block) if k else ():
            cosine = vectors[i : i + block] @ self.vectors.T
            border = np.partition(cosine, n - k, axis=1)[:, n - k, None]
            weight = np.where(cosine >= border - _TIE, np.maximum(cosine, 0), 0)
            total = weight.sum(1)
            some = total > 1e-6
            share = (weight @ labels)[some] / total[some, None]
            good[i : i + block][some], toxic[i : i + block][some] = share[:, 0], share[:, 1]
        return good, toxic


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, dims: int = DIMS, keep: int = FEATURES, seed: int = 5) -> Model:
    """Fitted on at most `sample` labelled documents, those of least hashed id; features and the projection come from them.

    Of an id labelled more than once the worst labels count; null labels, or labels without a document, don't. Rows repeated with their id count
    once, and of an id with several texts that of the least hash, so the bound holds for rows too.
    """
    ready(docs.sparkSession)
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("k")).distinct()
    marks = marks.join(ids, "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(4))
            for i, j in chunks(offsets, BLOCK):
                row, ids, count = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, count)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(4)), *lists], ["k", "h", "quality", "toxic", "ids", "counts"])

    src = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(marks), "k").select("k", F.xxhash64("t").alias("h"), "quality", "toxic", "t")
    found = src.mapInArrow(work, "k long, h long, quality int, toxic int, ids array<int>, counts array<int>")
    table = found.groupBy("k").agg(F.min(F.struct("h", "quality", "toxic", "ids", "counts")).alias("r")).select("k", "r.*").toArrow().sort_by("k")
    good, toxic = (table.column(c).to_numpy().astype(np.float64) for c in ("quality", "toxic"))
    n = len(good)
    size = np.array([len(x) for x in table.column("ids")], np.int64) if n else np.zeros(0, np.int64)
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy() if n else np.zeros(0, np.int32)
    ids, counts, row = flat("ids"), flat("counts"), np.repeat(np.arange(n), size)
    weight = np.zeros(SIZE)
    for label in (good, toxic):
        yes, no = (np.bincount(ids[label[row] == v], minlength=SIZE) + 0.5 for v in (1, 0))
        n_yes, n_no = (label == 1).sum() + 1.0, (label == 0).sum() + 1.0
        odds = np.log(yes / (n_yes - yes + 0.5)) - np.log(no / (n_no - no + 0.5))
        z = np.abs(odds) / np.sqrt(1 / yes + 1 / no)
        weight = np.maximum(weight, np.where(z > 3.5, np.abs(odds), 0))
    chosen = np.sort(np.argsort(-weight, kind="stable")[:keep])
    chosen = chosen[weight[chosen] > 0]
    index = np.full(SIZE, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    own = index[ids] >= 0
    x[row[own], index[ids[own]]] = np.log1p(counts[own])
    x *= weight[chosen].astype(np.float32)
    model = Model(index, np.zeros((len(chosen), dims), np.float32), np.zeros((0, dims), np.float32), good, toxic, (1.0, 0.0))
    if n and len(chosen):
        q = np.random.default_rng(seed).standard_normal((len(chosen), min(dims + 16, n, len(chosen)))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        basis = (q @ vt.T)[:, :dims]
        model.project = np.zeros((len(chosen), dims), np.float32)
        model.project[:, : basis.shape[1]] = basis * weight[chosen][:, None]
        z = x @ basis
        norm = np.linalg.norm(z, axis=1)
        some = norm > 1e-6
        model.vectors = np.zeros((int(some.sum()), dims), np.float32)
        model.vectors[:, : basis.shape[1]] = z[some] / norm[some][:, None]
        model.good, model.toxic = good[some], toxic[some]
    return model


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, good, toxic (neighbours' weighted shares), kept (good at least GOOD and toxic below TOXIC); one row a row of docs.

    A text without any feature that tells the classes apart, null and empty ones included, is like no labelled document: it
    gets the shares 1 and 0 and stays. Whole texts count. Of equal cosines at the border all vote, so ties
    don't depend on any order.
    Repeated rows repeat; an empty table gives no rows; other columns don't matter.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, toxic = judged(shared.value, batch.column(1), neighbours)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(toxic), pa.array((good >= GOOD) & (toxic < TOXIC))], ["doc_id", "good", "toxic", "kept"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, good double, toxic double, kept boolean")


def judged(model: Model, column: pa.Array, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    parts = [model.embed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, BLOCK)]
    return model.vote(np.concatenate(parts) if parts else np.zeros((0, model.project.shape[1]), np.float32), neighbours)


def drop_rejected(docs: DataFrame, model: Model, text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """docs without the rows that score() rejects, columns as they are."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, toxic = judged(shared.value, batch.column(place), neighbours)
            yield batch.filter(pa.array((good >= GOOD) & (toxic < TOXIC)))

    return docs.mapInArrow(work, docs.schema)
