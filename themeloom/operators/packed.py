"""Cells of a factorisation with a document a row: a pass sums by document within its row and by term within a task, so no pass moves cells.

Terms are numbered and their factor, terms x topics, is held by the driver and the workers up to MOST bytes; beyond that of() is None and
callers join long rows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.bags import CELLS, stretches, sums
from themeloom.sources.store import ready, settle

MOST = 256 << 20
#: Passes after which the documents' factor is written down; those since then are repeated within a pass.
KEPT = 4

Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def pack(x: DataFrame) -> DataFrame:
    """doc_id, terms, xs, p of long cells (doc_id, term, x and perhaps p, the document's weight): one exchange."""
    weight = F.first("p") if "p" in x.columns else F.lit(1.0)
    rows = x.groupBy("doc_id").agg(F.collect_list(F.struct("term", F.col("x").cast("double").alias("x"))).alias("c"), weight.alias("p"))
    return rows.select("doc_id", F.col("c.term").alias("terms"), F.col("c.x").alias("xs"), "p")


def of(x: DataFrame, k: int, start: Callable, rule: Rule, h: DataFrame | None = None) -> Packed | None:
    """x: doc_id, terms, xs, p, settled; start(rows, key, k, prefix) gives first factors, rule(w, n, gram) the documents' next; h (term, h0 ..), if given, is the terms' first factor and its terms alone count."""
    found = settle(start(x.select(F.explode("terms").alias("term")).distinct(), "term", k, "h") if h is None else h.select("term", *(f"h{i}" for i in range(k))))
    if (found.agg(F.sum(F.octet_length("term") + 8 + 8 * k)).first()[0] or 0) > MOST:
        return None
    table = found.toArrow()
    names = table.column("term").combine_chunks().cast(pa.string())
    first = np.array([table.column(f"h{i}").to_numpy() for i in range(k)], float).reshape(k, -1).T.copy()
    return Packed(_numbered(x, names, k, start), names, first, k, rule)


def _numbered(x: DataFrame, names: pa.Array, k: int, start: Callable) -> DataFrame:
    """doc_id, ids, xs, p, w0 ..; cells of other terms than names are left out, and documents without a cell."""
    ready(x.sparkSession)
    known = x.sparkSession.sparkContext.broadcast(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            terms = b.column("terms")
            found = terms.flatten().dictionary_encode()
            ids = pc.index_in(found.dictionary, value_set=known.value).fill_null(-1).to_numpy(zero_copy_only=False)[found.indices.to_numpy(zero_copy_only=False)]
            keep = ids >= 0
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))[keep]
            lens = np.bincount(doc, minlength=b.num_rows)
            ends = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
            out = [b.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(ids[keep], pa.int32())), pa.ListArray.from_arrays(ends, b.column("xs").flatten().filter(pa.array(keep))), b.column("p")]
            some = pa.array(lens > 0)
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in out], ["doc_id", "ids", "xs", "p"])

    kind = x.schema["doc_id"].dataType.simpleString()
    rows = x.select("doc_id", "terms", "xs", "p").mapInArrow(work, f"doc_id {kind}, ids array<int>, xs array<double>, p double")
    first = start(rows.select("doc_id", "ids", "xs", "p"), "doc_id", k, "w", "ids", "xs", "p")
    return settle(first.select("doc_id", "ids", "xs", "p", *(f"w{i}" for i in range(k))))


class Packed:
    """Numbered cells, the documents' factor as far as it was written, and the steps since, each the terms' factor and its inner products."""

    def __init__(self, rows: DataFrame, names: pa.Array, h: np.ndarray, k: int, rule: Rule):
        self.rows, self.names, self.h, self.k, self.rule, self.steps, self.seen = rows, names, h, k, rule, [], np.zeros(len(names), bool)

    def step(self, h: np.ndarray, gram: np.ndarray) -> None:
        """The documents' factor is updated once more, under these terms."""
        if len(self.steps) >= KEPT:
            kind = dict(self.rows.dtypes)
            self.rows = settle(self._run("keep", ", ".join(f"{c} {kind[c]}" for c in self.rows.columns)))
            for held, _ in self.steps:
                held.destroy()
            self.steps = []
        self.steps.append((self.rows.sparkSession.sparkContext.broadcast(h), gram))

    def sums(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums by term of p x times the documents' factor (terms x k), its inner products weighted by p, and the sum of p x x; seen tells terms with cells."""
        k = self.k
        parts = self._run("sums", "id int, " + ", ".join(f"n{i} double" for i in range(k)))
        got = parts.groupBy("id").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k))).toArrow()
        ids, n = got.column("id").to_numpy(), np.array([got.column(f"n{i}").to_numpy() for i in range(k)], float).reshape(k, -1).T
        out, inner = np.zeros((len(self.names), k)), np.zeros((k + 1, k))
        out[ids[ids >= 0]], inner[-1 - ids[ids < 0]] = n[ids >= 0], n[ids < 0]
        self.seen[ids[ids >= 0]] = True
        return out, inner[:k], float(inner[k, 0])

    def documents(self) -> DataFrame:
        """doc_id, w0 ..: not settled."""
        return self._run("rows", f"doc_id {dict(self.rows.dtypes)['doc_id']}, " + ", ".join(f"w{i} double" for i in range(self.k)))

    def terms(self, h: np.ndarray) -> DataFrame:
        """term, h0 .."""
        table = pa.table([self.names, *(pa.array(c, pa.float64()) for c in h.T)], ["term", *(f"h{i}" for i in range(self.k))])
        spark = self.rows.sparkSession
        return spark.createDataFrame(table) if len(self.names) else spark.createDataFrame([], "term string, " + ", ".join(f"h{i} double" for i in range(self.k)))

    def _run(self, what: str, schema: str) -> DataFrame:
        steps, rule, k, size = list(self.steps), self.rule, self.k, len(self.names)
        w_names = [f"w{i}" for i in range(k)]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, inner, seen = np.zeros((k, size)) if what == "sums" else None, np.zeros((k + 1, k)), np.zeros(size, bool)
            for b in batches:
                if not b.num_rows:
                    continue
                lens = pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, x, p = b.column("ids").flatten().to_numpy(zero_copy_only=False), b.column("xs").flatten().to_numpy(zero_copy_only=False), b.column("p").to_numpy(zero_copy_only=False)
                w = np.array([b.column(c).to_numpy(zero_copy_only=False) for c in w_names], float).reshape(k, -1).T.copy()
                for h, gram in steps:
                    for lo, hi, begin, end in stretches(lens, CELLS * 4):
                        w[lo:hi] = rule(w[lo:hi], sums(x[begin:end, None] * h.value[ids[begin:end]], lens[lo:hi]), gram)
                if what == "rows":
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, w.T)], ["doc_id", *w_names])
                elif what == "keep":
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "ids", "xs", "p")), *map(pa.array, w.T)], ["doc_id", "ids", "xs", "p", *w_names])
                else:
                    inner[:k] += w.T @ (p[:, None] * w)
                    inner[k, 0] += float(p @ sums(x * x, lens))
                    own, at = np.unique(ids, return_inverse=True)
                    seen[own] = True
                    for i in range(k):
                        total[i, own] += np.bincount(at, x * np.repeat(p * w[:, i], lens), len(own))
            if what == "sums":
                ids = np.flatnonzero(seen)
                out = np.concatenate([total[:, ids], inner.T], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, -1 - np.arange(k + 1)]), pa.int32()), *map(pa.array, out)], ["id", *(f"n{i}" for i in range(k))])

        return self.rows.mapInArrow(work, schema)
