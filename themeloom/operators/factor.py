"""Matrix factorisation: short driver loops around distributed aggregations; only topics x topics and topics x dims reach the driver."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators import packed
from themeloom.sources.store import ready, settle, small

TINY = 1e-12


def start(rows: DataFrame, key: str, k: int, prefix: str, *others: str) -> DataFrame:
    """key, others and k columns between 1/16 and 1, from the md5 of key and column: the same on any cluster."""
    one = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{i}"))), 1, 1)) / F.lit(16.0)
    return rows.select(key, *others, *(one(i).alias(f"{prefix}{i}") for i in range(k)))


def gram(rows: DataFrame, prefix: str, k: int, weight: str | None = None) -> np.ndarray:
    """k x k inner products of the columns, perhaps weighted."""
    w = F.col(weight) if weight else F.lit(1.0)
    cells = [F.sum(w * F.col(f"{prefix}{i}") * F.col(f"{prefix}{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    return np.nan_to_num(np.array(rows.agg(*cells).first(), float)).reshape(k, k)


def times(prefix: str, m: np.ndarray, i: int) -> Column:
    """Column i of a row of k columns times the k x k matrix m."""
    return sum((F.col(f"{prefix}{j}") * F.lit(float(m[j, i])) for j in range(1, len(m))), F.col(f"{prefix}0") * F.lit(float(m[0, i])))


def _update(rows: DataFrame, key: str, own: str, other: str, value: Column, m: np.ndarray) -> DataFrame:
    """Multiplicative update (Lee and Seung, 2001) of the factor `own`, kept by key, from long rows with both factors' columns."""
    k = len(m)
    tops = rows.groupBy(key).agg(*(F.sum(value * F.col(f"{other}{i}")).alias(f"n{i}") for i in range(k)), *(F.first(f"{own}{i}").alias(f"{own}{i}") for i in range(k)))
    return tops.select(key, *((F.col(f"{own}{i}") * F.col(f"n{i}") / F.greatest(times(own, m, i), F.lit(TINY))).alias(f"{own}{i}") for i in range(k)))


def nmf(x: DataFrame, k: int, iterations: int = 20, weights: DataFrame | None = None, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """W (doc_id, w0 ..) and H (term, h0 ..) with x (doc_id, term, x) ~ W H, both non-negative: exactly `iterations` multiplicative steps.

    This is the form that SQL can follow step by step; fit_nmf() converges. x may also have a document a row (doc_id, terms, xs). weights: doc_id, weight of rows; fixed: an H that stays.
    Steps are passes over packed cells; with more terms than those hold, each half-step is one group-by of long cells by document or by term.
    """
    got = _packed_nmf(x, k, iterations, weights, fixed)
    return got[:2] if got is not None else _long_nmf(_cells(x), k, iterations, weights, fixed)


def _cells(x: DataFrame) -> DataFrame:
    """Long cells of either form."""
    return x.select("doc_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("xs").alias("x")))) if "terms" in x.columns else x


def _packable(x: DataFrame, weights: DataFrame | None) -> DataFrame:
    rows = settle(x.select("doc_id", "terms", F.col("xs").cast("array<double>").alias("xs"), F.lit(1.0).alias("p")) if "terms" in x.columns else packed.pack(x))
    return rows if weights is None else settle(rows.drop("p").join(weights.select("doc_id", F.col("weight").cast("double").alias("p")), "doc_id"))


def multiply(w: np.ndarray, n: np.ndarray, g: np.ndarray) -> np.ndarray:
    return w * n / np.maximum(w @ g, TINY)


def _packed_nmf(x: DataFrame, k: int, iterations: int, weights: DataFrame | None = None, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, packed.Packed, np.ndarray] | None:
    """W, H, the cells and H as an array; None where the terms are too many."""
    cells = packed.of(_packable(x, weights), k, start, multiply, fixed)
    if cells is None:
        return None
    h = cells.h
    for _ in range(iterations):
        cells.step(h, h.T @ h)
        if fixed is None:
            n, g, _ = cells.sums()
            h = multiply(h, n, g)
    return cells.documents(), fixed if fixed is not None else cells.terms(h), cells, h


def nmf_error(x: DataFrame, k: int, iterations: int) -> tuple[float, int, int]:
    """Squared error after nmf()'s steps, and the numbers of documents and of terms."""
    got = _packed_nmf(x, k, iterations)
    if got is None:
        x = settle(_cells(x))
        w, h = _long_nmf(x, k, iterations)
        return residual(x, w, h, k), w.count(), h.count()
    _, _, cells, h = got
    n, g, own = cells.sums()
    return own - 2 * float((n * h).sum()) + float((g * (h.T @ h)).sum()), cells.rows.count(), len(h)


def _long_nmf(x: DataFrame, k: int, iterations: int, weights: DataFrame | None = None, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nmf() by joins of long cells; factors are settled in the shared folder after each iteration."""
    x = x.select("doc_id", "term", F.col("x").cast("double").alias("x"))
    x = x.join(weights.select("doc_id", F.col("weight").cast("double").alias("p")), "doc_id") if weights is not None else x.withColumn("p", F.lit(1.0))
    x = settle(x)
    w, h = start(x.select("doc_id").distinct(), "doc_id", k, "w"), fixed if fixed is not None else start(x.select("term").distinct(), "term", k, "h")
    for _ in range(iterations):
        w = settle(_update(x.join(w, "doc_id").join(h, "term"), "doc_id", "w", "h", F.col("x"), gram(h, "h", k)))
        if fixed is None:
            rows = w.join(x.select("doc_id", "p").distinct(), "doc_id")
            h = settle(_update(x.join(w, "doc_id").join(h, "term"), "term", "h", "w", F.col("x") * F.col("p"), gram(rows, "w", k, "p")))
    return w, h


@dataclass
class Fit:
    """How a factorisation ended: passes over the cells, squared error, and whether the error had settled."""

    steps: int
    error: float
    converged: bool


def _swept(x: np.ndarray, y: np.ndarray, g: np.ndarray, sweeps: int) -> np.ndarray:
    """Coordinate descent of rows of a factor (k x rows), y their products with the other one, g its inner products."""
    x = x.copy()
    for _ in range(sweeps):
        before = x.copy()
        for i in range(len(g)):
            if g[i, i] > TINY:
                x[i] = np.maximum(0.0, x[i] + (y[i] - g[i] @ x) / g[i, i])
        if np.abs(x - before).max(initial=0.0) <= 1e-10 * max(1.0, np.abs(x).max(initial=0.0)):
            break
    return x


def _descend(rows: DataFrame, key: str, p: str, grams: np.ndarray | Mapping[int, np.ndarray], sweeps: int, *keys: str) -> DataFrame:
    """key, keys, the factor's columns and c, its product with the inner products n0 ..: coordinate descent, a row by itself, in Arrow batches.

    grams: the other factor's inner products, or those by the value of the first of keys.
    """
    ready(rows.sparkSession)
    k = len(grams) if isinstance(grams, np.ndarray) else len(next(iter(grams.values()), np.zeros((0, 0))))
    names = [f"{p}{i}" for i in range(k)]
    heads = [key, *keys]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = (np.array([b.column(at + i).to_numpy(zero_copy_only=False) for i in range(k)], float).reshape(k, -1) for at in (len(heads), len(heads) + k))
            groups = [(grams, slice(None))]
            if not isinstance(grams, np.ndarray):
                group = b.column(1).to_numpy(zero_copy_only=False)
                groups = [(grams[int(v)], group == v) for v in np.unique(group)]
            for g, at in groups:
                w[:, at] = _swept(w[:, at], n[:, at], g, sweeps)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(heads))), *map(pa.array, w), pa.array((w * n).sum(0))], [*heads, *names, "c"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in heads), *(f"{c} double" for c in names), "c double"])
    return rows.select(*heads, *names, *(f"n{i}" for i in range(k))).mapInArrow(work, schema)


def _products(x: DataFrame, other: DataFrame, by: str, key: str, p: str, k: int, value: Column, *keys: str) -> DataFrame:
    """key, keys, n0 ..: sums of value times the other factor's columns; whether that factor is broadcast is up to its hint or measured size."""
    rows = x.join(other, by)
    return rows.groupBy(key, *keys).agg(*(F.sum(value * F.col(f"{p}{i}")).alias(f"n{i}") for i in range(k)))


def _filled(left: DataFrame, n: DataFrame, on: list[str], k: int) -> DataFrame:
    return left.join(n, on, "left").na.fill(0.0, [f"n{i}" for i in range(k)])


def solve_rows(x: DataFrame, keys: DataFrame, h: DataFrame, k: int, sweeps: int = 200) -> DataFrame:
    """doc_id, w0 ..: non-negative least squares of each document's cells under fixed terms (term, h0 ..), to convergence, in one pass over x.

    keys: doc_id of every document; one without cells of the fitted terms has zeros.
    """
    h = settle(h.select("term", *(f"h{i}" for i in range(k))))
    n = _products(x, small(h, 8 * k + 24), "term", "doc_id", "h", k, F.col("x").cast("double"))
    rows = _filled(start(keys.select("doc_id").where("doc_id is not null").distinct(), "doc_id", k, "w"), n, ["doc_id"], k)
    return _descend(rows, "doc_id", "w", gram(h, "h", k), sweeps).select("doc_id", *(F.when(F.lit(h.isEmpty()), 0.0).otherwise(F.col(f"w{i}")).alias(f"w{i}") for i in range(k)))


def solve_terms_by_bin(x: DataFrame, w: DataFrame, bins: DataFrame, k: int, sweeps: int = 200) -> DataFrame:
    """bin, term, h0 ..: non-negative least squares of each bin's cells under fixed documents (doc_id, w0 ..); all bins in one pass.

    bins: doc_id, bin. Terms absent from a bin have no row there; documents without a bin don't count.
    """
    w = settle(w.select("doc_id", *(f"w{i}" for i in range(k))).join(bins.select("doc_id", F.col("bin").cast("int").alias("bin")).where("bin is not null"), "doc_id"))
    cells = [F.sum(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
    grams = {r[0]: np.array(r[1:], float).reshape(k, k) for r in w.groupBy("bin").agg(*cells).collect()}
    n = _products(x, w, "doc_id", "term", "w", k, F.col("x").cast("double"), "bin")
    rows = n.join(start(x.select("term").distinct(), "term", k, "h"), "term")
    if not grams:
        return rows.select("bin", "term", *(f"h{i}" for i in range(k)))
    return _descend(rows, "term", "h", grams, sweeps, "bin").select("bin", "term", *(f"h{i}" for i in range(k)))


def fit_nmf(x: DataFrame, k: int, iterations: int = 50, weights: DataFrame | None = None, tol: float = 1e-4, sweeps: int = 2) -> tuple[DataFrame, DataFrame, Fit]:
    """W (doc_id, w0 ..), H (term, h0 ..) and how the fit ended: coordinate descent (hierarchical alternating least squares) on x (doc_id, term, x).

    It stops when a step lowers the squared error by no more than tol of it, or after `iterations`. A step is one sum by document and
    one by term; rows are solved by themselves. An empty x gives empty factors. weights: doc_id, weight of rows in the error.
    """
    x = x.select("doc_id", "term", F.col("x").cast("double").alias("x")).where("doc_id is not null and term is not null and x is not null")
    x = x.join(weights.select("doc_id", F.col("weight").cast("double").alias("p")), "doc_id") if weights is not None else x.withColumn("p", F.lit(1.0))
    x = settle(x)
    rule = lambda w, n, g: _swept(w.T, n.T, g, sweeps).T
    if (cells := packed.of(settle(packed.pack(x)), k, start, rule)) is not None:
        return _packed_fit(cells, iterations, tol, sweeps)
    own = float(x.agg(F.sum(F.col("p") * F.col("x") * F.col("x"))).first()[0] or 0.0)
    docs = settle(x.select("doc_id", "p").distinct())
    few = {c: df.count() * (8 * k + 24) <= 16 << 20 for c, df in (("doc_id", docs), ("term", x.select("term").distinct()))}
    hint = lambda df, c: F.broadcast(df) if few[c] else df
    w, h = settle(start(docs, "doc_id", k, "w")), settle(start(x.select("term").distinct(), "term", k, "h"))
    error, steps, done, gh = own, 0, own == 0.0, gram(h, "h", k)
    while steps < iterations and not done:
        steps += 1
        rows = _filled(w, _products(x, hint(h, "term"), "term", "doc_id", "h", k, F.col("x")), ["doc_id"], k)
        w = settle(_descend(rows, "doc_id", "w", gh, sweeps).drop("c"))
        gw = gram(w.join(docs, "doc_id"), "w", k, "p")
        rows = _filled(h, _products(x, hint(w, "doc_id"), "doc_id", "term", "w", k, F.col("x") * F.col("p")), ["term"], k)
        new = settle(_descend(rows, "term", "h", gw, sweeps))
        h = new.drop("c")
        cells = [F.sum(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
        got = np.array(new.agg(*cells, F.sum("c").alias("c")).first(), float)
        gh = got[:-1].reshape(k, k)
        now = max(0.0, own - 2 * got[-1] + float((gw * gh).sum()))
        done = steps > 1 and error - now <= tol * max(error, TINY)
        error = now
    return w, h, Fit(steps, error, done)


def _packed_fit(cells: packed.Packed, iterations: int, tol: float, sweeps: int) -> tuple[DataFrame, DataFrame, Fit]:
    """fit_nmf() over packed cells: a step is one pass."""
    h = cells.h
    error, steps, done = 0.0, 0, not len(h)
    while steps < iterations and not done:
        cells.step(h, h.T @ h)
        n, g, own = cells.sums()
        if own == 0.0:
            cells.steps, done = [], True
            break
        steps += 1
        h = _swept(h.T, n.T, g, sweeps).T
        now = max(0.0, own - 2 * float((h * n).sum()) + float((g * (h.T @ h)).sum()))
        done = steps > 1 and error - now <= tol * max(error, TINY)
        error = now
    return settle(cells.documents()), settle(cells.terms(h)), Fit(steps, error, done)


def long(factor: DataFrame, key: str, prefix: str, k: int) -> DataFrame:
    """key, topic_id, weight of a factor's columns."""
    return factor.select(key, F.posexplode(F.array(*(f"{prefix}{i}" for i in range(k)))).alias("topic_id", "weight"))


def residual(x: DataFrame, w: DataFrame, h: DataFrame, k: int) -> float:
    """Squared Frobenius norm of x - W H, from the cells of x and the factors' inner products alone."""
    cross = sum((F.col(f"w{i}") * F.col(f"h{i}") for i in range(1, k)), F.col("w0") * F.col("h0"))
    own = x.join(w, "doc_id").join(h, "term").agg(F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * cross)).first()
    return float(own[0] - 2 * own[1] + (gram(w, "w", k) * gram(h, "h", k)).sum())


def bic(rss: float, n_params: int, n_cells: int) -> float:
    """Bayesian information criterion of a decomposition with Gaussian noise."""
    return n_params * np.log(n_cells) + n_cells * np.log(rss / n_cells)


def snmf_bic(rss: float, k: int, n: int, d: int) -> float:
    return np.log(rss) + k * (n + d) / (n * d) * np.log(n * d / (n + d))


def choose_n(score, low: int = 2, high: int = 250, step: int = 5) -> int:
    """The count of topics of least score: climb until it rises, then close in on the bracket; every score is asked for once."""
    seen: dict[int, float] = {}

    def f(n: int) -> float:
        if n not in seen:
            seen[n] = score(n)
        return seen[n]

    for n in range(low + 1, 10):
        if f(n) < f(low):
            break
    else:
        return low
    a, b, gap = low, n, step
    c = min(high, b + gap)
    while c < high and f(c) < f(b):
        a, b, gap = b, c, gap * 2
        c = min(high, b + gap)
    while c - a > 2:
        m = (a + b) // 2 if b - a > c - b else (b + c + 1) // 2
        if m in (a, b, c):
            break
        if f(m) < f(b):
            a, b, c = (a, m, b) if m < b else (b, m, c)
        else:
            a, c = (m, c) if m < b else (a, m)
    return min(seen, key=lambda n: (seen[n], n))


def snmf(rows: DataFrame, k: int, iterations: int = 10, key: str = "vec_id", vector: str = "embedding", sparsity: float = 0.0, init: Column | None = None, frozen: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """G (key, g0 ..; non-negative) and F (dims x k, any sign) with X ~ G F': Ding, Li and Jordan's semi-NMF.

    init: a column of start labels, one-hot plus 0.2; by default a hash of the key. A pass gathers X'G (dims x k) and G'G, F is
    solved on the driver, and G is updated row by row; it is divided by its Frobenius norm. frozen: first columns of F that stay.
    """
    x = settle(rows.select(key, F.col(vector).alias("x"), (init if init is not None else F.pmod(F.xxhash64(key), F.lit(k))).alias("l")))
    g = settle(x.select(key, "x", *((F.when(F.col("l") == i, 1.0).otherwise(0.0) + 0.2).alias(f"g{i}") for i in range(k))))
    kept = 0 if frozen is None else frozen.shape[1]
    solve = lambda g: _loadings(g, k) if frozen is None else np.concatenate([frozen, _loadings(g, k)[:, kept:]], 1)
    f = solve(g)
    for _ in range(iterations):
        ftf = f.T @ f
        cells = g.select("*", *(_along(f[:, i]).alias(f"a{i}") for i in range(k)), *(times("g", ftf, i).alias(f"b{i}") for i in range(k)))
        pos, neg = (lambda c: (F.abs(c) + F.col(c)) / 2), (lambda c: (F.abs(c) - F.col(c)) / 2)
        new = cells.select(key, "x", *((F.col(f"g{i}") * F.sqrt((pos(f"a{i}") + neg(f"b{i}")) / F.greatest(neg(f"a{i}") + pos(f"b{i}") + sparsity, F.lit(TINY)))).alias(f"g{i}") for i in range(k)))
        new = settle(new)
        size = float(np.sqrt(np.trace(gram(new, "g", k))))
        g = settle(new.select(key, "x", *((F.col(f"g{i}") / F.lit(max(size, TINY))).alias(f"g{i}") for i in range(k))))
        f = solve(g)
    return g.select(key, *(f"g{i}" for i in range(k))), f


def _along(direction: np.ndarray) -> Column:
    axis = F.array(*(F.lit(float(v)) for v in direction))
    return F.aggregate(F.zip_with("x", axis, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def _loadings(g: DataFrame, k: int) -> np.ndarray:
    """F = X'G pinv(G'G)."""
    sums = g.select(F.posexplode("x").alias("i", "v"), *(f"g{j}" for j in range(k))).groupBy("i").agg(*(F.sum(F.col("v").cast("double") * F.col(f"g{j}")).alias(f"s{j}") for j in range(k))).orderBy("i")
    return np.array([r[1:] for r in sums.collect()], float).reshape(-1, k) @ np.linalg.pinv(gram(g, "g", k))


def dual(f: np.ndarray) -> np.ndarray:
    """Axes whose inner products with a vector are its least-squares coordinates on F's columns."""
    return f @ np.linalg.pinv(f.T @ f)


def coordinates(rows: DataFrame, axes: np.ndarray, key: str, vector: str = "v") -> DataFrame:
    """key, topic_id, x: inner products of vectors with the columns of axes (dimensions x topics)."""
    one = lambda a: F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(v)) for v in a)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select(key, F.posexplode(F.array(*(one(axes[:, i]) for i in range(axes.shape[1])))).alias("topic_id", "x"))


def project(rows: DataFrame, f: np.ndarray, key: str, vector: str = "v") -> DataFrame:
    """key, topic_id, x: least-squares coordinates of vectors on the columns of F."""
    return coordinates(rows, dual(f), key, vector)
