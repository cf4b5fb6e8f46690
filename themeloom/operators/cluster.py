"""Clusters, mixtures, density peaks and independent components over vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.sources.store import settle


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def gap2(vector: str, centre: Sequence[float]) -> Column:
    """Squared distance to a fixed point."""
    return F.aggregate(F.zip_with(vector, literal(centre), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, d: s + d)


def assign(rows: DataFrame, centres: np.ndarray, key: str, vector: str) -> DataFrame:
    """key, topic_id of the nearest centre (ties, at nine digits, by id): no shuffle, the centres are constants."""
    best = F.array_min(F.array(*(F.struct(F.round(gap2(vector, c), 9).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
    return rows.select(key, best["i"].alias("topic_id"), vector)


def means(rows: DataFrame, vector: str) -> dict[int, np.ndarray]:
    long = rows.select("topic_id", F.posexplode(vector).alias("i", "x")).groupBy("topic_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    got = long.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r.topic_id: np.array([c.x for c in r.v]) for r in got}


def lloyd(rows: DataFrame, centres: np.ndarray, iterations: int = 10, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """key, topic_id and the centres after so many rounds of k-means from given centres; a cluster that empties keeps its centre.

    An empty table, or no centres, has no labels; rows without a vector have none.
    """
    centres = np.array(centres, float)
    if not len(centres):
        return rows.where("false").select(key, F.lit(0).alias("topic_id")), centres
    rows = settle(rows.select(key, vector).where(F.col(vector).isNotNull()))
    for _ in range(iterations):
        for i, m in means(assign(rows, centres, key, vector), vector).items():
            centres[i] = m
    return assign(rows, centres, key, vector).select(key, "topic_id"), centres


def first_rows(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", hashed: bool = False) -> np.ndarray:
    """The vectors of the k least keys, or of the least hashes of keys, which a corpus in order doesn't put in one cluster: fixed seeds."""
    by = [F.xxhash64(key), F.col(key)] if hashed else [F.col(key)]
    return np.array([list(r[1]) for r in rows.select(key, vector).where(F.col(vector).isNotNull()).orderBy(*by).limit(k).collect()], float)


@dataclass
class Moments:
    """Sums over the rows of a group: count, x, y, x x', x y', y y'."""

    n: float
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def slopes(self) -> np.ndarray:
        """Coefficients (dims x outputs) of the least squares from x to y with an intercept, of least norm."""
        n = max(self.n, 1)
        return np.linalg.pinv(self.xx - np.outer(self.x, self.x) / n, hermitian=True) @ (self.xy - np.outer(self.x, self.y) / n)


def moments(rows: DataFrame, group: str, x: str = "v", y: str = "y") -> dict[int, Moments]:
    """Moments by group, which are few: Arrow batches add up, and only (dims + outputs) ** 2 cells a group reach the driver."""
    import pandas as pd

    def work(it):
        for pdf in it:
            for g, part in pdf.groupby("g"):
                z = np.concatenate([np.stack(part["x"]).astype(float), np.stack(part["y"]).astype(float), np.ones((len(part), 1))], axis=1)
                cells = z.T @ z
                yield pd.DataFrame({"g": g, "i": np.arange(len(cells)), "d": len(part["x"].iloc[0]), "row": list(cells)})

    got = rows.select(F.col(group).cast("int").alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).where("g is not null").mapInPandas(work, "g int, i int, d int, row array<double>")
    sums = got.select("g", "i", "d", F.posexplode("row").alias("j", "c")).groupBy("g", "d", "i", "j").agg(F.sum("c").alias("c")).collect()
    out, sizes = {}, {r.g: r.d for r in sums}
    for g, d in sizes.items():
        own = [r for r in sums if r.g == g]
        m = np.zeros((max(r.i for r in own) + 1,) * 2)
        for r in own:
            m[r.i, r.j] = r.c
        out[g] = Moments(m[-1, -1], m[:d, -1], m[d:-1, -1], m[:d, :d], m[:d, d:-1], m[d:-1, d:-1])
    return out


def normal_pdf(cols: Sequence[str], mean: Sequence[float], cov: np.ndarray) -> Column:
    """Density of a two-dimensional normal distribution."""
    inv, det = np.linalg.inv(cov), float(np.linalg.det(cov))
    dx, dy = F.col(cols[0]) - float(mean[0]), F.col(cols[1]) - float(mean[1])
    q = dx * dx * float(inv[0, 0]) + dx * dy * float(inv[0, 1] + inv[1, 0]) + dy * dy * float(inv[1, 1])
    return F.exp(q * -0.5) / F.lit(float(2 * np.pi * np.sqrt(det)))


def fixed_mean_mixture(points: DataFrame, centres: np.ndarray, weights: np.ndarray, iterations: int = 10, reg: float = 1e-6, key: str = "id") -> tuple[DataFrame, np.ndarray, list[np.ndarray]]:
    """Responsibilities (key, r0 ..), weights, covariances of a mixture over (key, x, y) whose means stay at the peaks: EM by sums a pass."""
    k = len(centres)
    moments = points.agg(F.var_pop("x"), F.covar_pop("x", "y"), F.var_pop("y")).first()
    covs = [np.array([[moments[0], moments[1]], [moments[1], moments[2]]]) + reg * np.eye(2) for _ in range(k)]
    weights = np.array(weights, float)
    points = settle(points)

    def responsibilities() -> DataFrame:
        dens = points.select(key, "x", "y", *((normal_pdf(("x", "y"), centres[i], covs[i]) * float(weights[i])).alias(f"d{i}") for i in range(k)))
        total = sum((F.col(f"d{i}") for i in range(1, k)), F.col("d0"))
        return dens.select(key, "x", "y", *((F.col(f"d{i}") / F.greatest(total, F.lit(1e-300))).alias(f"r{i}") for i in range(k)))

    for _ in range(iterations):
        sums = []
        for i in range(k):
            dx, dy, r = F.col("x") - float(centres[i][0]), F.col("y") - float(centres[i][1]), F.col(f"r{i}")
            sums += [F.sum(r), F.sum(r * dx * dx), F.sum(r * dx * dy), F.sum(r * dy * dy)]
        got = np.array(responsibilities().agg(*sums).first(), float).reshape(k, 4)
        n = np.maximum(got[:, 0], 1e-12)
        covs = [np.array([[g[1], g[2]], [g[2], g[3]]]) / m + reg * np.eye(2) for g, m in zip(got, n, strict=True)]
        weights = got[:, 0] / got[:, 0].sum()
    return responsibilities().drop("x", "y"), weights, covs


def density_grid(points: DataFrame, side: int = 100) -> DataFrame:
    """gx, gy, px, py, z: Gaussian kernel density, Scott's bandwidth, on a grid over the range of both axes.

    Points on a line or all alike have no density of this kind: z is 0 everywhere; no points: no cells. points: x, y. The grid is the fixed side and is broadcast; each point adds to its cells in map-side sums.
    """
    box = points.agg(F.least(F.min("x"), F.min("y")).alias("lo"), F.greatest(F.max("x"), F.max("y")).alias("hi"), F.var_samp("x").alias("a"), F.covar_samp("x", "y").alias("b"), F.var_samp("y").alias("c"), F.count(F.lit(1)).alias("n"))
    box = box.withColumn("s", F.pow("n", F.lit(-1.0 / 3)))  # Scott's factor n ** (-1 / (d + 4)), squared
    box = box.selectExpr("lo", "hi", "n", "a * s AS a", "b * s AS b", "c * s AS c").selectExpr("*", "a * c - b * b AS det").where("n > 0")
    grid = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("gx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("gy"))
    grid = grid.selectExpr("*", f"lo + gx * (hi - lo) / {side - 1} AS px", f"lo + gy * (hi - lo) / {side - 1} AS py")
    cells = points.crossJoin(F.broadcast(grid)).selectExpr("gx", "gy", "px", "py", "exp(-0.5 * ((x - px) * (x - px) * c - 2 * (x - px) * (y - py) * b + (y - py) * (y - py) * a) / nullif(det, 0)) / nullif(2 * pi() * sqrt(greatest(det, 0)) * n, 0) AS z")
    return cells.groupBy("gx", "gy", "px", "py").agg(F.coalesce(F.sum("z"), F.lit(0.0)).alias("z"))


def peaks(grid: DataFrame, digits: int = 9) -> DataFrame:
    """Cells of the grid with no greater neighbour among eight; cells of density 0 are background."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    z = F.round("z", digits)
    near = grid.select(z.alias("z"), F.explode(F.array(*(F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i, j in steps))).alias("c"))
    most = near.groupBy("c.gx", "c.gy").agg(F.max("z").alias("most"))
    return grid.join(most, ["gx", "gy"]).where((z == F.col("most")) & (z > 0)).select("gx", "gy", "px", "py", "z")


def ica(rows: DataFrame, k: int, iterations: int = 50, tol: float = 1e-6, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """key and s (array of k signals), the unmixing matrix (k x dims) and the mean: symmetric fixed-point ICA (Hyvarinen, 1999), tanh.

    One pass gathers mean and covariance; whitening is on the driver; every iteration is one pass that sums k x k cells. There are at most as many
    components as dimensions; rows without a vector don't count, and an empty table has no signals.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vec = rows.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    vec = settle(vec.where("v is not null"))
    if (first := vec.first()) is None:
        return vec.select(key, F.col("v").alias("s")), np.zeros((k, 0)), np.zeros(0)
    n_dims = len(first.v)
    k = min(k, n_dims)
    mean = vec.select(array_to_vector("v").alias("f")).select(Summarizer.mean(F.col("f")).alias("m")).first().m.toArray()
    n = vec.count()

    def second(it):
        import pandas as pd

        for pdf in it:
            x = np.stack(pdf["v"]) - mean
            c = x.T @ x
            yield pd.DataFrame({"i": np.arange(len(c)), "row": list(c)})

    got = vec.select("v").mapInPandas(second, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    cov = np.zeros((n_dims, n_dims))
    for r in got:
        cov[r.i, r.j] = r.c / n
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:k]
    whiten = (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))).T
    white = settle(vec.select(key, F.array(*(F.aggregate(F.zip_with("v", literal(w), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - float(w @ mean) for w in whiten)).alias("z")))
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))
    w = q
    for _ in range(iterations):
        y = [sum((F.col("z")[j] * float(w[i, j]) for j in range(1, k)), F.col("z")[0] * float(w[i, 0])) for i in range(k)]
        rows_ = white.select("z", *(F.tanh(y[i]).alias(f"t{i}") for i in range(k)))
        cells = [F.avg(F.col("z")[j] * F.col(f"t{i}")) for i in range(k) for j in range(k)] + [F.avg(1 - F.col(f"t{i}") * F.col(f"t{i}")) for i in range(k)]
        got = np.array(rows_.agg(*cells).first(), float)
        new = got[: k * k].reshape(k, k) - got[k * k :][:, None] * w
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        moved = np.max(np.abs(np.abs((new * w).sum(1)) - 1))
        w = new
        if moved < tol:
            break
    signals = white.select(key, F.array(*(sum((F.col("z")[j] * float(w[i, j]) for j in range(1, k)), F.col("z")[0] * float(w[i, 0])) for i in range(k))).alias("s"))
    return signals, w @ whiten, mean


def sinkhorn(costs: DataFrame, alpha: float, iterations: int = 50) -> DataFrame:
    """a_id, b_id, plan: entropic transport between uniform masses; costs: a_id, b_id, m. Each half-step is a group-by."""
    k = settle(costs.withColumn("k", F.exp(F.col("m") * -float(alpha))))
    n = {c: k.select(c).distinct().count() for c in ("a_id", "b_id")}
    u = k.select("a_id").distinct().withColumn("u", F.lit(1.0 / n["a_id"]))
    for _ in range(iterations):
        v = k.join(u, "a_id").groupBy("b_id").agg((F.lit(1.0 / n["b_id"]) / (F.sum(F.col("k") * F.col("u")) + 1e-16)).alias("v"))
        u = settle(k.join(v, "b_id").groupBy("a_id").agg((F.lit(1.0 / n["a_id"]) / (F.sum(F.col("k") * F.col("v")) + 1e-16)).alias("u")))
    return k.join(u, "a_id").join(v, "b_id").select("a_id", "b_id", (F.col("u") * F.col("k") * F.col("v")).alias("plan"))


def discriminants(vectors: DataFrame, term_vectors: DataFrame, reg: float = 1e-3) -> DataFrame:
    """topic_id, term, weight: cosine of terms with each topic's linear discriminant. vectors: topic_id, v.

    Class means and the pooled second moments are sums of one pass; dims x dims are solved on the driver.
    """
    import pandas as pd

    from themeloom.functions import cosine

    centres = means(vectors.select("topic_id", "v"), "v")
    sizes = {r.topic_id: r.n for r in vectors.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).collect()}

    def second(it):
        for pdf in it:
            x = np.stack(pdf["v"]).astype(float)
            yield pd.DataFrame({"i": np.arange(x.shape[1]), "row": list(x.T @ x)})

    d = len(next(iter(centres.values())))
    total = np.zeros((d, d))
    sums = vectors.select("v").mapInPandas(second, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    for r in sums:
        total[r.i, r.j] = r.c
    within = (total - sum(sizes[t] * np.outer(m, m) for t, m in centres.items())) / max(1, sum(sizes.values()) - len(sizes))
    within += reg * np.trace(within) / d * np.eye(d)
    overall = sum(sizes[t] * m for t, m in centres.items()) / sum(sizes.values())
    coefs = [(t, [float(x) for x in np.linalg.solve(within, m - overall)]) for t, m in sorted(centres.items())]
    table = vectors.sparkSession.createDataFrame(coefs, "topic_id int, c array<double>")
    return term_vectors.crossJoin(F.broadcast(table)).select("topic_id", "term", cosine("c", "v").alias("weight"))
