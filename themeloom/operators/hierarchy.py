"""Topic trees as tables: path (array of ids), parent, level; and merges of topics by linkage on the few topic rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def create_root(labels: DataFrame) -> DataFrame:
    """path, level, topic_id, n: the root and a child a topic."""
    sizes = labels.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    children = sizes.select(F.array("topic_id").alias("path"), F.lit(1).alias("level"), "topic_id", "n")
    root = labels.agg(F.count(F.lit(1)).alias("n")).select(F.array().cast("array<int>").alias("path"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("topic_id"), "n")
    return root.union(children)


def divide(tree: DataFrame, sub: DataFrame) -> DataFrame:
    """tree with children below its topics. sub: topic_id (the parent's), sub_id, n."""
    below = sub.join(F.broadcast(tree.where("level > 0").select("path", "level", "topic_id")), "topic_id")
    return tree.union(below.select(F.concat("path", F.array("sub_id")).alias("path"), F.col("level") + 1, F.col("sub_id").alias("topic_id"), "n"))


def cut(tree: DataFrame, depth: int) -> DataFrame:
    return tree.where(F.col("level") <= depth)


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes that are no other's parent."""
    parents = tree.where("level > 0").select(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("p")).distinct()
    return tree.join(parents, tree["path"] == parents["p"], "left_anti")


def flatten(tree: DataFrame) -> DataFrame:
    """path, topic_id: the leaves numbered anew from 0 in order of path; an outlier topic keeps -1."""
    out = leaves(tree).where("level > 0")
    rest = out.where("topic_id <> -1").withColumn("new", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    return rest.select("path", F.col("new").alias("topic_id")).union(out.where("topic_id = -1").select("path", "topic_id"))


def lines(tree: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """path, line: the tree as indented text, in order of path."""
    dotted = F.when(F.size("path") == 0, F.lit("Root")).otherwise(F.array_join(F.transform("path", lambda x: x.cast("string")), "."))
    return tree.select(dotted.alias("path"), "level", F.concat(F.repeat(F.lit("  "), F.col("level")), dotted, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))


def join_topics(labels: DataFrame, to_join: Sequence[int]) -> DataFrame:
    """Labels with these topics made one, whose id is their least; an id given twice is an error."""
    if len(set(to_join)) != len(to_join) or len(to_join) < 2:
        raise ValueError("give two or more different topics")
    return labels.withColumn("topic_id", F.when(F.col("topic_id").isin(list(to_join)), F.lit(min(to_join))).otherwise(F.col("topic_id")))


def relabel(labels: DataFrame, mapping: dict[int, int]) -> DataFrame:
    table = labels.sparkSession.createDataFrame([(int(a), int(b)) for a, b in mapping.items()], "topic_id int, new int")
    return labels.join(F.broadcast(table), "topic_id", "left").select("doc_id", F.coalesce("new", "topic_id").alias("topic_id"))


def pairwise(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(-1)))
    size = np.linalg.norm(x, axis=1)
    return 1 - x @ x.T / np.maximum(np.outer(size, size), 1e-300)


def smallest_linkage(ids: Sequence[int], vectors: np.ndarray, sizes: Sequence[int], to: int, metric: str = "cosine") -> list[tuple[int, int, float, int]]:
    """(smallest topic, its nearest, distance, size of both), again and again until `to` topics are left; the outlier -1 stays out.

    A new topic's vector is the mean weighted by size; its id is the count of topics plus the step.
    """
    live = {int(i): (np.asarray(v, float), int(n)) for i, v, n in zip(ids, vectors, sizes, strict=True) if i != -1}
    first, out = len(live), []
    while len(live) > max(1, to):
        small = min(live, key=lambda i: (live[i][1], i))
        others = sorted(i for i in live if i != small)
        gaps = pairwise(np.stack([live[small][0], *(live[i][0] for i in others)]), metric)[0, 1:]
        near = others[int(np.argmin(np.round(gaps, 12)))]
        (a, n), (b, m) = live.pop(small), live.pop(near)
        out.append((small, near, float(gaps.min()), n + m))
        live[first + len(out) - 1] = ((a * n + b * m) / (n + m), n + m)
    return out


#: Lance-Williams coefficients (alpha_i, alpha_j, beta, gamma) by the sizes of i, j and the other.
LINKAGES = {
    "single": lambda i, j, k: (0.5, 0.5, 0, -0.5),
    "complete": lambda i, j, k: (0.5, 0.5, 0, 0.5),
    "average": lambda i, j, k: (i / (i + j), j / (i + j), 0, 0),
    "weighted": lambda i, j, k: (0.5, 0.5, 0, 0),
    "centroid": lambda i, j, k: (i / (i + j), j / (i + j), -i * j / (i + j) ** 2, 0),
    "median": lambda i, j, k: (0.5, 0.5, -0.25, 0),
    "ward": lambda i, j, k: ((i + k) / (i + j + k), (j + k) / (i + j + k), -k / (i + j + k), 0),
}


def linkage(vectors: np.ndarray, method: str = "average", metric: str = "cosine") -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) of every merge, by the update of Lance and Williams (1967), for the rows of a topic table."""
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}")
    squared = method in ("centroid", "median", "ward")
    d = pairwise(np.asarray(vectors, float), "euclidean" if squared else metric)
    gaps = {(i, j): d[i, j] ** 2 if squared else d[i, j] for i in range(len(d)) for j in range(i)}
    size, out = dict.fromkeys(range(len(d)), 1), []
    while len(size) > 1:
        (i, j), gap = min(gaps.items(), key=lambda x: (round(x[1], 12), x[0]))
        new = len(d) + len(out)
        get = lambda a, b: gaps[max(a, b), min(a, b)]
        for k in size:
            if k not in (i, j):
                a, b, c, g = LINKAGES[method](size[i], size[j], size[k])
                gaps[new, k] = a * get(i, k) + b * get(j, k) + c * gap + g * abs(get(i, k) - get(j, k))
        size[new] = size.pop(i) + size.pop(j)
        gaps = {p: x for p, x in gaps.items() if i not in p and j not in p}
        out.append((j, i, float(np.sqrt(max(0, gap)) if squared else gap), size[new]))
    return out


def reduce_topics(ids: Sequence[int], merges: Sequence[tuple], to: int) -> dict[int, int]:
    """Old id -> new id after as many merges as leave `to` topics; a merged topic's id is its least. Warns if there are no more than that."""
    ids = [int(i) for i in ids if i != -1]
    if len(ids) <= to:
        import warnings

        warnings.warn(f"there are {len(ids)} topics already", stacklevel=2)
        return {i: i for i in ids}
    groups = {i: [i] for i in ids}
    for step, (a, b, *_) in enumerate(merges[: len(ids) - to]):
        groups[len(ids) + step] = groups.pop(a) + groups.pop(b)
    return {i: min(g) for g in groups.values() for i in g}
