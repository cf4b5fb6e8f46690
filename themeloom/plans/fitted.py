"""Queries of the model classes, fitted to convergence: no SQL follows an iterative fit, so tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom import models
from themeloom.plans.register import query
from themeloom.plans.topics import _times
from themeloom.sources.tables import corpus, table


def _images(spark, sf):
    """A picture's vector for each document, every seventh missing: stand-ins from the hash encoder's space."""
    from themeloom.functions import hash_vector

    return corpus(spark, sf).select("doc_id", F.when(F.col("doc_id") % 7 != 0, hash_vector("source")).alias("v"))


def _make(kind):
    return {
        "keynmf": lambda: models.KeyNMF(n_topics=5),
        "cluster": lambda: models.ClusteringTopicModel(n_clusters=5, feature_importance="centroid"),
        "s3": lambda: models.S3(n_topics=4, iterations=30),
        "senstopic": lambda: models.SensTopic(n_topics=4, iterations=10),
        "gmm": lambda: models.GMM(n_topics=4, dims=5),
    }[kind]()


def _register() -> None:
    for kind in ("keynmf", "cluster", "s3", "senstopic", "gmm"):

        def fit_transform(spark, sf, kind=kind):
            docs = corpus(spark, sf)
            return _make(kind).fit(docs).transform(docs)

        def multimodal(spark, sf, kind=kind):
            return _make(kind).fit_multimodal(corpus(spark, sf), _images(spark, sf)).image_topics

        for name, f in ((f"{kind}_fit_transform", fit_transform), (f"{kind}_multimodal", multimodal)):
            f.__name__ = name
            query()(f)
    for kind in ("keynmf", "s3", "senstopic"):

        def over_time(spark, sf, kind=kind):
            return _make(kind).fit(corpus(spark, sf)).over_time(_times(spark, sf), 5)[0]

        over_time.__name__ = f"{kind}_fit_over_time" if kind == "keynmf" else f"{kind}_over_time"
        query()(over_time)


_register()


def _halves(spark, sf):
    docs = corpus(spark, sf)
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


@query()
def keynmf_partial_fit_dynamic(spark, sf):
    """The terms of three time bins after two batches, which together are all documents."""
    times = _times(spark, sf)
    low, high = times.agg(F.min("us"), F.max("us")).first()
    edges = [low, low + (high - low) // 3, low + 2 * (high - low) // 3, high + 1]
    model = models.KeyNMF(n_topics=3)
    for docs in _halves(spark, sf):
        model.partial_fit_dynamic(docs, times.join(docs.select("doc_id"), "doc_id"), edges)
    return model.temporal_factor.select("bin", "term", F.posexplode(F.array("h0", "h1", "h2")).alias("topic_id", "weight"))


@query()
def senstopic_partial_fit(spark, sf):
    """Topics of one half of the documents, and one more from the other half."""
    one, other = _halves(spark, sf)
    return models.SensTopic(n_topics=3, iterations=5).fit(one).partial_fit(other).topic_terms
