"""Topic models over DataFrames: fit on a corpus, then ask for topics, documents, names and topics over time.

A corpus is (doc_id, text); vectors are (doc_id, v). Results are DataFrames in long form: topic_id, term, weight and
doc_id, topic_id, weight. Vectors of documents and terms come from the hash encoder unless an encoder is given, a function from a
DataFrame (key, text) to (key, v) that runs on the executors, or both kinds of vectors are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import hash_vector
from themeloom.operators import bags, cluster, factor, hierarchy, importance, naming, ranking, similarity, text, timebins
from themeloom.sources import store, tables
from themeloom.sources.store import settle, small
from themeloom.streaming import online

Encoder = Callable[[DataFrame], DataFrame]
#: From a corpus (doc_id, text) to its words (doc_id, pos, term).
Tokenizer = Callable[[DataFrame], DataFrame]


@dataclass
class TopicModel:
    """What all models share. fit() sets topic_terms, document_topics and counts (doc_id, term, tf).

    tokenizer replaces the built-in words, encoder the hash vectors. A null doc_id or text doesn't count; a document without a fitted term has a zero
    vector. Vectors of documents that a caller brings need term_vectors (term, v), or an encoder, of the same space.
    """

    min_df: int = 10
    stop: Sequence[str] = ()
    encoder: Encoder | None = None
    tokenizer: Tokenizer | None = None
    topic_terms: DataFrame | None = field(default=None, init=False)
    document_topics: DataFrame | None = field(default=None, init=False)
    counts: DataFrame | None = field(default=None, init=False)
    term_vectors: DataFrame | None = field(default=None, init=False)
    vectors: DataFrame | None = field(default=None, init=False)
    image_topics: DataFrame | None = field(default=None, init=False)
    names: dict[int, str] = field(default_factory=dict, init=False)

    #: Latest counts by the built-in words, with their bags; and whether term_vectors are the hash encoder's.
    _bags, _hashed = (), False

    def _kept(self, rows: DataFrame) -> DataFrame:
        counts = bags.cells(rows)
        self._bags = ((counts, rows), *self._bags[:3])
        return counts

    def _bag_of(self, counts: DataFrame) -> DataFrame:
        """counts with a document a row."""
        return next((rows for c, rows in self._bags if c is counts), None) or bags.of(counts)

    def _words(self, docs: DataFrame) -> DataFrame:
        """doc_id, term, tf of all words."""
        docs = docs.where("doc_id is not null")
        if self.tokenizer is None:
            return text.doc_terms(text.tokens(docs, stop=self.stop))
        words = self.tokenizer(docs).where("term is not null")
        return text.doc_terms(words.where(~F.col("term").isin(list(self.stop))) if self.stop else words)

    def _count(self, docs: DataFrame, min_df: int | None = None) -> DataFrame:
        if self.tokenizer is None:
            self.counts = self._kept(bags.bags(docs.where("doc_id is not null"), self.min_df if min_df is None else min_df, self.stop))
            return self.counts
        words = settle(self._words(docs))
        vocab = settle(text.vocabulary(words, self.min_df if min_df is None else min_df).select("term"))
        self.counts = settle(words.join(small(vocab, 40), "term").select("doc_id", "term", "tf"))
        return self.counts

    def _known(self, docs: DataFrame, vocab: DataFrame) -> DataFrame:
        """Counts of the fitted terms."""
        if self.tokenizer is None:
            return self._kept(bags.bags(docs.where("doc_id is not null"), stop=self.stop, vocab=vocab))
        vocab = settle(vocab.select("term").distinct())
        return settle(self._words(docs).join(small(vocab, 40), "term").select("doc_id", "term", "tf"))

    def _vectors_of_terms(self, names: DataFrame) -> DataFrame:
        if self.encoder is None:
            return settle(tables.term_vectors(names))
        return settle(self.encoder(names.select(F.col("term").alias("key"), F.col("term").alias("text"))).select(F.col("key").alias("term"), "v"))

    def _vectors_of_documents(self, docs: DataFrame, counts: DataFrame, vectors: DataFrame | None, terms: DataFrame | None) -> DataFrame:
        if vectors is not None:
            return settle(vectors.select("doc_id", "v").where("doc_id is not null and v is not null"))
        if self.encoder is not None:
            return settle(self.encoder(docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text")).select(F.col("key").alias("doc_id"), "v"))
        some = bags.vectors(self._bag_of(counts)) if self._hashed else tables.document_vectors(counts, terms)
        zero = F.array_repeat(F.lit(0).cast(some.schema["v"].dataType.elementType), 32)
        return settle(docs.select("doc_id").where("doc_id is not null").distinct().join(some, "doc_id", "left").select("doc_id", F.coalesce("v", zero).alias("v")))

    def _spaces(self, docs: DataFrame, counts: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Vectors of the terms and of the documents, of one length."""
        if self.encoder is None and (vectors is None) != (term_vectors is None):
            raise ValueError("vectors of documents and term_vectors, or an encoder, must come together: the hash vectors are another space")
        self._hashed = self.encoder is None and term_vectors is None
        names = counts.select("term").distinct()
        self.term_vectors = self._vectors_of_terms(names) if term_vectors is None else settle(term_vectors.select("term", "v").where("v is not null").join(names, "term"))
        self.vectors = self._vectors_of_documents(docs, counts, vectors, self.term_vectors)
        same_length(self.term_vectors, self.vectors)
        return self.term_vectors, self.vectors

    def _new_vectors(self, docs: DataFrame, vectors: DataFrame | None) -> DataFrame:
        """Vectors of documents that a fitted model hasn't met."""
        counts = self._known(docs, self.term_vectors) if vectors is None and self.encoder is None else None
        out = self._vectors_of_documents(docs, counts, vectors, self.term_vectors)
        same_length(self.vectors, out)
        return out

    def fit(self, docs: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> TopicModel:
        raise TypeError("TopicModel is what models share; fit one of them")

    def transform(self, docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """doc_id, topic_id, weight of documents under the fitted topics."""
        raise TypeError("TopicModel is what models share; fit one of them")

    def fit_multimodal(self, docs: DataFrame, images: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> TopicModel:
        """Fits on the documents and weighs their images (doc_id, v; null: none) by the same topics: image_topics."""
        self.fit(docs, vectors=vectors, term_vectors=term_vectors)
        self.image_topics = settle(self.transform(docs, vectors=images))
        return self

    def top_images(self, k: int = 5, lowest: bool = False) -> DataFrame:
        """topic_id, rank, doc_id, weight of the images of greatest (or least) weight."""
        if self.image_topics is None:
            raise RuntimeError("fit_multimodal the model first")
        return ranking.top(self.image_topics, ["topic_id"], tie="doc_id", k=k, lowest=lowest).select("topic_id", "rank", "doc_id", "weight")

    def _fitted(self) -> DataFrame:
        if self.topic_terms is None:
            raise RuntimeError("fit the model first")
        return self.topic_terms

    def topics(self, k: int = 10, lowest: bool = False) -> DataFrame:
        """topic_id, rank, term, weight."""
        return ranking.top(self._fitted(), ["topic_id"], k=k, lowest=lowest)

    def table(self, k: int = 10, scores: bool = False, negative: bool = False) -> DataFrame:
        """topic_id, name, highest and perhaps lowest words."""
        return ranking.topics_table(self._fitted(), k, scores, negative).join(self.topic_names(), "topic_id")

    def topic_names(self) -> DataFrame:
        other = None
        if self.names:
            other = self.topic_terms.sparkSession.createDataFrame(list(self.names.items()), "topic_id int, name string")
        return ranking.topic_names(self._fitted(), 4, other)

    def rename(self, names: dict[int, str] | Sequence[str] | Callable[[list[str]], list[str]]) -> None:
        """Names by id, in order of id, or from a text generator."""
        if callable(names):
            names = {r.topic_id: r.name for r in naming.analyze(self._fitted(), names).collect()}
        if not isinstance(names, dict):
            ids = sorted(r.topic_id for r in self._fitted().select("topic_id").distinct().collect())
            if len(ids) != len(names):
                raise ValueError(f"{len(names)} names for {len(ids)} topics")
            names = dict(zip(ids, names, strict=True))
        self.names |= names

    def representative_documents(self, docs: DataFrame, k: int = 5, negative: bool = False) -> DataFrame:
        self._fitted()
        return ranking.representative_documents(self.document_topics, docs, k, negative)

    def distribution(self, doc_id: int, k: int = 10) -> DataFrame:
        self._fitted()
        return self.document_topics.where(F.col("doc_id") == doc_id).orderBy(F.desc("weight"), "topic_id").limit(k).select("topic_id", "weight")

    def over_time(self, times: DataFrame, bins: int | Sequence[int] = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
        """Importance (bin, topic_id, term, weight) and table of topics by time bin. times: doc_id, us (microseconds)."""
        self._fitted()
        at = timebins.bin_equal(times, "us", bins) if isinstance(bins, int) else timebins.bin_edges(times, "us", bins)
        weights = settle(self._by_bin(at))
        return weights, timebins.topics_over_time(weights, k)

    def _by_bin(self, at: DataFrame) -> DataFrame:
        return timebins.soft_importance_over_time(self.counts, self.document_topics, at)

    def save(self, path: str) -> None:
        """All tables, arrays and settings; encoder and tokenizer are functions, which load_tables() leaves as they are."""
        tables_, told = {}, {"kind": type(self).__name__, "names": {str(i): n for i, n in self.names.items()}, "settings": {}, "arrays": {}}
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, DataFrame):
                tables_[f.name] = value
            elif isinstance(value, np.ndarray):
                told["arrays"][f.name] = value.tolist()
            elif f.init and f.name not in ("encoder", "tokenizer") and not callable(value):
                told["settings"][f.name] = list(value) if isinstance(value, tuple) else value
        store.save(path, self._fitted().sparkSession, tables_, told)

    def load_tables(self, path: str, spark) -> TopicModel:
        """What save() wrote, into this model."""
        got, params = store.load(path, spark)
        for name, df in got.items():
            setattr(self, name, df)
        for name, value in params["settings"].items():
            setattr(self, name, value)
        for name, value in params["arrays"].items():
            setattr(self, name, np.array(value, float))
        self.names = {int(i): n for i, n in params["names"].items()}
        return self


def same_length(*tables_: DataFrame) -> None:
    """An error if the vectors (v) of the tables differ in length."""
    sizes = set()
    for df in tables_:
        sizes |= {r[0] for r in df.select(F.size("v")).distinct().collect()}
    if len(sizes) > 1:
        raise ValueError(f"vectors have {sorted(sizes)} dimensions; terms, documents and images must share one space")


@dataclass
class KeyNMF(TopicModel):
    """Keywords of each document by similarity, then non-negative factors of the keyword matrix; with a seed phrase, documents near it weigh more.

    The fit stops by tolerance or after `iterations`; `ended` says which.
    """

    n_topics: int | None = 10
    top_n: int = 25
    iterations: int = 50
    tol: float = 1e-3
    seed_phrase: str | None = None
    seed_exponent: float = 2.0
    metric: str = "cosine"
    ended: factor.Fit | None = field(default=None, init=False)
    cells: DataFrame | None = field(default=None, init=False)
    term_factor: DataFrame | None = field(default=None, init=False)
    document_factor: DataFrame | None = field(default=None, init=False)
    temporal_factor: DataFrame | None = field(default=None, init=False)
    temporal_importance: DataFrame | None = field(default=None, init=False)

    def keywords(self, docs: DataFrame, counts: DataFrame | None = None, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> DataFrame:
        """doc_id, term, x: the top_n terms of each document, of positive similarity."""
        counts = self._count(docs) if counts is None else counts
        terms, found = self._spaces(docs, counts, vectors, term_vectors)
        return self._near(docs, counts, terms, found, self._hashed)

    def _near(self, docs: DataFrame, counts: DataFrame, terms: DataFrame, vectors: DataFrame, own: bool = False) -> DataFrame:
        """own: the documents' vectors are the sums of these counts' hash vectors."""
        if self._hashed and self.seed_phrase is None:
            rows = self._bag_of(counts)
            scores = bags.scores(rows if own else rows.join(vectors.select("doc_id", "v"), "doc_id"), self.top_n, self.metric)
            return similarity.keywords(scores, self.top_n).select("doc_id", "term", F.col("sim").alias("x"))
        scores = similarity.keyword_scores(counts, small(terms, 400), vectors, self.metric)
        if self.seed_phrase is not None:
            one = docs.sparkSession.createDataFrame([(self.seed_phrase,)], "text string")
            seed = one.select(hash_vector("text").alias("s")) if self.encoder is None else self.encoder(one.select(F.lit("seed").alias("key"), "text")).select(F.col("v").alias("s"))
            scores = similarity.seed_relevance(scores, vectors, seed, self.seed_exponent)
        return similarity.keywords(scores, self.top_n).select("doc_id", "term", F.col("sim").alias("x"))

    def fit(self, docs: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> KeyNMF:
        self.cells = settle(self.keywords(docs, None, vectors, term_vectors))
        k = self.n_topics or self._choose(self.cells)
        w, h, self.ended = factor.fit_nmf(self.cells, k, self.iterations, tol=self.tol)
        self.n_topics = k
        return self._set(w, h)

    def _set(self, w: DataFrame, h: DataFrame) -> KeyNMF:
        self.document_factor, self.term_factor = w, h
        self.topic_terms, self.document_topics = factor.long(h, "term", "h", self.n_topics), factor.long(w, "doc_id", "w", self.n_topics)
        return self

    def _choose(self, cells: DataFrame) -> int:
        n, v = (cells.select(c).distinct().count() for c in ("doc_id", "term"))

        def score(k: int) -> float:
            _, _, ended = factor.fit_nmf(cells, k, self.iterations, tol=self.tol)
            return factor.bic(max(ended.error, 1e-9), k * (n + v), n * v)

        return factor.choose_n(score)

    def transform(self, docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """doc_id, topic_id, weight of documents under the fitted terms; zeros where a document has none of them."""
        self._fitted()
        if vectors is None and self.encoder is None and self.tokenizer is None:
            every = self._known(docs, self.term_vectors)
            found = self._vectors_of_documents(docs, every, None, self.term_vectors)
            same_length(self.vectors, found)
            counts = self._kept(bags.kept(self._bag_of(every), self.term_factor))  # whose terms are among term_vectors: the text is read once
        else:
            counts, found = self._known(docs, self.term_factor), self._new_vectors(docs, vectors)
        cells = self._near(docs, counts, self.term_vectors, found)
        return factor.long(factor.solve_rows(cells, docs, self.term_factor, self.n_topics), "doc_id", "w", self.n_topics)

    def _by_bin(self, at: DataFrame) -> DataFrame:
        """Each bin's terms, solved under the fitted documents."""
        h = factor.solve_terms_by_bin(self.cells, self.document_factor, at, self.n_topics)
        return h.select("bin", "term", F.posexplode(F.array(*(f"h{i}" for i in range(self.n_topics)))).alias("topic_id", "weight")).select("bin", "topic_id", "term", "weight")

    def partial_fit(self, docs: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> KeyNMF:
        """A step on a batch of documents: new words join the terms. Words count from one document on, since a batch is small; an empty batch changes nothing."""
        if not self.n_topics:
            raise ValueError("online fitting needs n_topics")
        counts, kept, known = self._count(docs, 1), self.term_factor, self.term_vectors
        self.cells = settle(self.keywords(docs, counts, vectors, term_vectors))
        if known is not None:
            self.term_vectors = settle(known.join(self.term_vectors.select("term"), "term", "left_anti").unionByName(self.term_vectors))
        h = online.online_step(kept, self.cells, self.n_topics)
        return self._set(settle(factor.solve_rows(self.cells, docs, h, self.n_topics)), h)

    def partial_fit_dynamic(self, docs: DataFrame, times: DataFrame, edges: Sequence[int], vectors: DataFrame | None = None, term_vectors: DataFrame | None = None, decay: float = 0.7) -> KeyNMF:
        """partial_fit, and the same for the terms of each bin (temporal_factor: bin, term, h0 ..).

        A bin's terms are solved on the batch and mixed with what they were, of which `decay` stays; terms and bins that the batch lacks stay. temporal_importance
        (bin, topic_id, weight) adds up the documents' weights. edges must be explicit: later batches need the same bins.
        """
        self.partial_fit(docs, vectors, term_vectors)
        at = settle(timebins.bin_edges(times, "us", edges))
        k = self.n_topics
        new = factor.solve_terms_by_bin(self.cells, self.document_factor, at, k)
        sums = self.document_topics.join(at, "doc_id").groupBy("bin", "topic_id").agg(F.sum("weight").alias("weight"))
        if self.temporal_factor is not None:
            old = self.temporal_factor.select("bin", "term", *(F.col(f"h{i}").alias(f"o{i}") for i in range(k)))
            mixed = [F.when(F.col(f"h{i}").isNull(), F.col(f"o{i}")).when(F.col(f"o{i}").isNull(), F.col(f"h{i}")).otherwise(F.col(f"o{i}") * decay + F.col(f"h{i}") * (1 - decay)) for i in range(k)]
            new = old.join(new, ["bin", "term"], "full").select("bin", "term", *(c.alias(f"h{i}") for i, c in enumerate(mixed)))
            sums = sums.unionByName(self.temporal_importance).groupBy("bin", "topic_id").agg(F.sum("weight").alias("weight"))
        self.temporal_factor, self.temporal_importance = settle(new), settle(sums)
        return self

    def divide(self, topic_id: int, n: int) -> KeyNMF:
        """Subtopics of a topic: the counts factorised again with rows weighted by the topic's documents."""
        weights = self.document_topics.where(F.col("topic_id") == topic_id)
        cells = self.counts.select("doc_id", "term", F.col("tf").cast("double").alias("x"))
        w, h, ended = factor.fit_nmf(cells, n, self.iterations, weights=weights, tol=self.tol)
        out = KeyNMF(n_topics=n, iterations=self.iterations, tol=self.tol)
        out.counts, out.cells, out.ended = self.counts, cells, ended
        return out._set(w, h)


IMPORTANCE = ("c-tf-idf", "soft-c-tf-idf", "npmi", "fighting-words", "centroid", "linear")


@dataclass
class ClusteringTopicModel(TopicModel):
    """Clusters of document vectors, described by the terms that tell them apart; labels may also be given."""

    n_clusters: int = 10
    feature_importance: str = "c-tf-idf"
    iterations: int = 10
    reduce_to: int | None = None
    reduction: str = "average"
    labels: DataFrame | None = field(default=None, init=False)
    original: DataFrame | None = field(default=None, init=False)

    def __post_init__(self):
        if self.feature_importance not in IMPORTANCE:
            raise ValueError(f"feature_importance {self.feature_importance!r} isn't one of {IMPORTANCE}")

    def fit(self, docs: DataFrame, vectors: DataFrame | None = None, labels: DataFrame | None = None, term_vectors: DataFrame | None = None) -> ClusteringTopicModel:
        counts = self._count(docs)
        if vectors is not None and term_vectors is None and self.encoder is None and self.feature_importance not in ("centroid", "linear"):
            self.vectors = self._vectors_of_documents(docs, counts, vectors, None)  # no importance that needs the terms' vectors
            same_length(self.vectors)
        else:
            self._spaces(docs, counts, vectors, term_vectors)
        if labels is None:
            unit = self.vectors.select("doc_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
            labels = cluster.lloyd(unit, cluster.first_rows(unit, self.n_clusters, "doc_id", "v", hashed=True), self.iterations, "doc_id", "v")[0]
        self.original = self.labels = settle(labels.select("doc_id", "topic_id"))
        self.estimate(self.feature_importance)
        if self.reduce_to is not None:
            self.reduce(self.reduce_to, self.reduction)
        return self

    def _centres(self) -> DataFrame:
        return similarity.centroids(self.vectors.join(self.labels, "doc_id"), "topic_id", "v")

    def estimate(self, how: str) -> None:
        """Term importance of the current labels, computed once by group-bys."""
        rows = importance.topic_counts(self._bag_of(self.counts), self.labels)
        if how in ("npmi", "fighting-words"):
            full = importance.dense(rows, self.labels, self.counts.select("term").distinct())
            out = importance.fighting_words(full) if how == "fighting-words" else importance.npmi(full, self.labels.groupBy("topic_id").agg(F.count(F.lit(1)).alias("m")))
        elif how in ("centroid", "linear"):
            if self.term_vectors is None:
                raise ValueError(f"{how} importance needs term_vectors, or an encoder, of the space of the documents' vectors")
            out = similarity.centroid_importance(self._centres(), self.term_vectors) if how == "centroid" else cluster.discriminants(self.vectors.join(self.labels, "doc_id"), self.term_vectors)
        elif how == "soft-c-tf-idf":
            out = importance.soft_ctf_idf(rows, self.labels.agg(F.count(F.lit(1)).alias("n_docs")))
        else:
            out = importance.ctf_idf(rows)
        self.feature_importance, self.topic_terms = how, settle(out)
        self.document_topics = settle(self._weigh(self.labels, self.counts, self.vectors))

    def _weigh(self, docs: DataFrame, counts: DataFrame, vectors: DataFrame | None) -> DataFrame:
        """doc_id, topic_id, weight. c-TF-IDF: cosine of a document's weighted shares of terms with the topics; centroid: cosine with the centres;
        else 1 for the fitted label, 0 for others."""
        topics = self.topic_terms.select("topic_id").distinct()
        if self.feature_importance == "centroid":
            return similarity.centroid_transform(vectors, self._centres(), "doc_id", "v")
        every = docs.select("doc_id").where("doc_id is not null").distinct().crossJoin(F.broadcast(topics))
        if self.feature_importance in ("c-tf-idf", "soft-c-tf-idf"):
            per_term = importance.topic_counts(self.counts, self.labels).groupBy("term").agg(F.sum("tf").alias("f"))
            a = self.labels.agg(F.count(F.lit(1)).alias("a")) if self.feature_importance == "soft-c-tf-idf" else per_term.agg(F.sum("f").alias("a")).crossJoin(topics.agg(F.count(F.lit(1)).alias("k"))).select(F.try_divide("a", "k").alias("a"))
            ratio = F.try_divide("a", "f")
            idf = per_term.crossJoin(F.broadcast(a)).select("term", F.log(ratio if self.feature_importance == "soft-c-tf-idf" else 1 + ratio).alias("idf"))
            found = similarity.lexical_transform(self._bag_of(counts), idf, self.topic_terms)
            return every.join(found, ["doc_id", "topic_id"], "left").select("doc_id", "topic_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))
        own = self.labels.select("doc_id", "topic_id", F.lit(1.0).alias("weight"))
        return every.join(own, ["doc_id", "topic_id"], "left").select("doc_id", "topic_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))

    def transform(self, docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """doc_id, topic_id, weight by the fitted topics; under npmi, fighting-words and linear only documents of the fit have a topic."""
        self._fitted()
        found = self._new_vectors(docs, vectors) if self.feature_importance == "centroid" else None
        return self._weigh(docs, self._known(docs, self.counts), found)

    def _by_bin(self, at: DataFrame) -> DataFrame:
        """c-TF-IDF of each bin's documents under the labels of the whole fit."""
        return timebins.importance_over_time(self.counts, self.labels, at)

    def reduce(self, to: int, method: str = "average") -> None:
        """Fewer topics by linkage of the topic rows; "smallest" joins the smallest to its nearest."""
        rows = self._centres().join(self.labels.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")), "topic_id").where("topic_id <> -1").orderBy("topic_id").collect()
        ids, v, n = [r.topic_id for r in rows], np.array([list(r.v) for r in rows], float), [r.n for r in rows]
        merges = hierarchy.smallest_linkage(range(len(ids)), v, n, to) if method == "smallest" else hierarchy.linkage(v, method)
        mapping = hierarchy.reduce_topics(range(len(ids)), merges, to)
        self.labels = settle(hierarchy.relabel(self.labels, {ids[a]: ids[b] for a, b in mapping.items()}))
        self.estimate(self.feature_importance)

    def join(self, topics: Sequence[int]) -> None:
        self.labels = settle(hierarchy.join_topics(self.labels, topics))
        self.estimate(self.feature_importance)

    def reset(self) -> None:
        self.labels = self.original
        self.estimate(self.feature_importance)


def BERTopic(n_clusters: int = 10, **knobs) -> ClusteringTopicModel:
    """Clusters described by c-TF-IDF."""
    return ClusteringTopicModel(n_clusters=n_clusters, feature_importance="c-tf-idf", **knobs)


def Top2Vec(n_clusters: int = 10, **knobs) -> ClusteringTopicModel:
    """Clusters described by their centre's nearest terms, reduced by joining the smallest."""
    return ClusteringTopicModel(n_clusters=n_clusters, feature_importance="centroid", reduction="smallest", **knobs)


@dataclass
class SemanticSignalSeparation(TopicModel):
    """Signed topics: independent components of document vectors; terms are projected on the same axes."""

    n_topics: int = 10
    iterations: int = 50
    feature_importance: str = "combined"
    components: np.ndarray | None = field(default=None, init=False)
    mean: np.ndarray | None = field(default=None, init=False)

    def fit(self, docs: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> SemanticSignalSeparation:
        self._spaces(docs, self._count(docs), vectors, term_vectors)
        return self._separate()

    def refit(self, n_topics: int | None = None, iterations: int | None = None) -> SemanticSignalSeparation:
        """Other topics of the vectors that the last fit kept."""
        self._fitted()
        self.n_topics, self.iterations, self.names = n_topics or self.n_topics, iterations or self.iterations, {}
        return self._separate()

    def _separate(self) -> SemanticSignalSeparation:
        signals, self.components, self.mean = cluster.ica(self.vectors, self.n_topics, self.iterations, key="doc_id", vector="v")
        self.document_topics = settle(signals.select("doc_id", F.posexplode("s").alias("topic_id", "weight")))
        self.topic_terms = settle(importance.axial(self.project(self.term_vectors, "term"), self.feature_importance))
        return self

    def transform(self, docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """doc_id, topic_id, weight (signed) of documents on the fitted components."""
        self._fitted()
        return self.project(self._new_vectors(docs, vectors), "doc_id").withColumnRenamed("x", "weight")

    def _by_bin(self, at: DataFrame) -> DataFrame:
        """Each bin's least squares from vectors to signals, with an intercept; the terms' vectors times the coefficients give its importance."""
        signals = self.document_topics.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_id", "weight"))), lambda s: s["weight"]).alias("y"))
        rows = self.vectors.join(at.where("bin is not null"), "doc_id").join(signals, "doc_id")
        axes = {b: m.slopes() for b, m in cluster.moments(rows, "bin").items()}
        return by_axes(self.term_vectors, axes, self.feature_importance)

    def project(self, rows: DataFrame, key: str) -> DataFrame:
        """key, topic_id, x: vectors (key, v) on the components."""
        axes = [F.aggregate(F.zip_with("v", cluster.literal(c), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) - float(c @ self.mean) for c in self.components]
        return rows.select(key, F.posexplode(F.array(*axes)).alias("topic_id", "x"))


@dataclass
class SensTopic(TopicModel):
    """Semi-non-negative factors of document vectors: non-negative weights, signed axes."""

    n_topics: int = 10
    iterations: int = 20
    sparsity: float = 0.0
    feature_importance: str = "combined"

    loadings: np.ndarray | None = field(default=None, init=False)

    def fit(self, docs: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> SensTopic:
        self._spaces(docs, self._count(docs), vectors, term_vectors)
        g, self.loadings = factor.snmf(self.vectors, self.n_topics, self.iterations, "doc_id", "v", self.sparsity)
        self.document_topics = settle(factor.long(g, "doc_id", "g", self.n_topics))
        return self._describe()

    def _describe(self) -> SensTopic:
        self.topic_terms = settle(importance.axial(factor.project(self.term_vectors, self.loadings, "term"), self.feature_importance))
        return self

    def transform(self, docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """doc_id, topic_id, weight: least-squares coordinates on the fitted axes."""
        self._fitted()
        return factor.project(self._new_vectors(docs, vectors), self.loadings, "doc_id").withColumnRenamed("x", "weight")

    def _by_bin(self, at: DataFrame) -> DataFrame:
        """Each bin's axes X'G pinv(G'G) under the fitted weights, and the terms on them."""
        weights = self.document_topics.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic_id", "weight"))), lambda s: s["weight"]).alias("y"))
        rows = self.vectors.join(at.where("bin is not null"), "doc_id").join(weights, "doc_id")
        axes = {b: factor.dual(m.xy @ np.linalg.pinv(m.yy)) for b, m in cluster.moments(rows, "bin").items()}
        return by_axes(self.term_vectors, axes, self.feature_importance)

    def partial_fit(self, docs: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None, n_new: int = 1) -> SensTopic:
        """New topics from a batch: the axes that there are stay, n_new are fitted beside them, and the batch's new words join the terms.

        document_topics are those of the batch. The first call fits.
        """
        if self.loadings is None:
            return self.fit(docs, vectors, term_vectors)
        old, known = self.counts, self.term_vectors
        self._spaces(docs, self._count(docs), vectors, term_vectors)
        same_length(known, self.term_vectors)
        self.term_vectors = settle(known.join(self.term_vectors.select("term"), "term", "left_anti").unionByName(self.term_vectors))
        self.counts = settle(old.unionByName(self.counts))
        if n_new:
            k = self.loadings.shape[1] + n_new
            _, self.loadings = factor.snmf(self.vectors, k, self.iterations, "doc_id", "v", self.sparsity, frozen=self.loadings)
            self.n_topics = k
        self.document_topics = settle(self.transform(docs, self.vectors))
        return self._describe()


@dataclass
class GMM(TopicModel):
    """A Gaussian mixture over principal components; soft c-TF-IDF describes its topics."""

    n_topics: int = 10
    dims: int = 10
    seed: int = 0

    parts: list | None = field(default=None, init=False, repr=False)

    def _features(self, vectors: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return vectors.select("doc_id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))

    def fit(self, docs: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None) -> GMM:
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.feature import PCA

        counts = self._count(docs)
        if vectors is not None:
            self.vectors = self._vectors_of_documents(docs, counts, vectors, None)
            same_length(self.vectors)
        else:
            self._spaces(docs, counts)
        self.term_vectors = self.term_vectors if self.term_vectors is not None else term_vectors
        rows = self._features(self.vectors)
        pca = PCA(k=self.dims, inputCol="f", outputCol="z").fit(rows)
        self.parts = [pca, GaussianMixture(k=self.n_topics, seed=self.seed, featuresCol="z").fit(pca.transform(rows))]
        self.document_topics = settle(self._shares(self.vectors))
        n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
        self.topic_terms = settle(importance.soft_ctf_idf(bags.soft_counts(self._bag_of(counts), self.document_topics), n_docs))
        return self

    def _shares(self, vectors: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        rows = self._features(vectors)
        for part in self.parts:
            rows = part.transform(rows)
        return rows.select("doc_id", F.posexplode(vector_to_array("probability")).alias("topic_id", "weight"))

    def transform(self, docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """doc_id, topic_id, weight: each topic's share of a document."""
        self._fitted()
        return self._shares(self._new_vectors(docs, vectors))

    def save(self, path: str) -> None:
        super().save(path)
        for name, part in zip(("reducer", "mixture"), self.parts, strict=True):
            part.write().overwrite().save(f"{path}/{name}")

    def load_tables(self, path: str, spark) -> GMM:
        from pyspark.ml.clustering import GaussianMixtureModel
        from pyspark.ml.feature import PCAModel

        super().load_tables(path, spark)
        self.parts = [PCAModel.load(f"{path}/reducer"), GaussianMixtureModel.load(f"{path}/mixture")]
        return self


def by_axes(terms: DataFrame, axes: dict[int, np.ndarray], mode: str) -> DataFrame:
    """bin, topic_id, term, weight: vectors of terms times each bin's axes (dimensions x topics), which are few."""
    parts = [importance.axial(factor.coordinates(terms, m, "term"), mode).select(F.lit(b).alias("bin"), "topic_id", "term", "weight") for b, m in sorted(axes.items())]
    out = parts[0] if parts else terms.where("false").select(F.lit(0).alias("bin"), F.lit(0).alias("topic_id"), "term", F.lit(0.0).alias("weight"))
    for p in parts[1:]:
        out = out.union(p)
    return out


S3 = SemanticSignalSeparation
