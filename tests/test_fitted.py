"""Fitted models against numpy, edges of the operators, and what a user may pass in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom import models
from themeloom.operators import cluster, factor, importance, ranking

WORDS = {0: "river boat water fish", 1: "piano song music dance", 2: "bread cheese soup apple"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{WORDS[i % 3]} {WORDS[i % 3].split()[i % 4]}") for i in range(30)]
    return spark.createDataFrame([*rows, (30, None), (31, ""), (None, "river boat")], "doc_id long, text string")


@pytest.fixture(scope="module")
def spaces(spark):
    rng = np.random.default_rng(1)
    v = {i: rng.normal(size=6) + 3 * np.eye(6)[i % 3] for i in range(30)}
    t = {w: rng.normal(size=6) for ws in WORDS.values() for w in ws.split()}
    make = lambda rows, key: spark.createDataFrame([(k, [float(x) for x in a]) for k, a in rows.items()], f"{key}, v array<double>")
    return v, t, make(v, "doc_id long"), make(t, "term string")


def weights(df, key="doc_id"):
    return {(r[key], r.topic_id): r.weight for r in df.collect()}


def test_nmf_descends_to_the_least_squares_of_each_side(spark):
    rng = np.random.default_rng(0)
    x = rng.random((20, 3)) @ rng.random((3, 8)) * (rng.random((20, 8)) < 0.8)
    cells = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(20) for j in range(8) if x[i, j]], "doc_id long, term string, x double")
    w, h, ended = factor.fit_nmf(cells, 3, 60, tol=1e-3)
    a = np.array([list(r)[1:] for r in w.orderBy("doc_id").collect()])
    b = np.array([list(r)[1:] for r in h.orderBy("term").collect()])
    assert ended.converged and ended.error == pytest.approx(((x - a @ b.T) ** 2).sum(), rel=1e-6)
    again = np.array([list(r)[1:] for r in factor.solve_rows(cells, cells.select("doc_id"), h, 3).orderBy("doc_id").collect()])
    slope = again @ (b.T @ b) - x @ b  # the conditions of a non-negative least-squares minimum
    assert (slope > -1e-6).all() and np.abs(slope * again).max() < 1e-6
    assert factor.fit_nmf(cells.where("false"), 3)[2].converged


def test_keynmf_transforms_every_document_and_solves_bins(spark, docs):
    model = models.KeyNMF(n_topics=3, min_df=2).fit(docs)
    got = weights(model.transform(docs))
    assert {i for i, _ in got} == set(range(32)) and all(got[30, k] == got[31, k] == 0 for k in range(3))
    want = weights(model.document_topics)
    assert all(got[k] == pytest.approx(want[k], abs=0.05) for k in want)
    times = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") * 10).alias("us"))
    found = model.over_time(times, 2)[0]
    assert {r.bin for r in found.select("bin").distinct().collect()} == {0, 1} and found.where("weight < 0").count() == 0
    edges = [0, 150, 1000]
    online = models.KeyNMF(n_topics=3)
    for part in (0, 1):
        some = docs.where(F.col("doc_id") % 2 == part)
        online.partial_fit_dynamic(some, times.join(some.select("doc_id"), "doc_id"), edges)
    assert online.temporal_factor.select("bin").distinct().count() == 2 and online.term_factor.count() == 12


def test_vectors_need_terms_of_their_space(docs, spaces):
    _, _, v, t = spaces
    for model in (models.S3(n_topics=2, min_df=2), models.SensTopic(n_topics=2, min_df=2), models.Top2Vec(2, min_df=2)):
        with pytest.raises(ValueError, match="term_vectors|encoder"):
            model.fit(docs, v)
    with pytest.raises(ValueError, match="dimensions"):
        models.S3(n_topics=2, min_df=2).fit(docs, v, t.select("term", F.slice("v", 1, 5).alias("v")))


def test_s3_transform_over_time_refit_and_save(spark, docs, spaces, tmp_path):
    v, t, dv, dt = spaces
    model = models.S3(n_topics=2, min_df=2, iterations=30, feature_importance="axial").fit(docs, dv, dt)
    got, want = weights(model.transform(docs, dv)), weights(model.document_topics)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want) and None not in want.values()
    times = docs.where("doc_id < 30").select("doc_id", F.col("doc_id").alias("us"))
    found = {(r.bin, r.topic_id, r.term): r.weight for r in model.over_time(times, 2)[0].collect()}
    for b in (0, 1):
        ids = range(15 * b, 15 * b + 15)
        x, y = np.array([v[i] for i in ids]), np.array([[want[i, k] for k in (0, 1)] for i in ids])
        coef = np.linalg.lstsq(x - x.mean(0), y - y.mean(0), rcond=None)[0]
        assert all(found[b, k, w] == pytest.approx(float(t[w] @ coef[:, k]), abs=1e-6) for w in t for k in (0, 1))
    model.save(f"file://{tmp_path}/s3")
    again = models.S3().load_tables(f"file://{tmp_path}/s3", spark)
    assert weights(again.transform(docs, dv)) == pytest.approx(got) and again.n_topics == 2
    assert model.refit(3).topic_terms.select("topic_id").distinct().count() == 3


def test_senstopic_transform_over_time_and_new_topics(docs, spaces):
    v, t, dv, dt = spaces
    model = models.SensTopic(n_topics=2, min_df=2, iterations=5, feature_importance="axial").fit(docs, dv, dt)
    f = model.loadings
    got = weights(model.transform(docs, dv))
    for i in v:
        assert np.allclose([got[i, k] for k in (0, 1)], v[i] @ f @ np.linalg.pinv(f.T @ f), atol=1e-9)
    g = weights(model.document_topics)
    times = docs.where("doc_id < 30").select("doc_id", F.col("doc_id").alias("us"))
    found = {(r.bin, r.topic_id, r.term): r.weight for r in model.over_time(times, 2)[0].collect()}
    for b in (0, 1):
        ids = range(15 * b, 15 * b + 15)
        x, y = np.array([v[i] for i in ids]), np.array([[g[i, k] for k in (0, 1)] for i in ids])
        axes = x.T @ y @ np.linalg.pinv(y.T @ y)
        axes = axes @ np.linalg.pinv(axes.T @ axes)
        assert all(found[b, k, w] == pytest.approx(float(t[w] @ axes[:, k]), rel=1e-5, abs=1e-6) for w in t for k in (0, 1))
    model.partial_fit(docs, dv, dt)
    assert model.n_topics == 3 and np.allclose(model.loadings[:, :2], f)


def test_clusters_and_mixtures_weigh_new_documents_and_images(spark, docs, spaces, tmp_path):
    _, _, dv, dt = spaces
    labels = docs.where("doc_id < 30").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("topic_id"))
    model = models.ClusteringTopicModel(min_df=2).fit(docs, labels=labels)
    best = {r.doc_id: r.topic_id for r in ranking.argmax_label(model.transform(docs.where("doc_id < 30"))).collect()}
    assert best == {i: i % 3 for i in range(30)}
    images = dv.withColumn("v", F.when(F.col("doc_id") % 7 != 0, F.col("v")))
    for m in (models.ClusteringTopicModel(n_clusters=3, min_df=2, feature_importance="centroid"), models.GMM(n_topics=2, dims=3, min_df=2)):
        m.fit_multimodal(docs, images, dv, dt)
        assert {r.doc_id for r in m.image_topics.select("doc_id").distinct().collect()} == {i for i in range(30) if i % 7}
        assert m.top_images(2).count() >= 4
    m.save(f"file://{tmp_path}/gmm")
    again = models.GMM().load_tables(f"file://{tmp_path}/gmm", spark)
    assert weights(again.transform(docs, dv)) == pytest.approx(weights(m.document_topics))


def test_a_tokenizer_replaces_the_words(docs):
    split = lambda d: d.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "term")).withColumn("term", F.upper("term"))
    model = models.KeyNMF(n_topics=3, min_df=2, tokenizer=split).fit(docs)
    assert {r.term for r in model.topic_terms.select("term").distinct().collect()} == {w.upper() for ws in WORDS.values() for w in ws.split()}


def test_edges_of_sums_and_empty_tables(spark):
    soft = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 3.0)], "doc_id long, topic_id int, weight double")
    assert sorted(tuple(r) for r in ranking.decay(soft).select("rank", "median").collect()) == [(1, 0.375), (2, 0.125)]
    flat = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert cluster.density_grid(flat, 5).where("z <> 0").count() == 0 and cluster.density_grid(flat.where("false"), 5).count() == 0
    one = spark.createDataFrame([(0, "a", 3)], "topic_id int, term string, tf long")
    assert importance.npmi(one, spark.createDataFrame([(0, 1)], "topic_id int, m long")).first().weight == 0
    rows = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert cluster.ica(rows, 2)[0].count() == 0 and cluster.lloyd(rows, cluster.first_rows(rows, 2))[0].count() == 0
    assert importance.bm25(spark.createDataFrame([], "doc_id long, term string, tf long")).count() == 0
