import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = np.mean([(r.good >= 0.5) == (r.quality == 1) for r in rows])
    clean_kept = np.mean([r.kept for r in rows if r.quality == 1 and r.toxic == 0])
    assert len(rows) > 100 and good > 0.95 and clean_kept > 0.95


def test_vote_is_exact_nearest_neighbours():
    rng = np.random.default_rng(0)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    model = quality.Model(np.zeros(1), np.zeros((1, 8)), unit(rng.standard_normal((300, 8))), rng.integers(0, 2, 300).astype(float), rng.integers(0, 2, 300).astype(float), (1.0, 0.0))
    asked = unit(rng.standard_normal((70, 8)))
    got = model.vote(asked, 9, block=16)
    for i, v in enumerate(asked):
        cosine = model.vectors @ v
        near = np.argsort(-cosine)[:9]
        w = np.maximum(cosine[near], 0)
        assert got[0][i] == pytest.approx((w * model.good[near]).sum() / w.sum(), abs=1e-5)
        assert got[1][i] == pytest.approx((w * model.toxic[near]).sum() / w.sum(), abs=1e-5)


def test_the_bound_holds_and_worst_labels_count(spark, make_docs):
    rows = [(i, "fine words here and there" if i % 2 else "junk junk junk junk !!") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1, 0, 1), (None, 1, 0), (3, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(make_docs(rows), labels, sample=50)
    assert len(model.vectors) <= 50
    got = {r.doc_id: r.kept for r in quality.score(make_docs(rows), model).collect()}
    assert sum(got[i] == bool(i % 2) for i in got) >= 198


def test_edges(spark, make_docs, edges):
    docs = make_docs(edges)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = quality.fit(docs, labels)
        rows = quality.score(docs, model).collect()
        assert len(rows) == len(edges)
        assert all(r.kept for r in rows if r.doc_id in (1, 2, 3, 4))
        kept = quality.drop_rejected(docs, model)
        assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in rows)
        assert quality.score(make_docs([]), model).count() == 0
    assert quality.score(docs, quality.fit(make_docs([]), some)).where(~F.col("kept")).count() == 0


def test_ties_at_the_border_all_vote_in_any_order():
    rng = np.random.default_rng(0)
    near, far = rng.standard_normal((2, 64)).astype(np.float32)
    vectors = np.stack([near] * 6 + [far] * 3)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    good = np.array([1, 0, 0, 1, 1, 1, 0, 0, 0], float)
    shares = []
    for order in (np.arange(9), np.arange(9)[::-1]):
        model = quality.Model(np.zeros(0), np.zeros((0, 64)), vectors[order], good[order], 1 - good[order], (1.0, 0.0))
        shares.append(model.vote(vectors[:1], 3))
    assert shares[0][0] == pytest.approx(shares[1][0]) == pytest.approx(4 / 6) and shares[0][1] == pytest.approx(2 / 6)


def test_repeated_rows_do_not_enlarge_the_sample(spark, make_docs):
    rows = [(i, f"{'fine prose here' if i % 2 else 'junk junk junk'} {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    once, often = (quality.fit(make_docs(rows * n), labels, sample=40) for n in (1, 4))
    assert len(once.good) <= 40 and (once.vectors == often.vectors).all() and (once.good == often.good).all()
