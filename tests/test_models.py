import pytest
from pyspark.sql import functions as F

from themeloom import models

WORDS = {0: "river boat water fish", 1: "piano song music dance", 2: "bread cheese soup apple"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"{WORDS[i % 3]} {WORDS[i % 3].split()[i % 4]}") for i in range(48)], "doc_id long, text string")


def test_keynmf_finds_word_groups_and_transforms(spark, docs):
    model = models.KeyNMF(n_topics=3, min_df=2, iterations=5).fit(docs)
    found = {frozenset(r.term for r in model.topics(3).where(F.col("topic_id") == k).collect()) for k in range(3)}
    assert all(any(f <= set(w.split()) for w in WORDS.values()) for f in found)
    assert model.transform(docs.limit(6)).select("doc_id").distinct().count() == 6
    with pytest.raises(RuntimeError, match="fit"):
        models.KeyNMF().topics()


def test_clusters_are_named_joined_reduced_and_reset(spark, docs, tmp_path):
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("topic_id"))
    model = models.ClusteringTopicModel(min_df=2).fit(docs, labels=labels)
    model.rename(["water", "sound", "food"])
    assert {r.name for r in model.topic_names().collect()} == {"water", "sound", "food"}
    with pytest.raises(ValueError, match="names"):
        model.rename(["one"])
    for how in models.IMPORTANCE:
        model.estimate(how)
        assert model.topic_terms.select("topic_id").distinct().count() == 3
    model.join([0, 2])
    assert model.topic_terms.select("topic_id").distinct().count() == 2
    model.reset()
    model.reduce(2, "smallest")
    assert model.labels.select("topic_id").distinct().count() == 2
    model.save(f"file://{tmp_path}/m")
    again = models.ClusteringTopicModel().load_tables(f"file://{tmp_path}/m", spark)
    assert again.names == model.names and again.table(3).count() == 2
    times = docs.select("doc_id", (F.col("doc_id") * 10).alias("us"))
    assert model.over_time(times, 3)[1].count() >= 4
    assert model.representative_documents(docs, 2).count() == 4


@pytest.mark.parametrize("make", [lambda: models.S3(n_topics=2, min_df=2, iterations=5), lambda: models.SensTopic(n_topics=2, min_df=2, iterations=3), lambda: models.GMM(n_topics=2, min_df=2, dims=3), lambda: models.Top2Vec(3, min_df=2, iterations=3)])
def test_other_models_fit(docs, make):
    model = make().fit(docs)
    assert model.topics(2).count() >= 4 and model.document_topics.select("doc_id").distinct().count() == 48
    assert model.distribution(5).count() >= 2
