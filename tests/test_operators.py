"""Invariants and edge cases of the topic operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import chunks, cluster, evaluate, factor, hierarchy, importance, naming, ranking, similarity, text, timebins
from themeloom.sources import store, tables
from themeloom.streaming import online


def test_tokens_skip_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a I"), (4, "Über den Wolken_7")], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.term) for r in text.tokens(docs).orderBy("doc_id", "pos").collect()] == [(4, 0, "über"), (4, 1, "den"), (4, 2, "wolken_7")]
    assert text.ngrams(docs, 1, 3).where("n = 3").first().term == "über den wolken_7"


def test_ngrams_run_over_what_stop_words_leave(spark):
    docs = spark.createDataFrame([(1, "rain of the day")], "doc_id long, text string")
    assert {r.term for r in text.ngrams(docs, 1, 2, stop=["of", "the"]).collect()} == {"rain", "day", "rain day"}


def test_factorize_keeps_missing_labels_apart(spark):
    got = {r.k: r.topic_id for r in text.factorize(spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k long, l string"), "k", "l").collect()}
    assert got == {1: 1, 2: -1, 3: 0}


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("adjustable", "adjust"), ("sky", "sky"), ("happy", "happi"), ("à", "à")])
def test_stems(word, want):
    from themeloom.functions.porter import stem

    assert stem(word) == want


def test_a_term_absent_from_a_bin_has_no_weight(spark):
    dtm = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "doc_id long, term string, tf long")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, topic_id int")
    bins = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, bin int")
    weights = timebins.importance_over_time(dtm, labels, bins)
    assert {(r.bin, r.topic_id, r.term) for r in weights.collect()} == {(0, 0, "a"), (1, 1, "b")}
    words = {(r.bin, r.topic_id): r.words for r in timebins.topics_over_time(weights).collect()}
    assert words[0, 1] == words[1, 0] == "Topic not present."


def test_bins_have_lower_edges_and_reject_what_lies_outside(spark):
    rows = spark.createDataFrame([(1, 0), (2, 10), (3, 19)], "doc_id long, us long")
    assert {r.doc_id: r.bin for r in timebins.bin_equal(rows, "us", 2).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r.doc_id: r.bin for r in timebins.bin_equal(rows, "us", 1).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.bin for r in timebins.bin_edges(rows, "us", [0, 10, 20]).collect()} == {1: 0, 2: 1, 3: 1}
    with pytest.raises(Exception, match="outside"):
        timebins.bin_edges(rows, "us", [0, 10, 19]).collect()
    with pytest.raises(ValueError, match="rise"):
        timebins.bin_edges(rows, "us", [3, 1])


def cells(spark, n=30, m=12, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, k)) @ rng.random((k, m)) * (rng.random((n, m)) < 0.7)
    return x, spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(n) for j in range(m) if x[i, j]], "doc_id long, term string, x double")


def test_nmf_is_non_negative_and_its_loss_falls(spark):
    x, rows = cells(spark)
    losses = []
    for steps in (1, 2):
        w, h = factor.nmf(rows, 3, steps)
        a, b = w.orderBy("doc_id").toPandas(), h.toPandas().set_index("term")
        wm, hm = a[["w0", "w1", "w2"]].to_numpy(), b.loc[[f"t{j}" for j in range(12)], ["h0", "h1", "h2"]].to_numpy().T
        assert (wm >= 0).all() and (hm >= 0).all()
        losses.append(((x - wm @ hm) ** 2).sum())
        assert factor.residual(rows, w, h, 3) == pytest.approx(losses[-1])
    assert losses[1] < losses[0]


def test_choose_n_finds_the_least_score_and_stops_at_the_low_end():
    assert factor.choose_n(lambda n: (n - 17) ** 2) == pytest.approx(17, abs=1)
    assert factor.choose_n(lambda n: n) == 2


def test_linkages_match_direct_definitions():
    x = np.random.default_rng(3).standard_normal((7, 4))
    d = hierarchy.pairwise(x, "cosine")
    for method, of in (("single", np.min), ("complete", np.max), ("average", np.mean)):
        groups = {i: [i] for i in range(7)}
        for step, (a, b, gap, n) in enumerate(hierarchy.linkage(x, method)):
            want = min(of([d[p, q] for p in groups[i] for q in groups[j]]) for i in groups for j in groups if i < j)
            assert gap == pytest.approx(want) == pytest.approx(of([d[p, q] for p in groups[a] for q in groups[b]]))
            groups[7 + step] = groups.pop(a) + groups.pop(b)
            assert len(groups[7 + step]) == n
    gaps = [g for *_, g, _ in hierarchy.linkage(x, "ward")]
    assert gaps == sorted(gaps)
    with pytest.raises(ValueError, match="unknown"):
        hierarchy.linkage(x, "none")


def test_smallest_linkage_leaves_outliers_out_and_reduction_takes_least_ids():
    v = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9], [5, 5]])
    merges = hierarchy.smallest_linkage([0, 1, 2, 3, -1], v, [5, 1, 6, 2, 9], 2)
    assert [m[:2] for m in merges] == [(1, 0), (3, 2)] and [m[3] for m in merges] == [6, 8]
    assert hierarchy.reduce_topics([0, 1, 2, 3, -1], merges, 2) == {0: 0, 1: 0, 2: 2, 3: 2}
    with pytest.warns(UserWarning, match="already"):
        assert hierarchy.reduce_topics([0, 1], [], 5) == {0: 0, 1: 1}


def test_join_topics_takes_the_least_id(spark):
    labels = spark.createDataFrame([(i, i) for i in range(5)], "doc_id long, topic_id int")
    assert {r.topic_id for r in hierarchy.join_topics(labels, [0, 1, 2]).collect()} == {0, 3, 4}
    with pytest.raises(ValueError, match="different"):
        hierarchy.join_topics(labels, [1, 1])


def test_flatten_renumbers_leaves_and_keeps_the_outlier(spark):
    labels = spark.createDataFrame([(1, 2), (2, -1), (3, 5)], "doc_id long, topic_id int")
    assert sorted(r.topic_id for r in hierarchy.flatten(hierarchy.create_root(labels)).collect()) == [-1, 0, 1]


def test_zero_vectors_have_cosine_zero_and_metrics_are_named(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 2.0])], "topic_id int, v array<double>")
    got = {(r.a_id, r.b_id): r for r in similarity.distances(rows, list(similarity.METRICS)).collect()}
    assert got[0, 1].cosine == 1 and got[1, 2].euclidean == got[1, 2].l2 == pytest.approx(np.hypot(3, 2)) and got[1, 2].cityblock == 5
    with pytest.raises(ValueError, match="unknown"):
        similarity.distances(rows, ["nope"])


def test_keywords_keep_every_positive_term_of_short_documents(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (2, "b", -0.5), (3, "c", 0.2), (3, "d", 0.2)], "doc_id long, term string, sim double")
    assert sorted((r.doc_id, r.term, r.rank) for r in similarity.keywords(scores, 5).collect()) == [(1, "a", 1), (3, "c", 1), (3, "d", 2)]


def test_multimodal_takes_what_is_there(spark):
    rows = spark.createDataFrame([([1.0], [3.0]), ([1.0], None), (None, None)], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(similarity.multimodal("a", "b")).collect()] == [[2.0], [1.0], None]


def test_components_of_terms_take_three_names(spark):
    nodes = spark.createDataFrame([(t,) for t in "abcdex"], "term string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "e")], "a string, b string")
    got = {r.term: (r.root, r.name) for r in similarity.merge_terms(pairs, nodes).collect()}
    assert got["e"] == ("a", "a-b-c") and got["x"] == ("x", "x")


def test_kmeans_settles_on_separate_clusters_and_ica_finds_sources(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (-3, 0, 3)])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    labels, _ = cluster.lloyd(rows, x[[0, 40, 80]], 5)
    assert [r.topic_id for r in labels.orderBy("vec_id").collect()] == [0] * 30 + [1] * 30 + [2] * 30
    s = rng.uniform(-1, 1, (400, 2))
    mixed = s @ np.array([[1.0, 0.5], [0.3, 1.0]])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(mixed)], "vec_id long, embedding array<double>")
    signals, unmix, _ = cluster.ica(rows, 2, 30)
    found = np.array([r.s for r in signals.orderBy("vec_id").collect()])
    corr = np.abs(np.corrcoef(found.T, s.T)[:2, 2:])
    assert corr.max(0) == pytest.approx(1, abs=0.05) and unmix.shape == (2, 2)


def test_fixed_means_and_sinkhorn_margins(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(-2, 0.3, (50, 2)), rng.normal(2, 0.5, (150, 2))])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    got, weights, _ = cluster.fixed_mean_mixture(rows, np.array([[-2, -2], [2, 2]]), np.array([0.5, 0.5]), 8)
    assert weights == pytest.approx([0.25, 0.75], abs=0.01) and got.where(F.abs(F.col("r0") + F.col("r1") - 1) > 1e-9).isEmpty()
    peaks = cluster.peaks(cluster.density_grid(rows.select("x", "y"), 30)).count()
    assert peaks >= 2
    costs = spark.createDataFrame([(i, j, abs(i - j) / 3) for i in range(3) for j in range(4)], "a_id int, b_id int, m double")
    plan = cluster.sinkhorn(costs, 3.0, 30)
    assert [r[1] for r in plan.groupBy("b_id").agg(F.sum("plan")).collect()] == pytest.approx([0.25] * 4, abs=1e-3)


def test_semi_nmf_rebuilds_better_with_steps(spark):
    rng = np.random.default_rng(5)
    x = np.abs(rng.random((40, 2))) @ rng.standard_normal((2, 6))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    errors = []
    for steps in (0, 3):
        g, f = factor.snmf(rows, 2, steps)
        gm = g.orderBy("vec_id").toPandas()[["g0", "g1"]].to_numpy()
        assert (gm >= 0).all()
        errors.append(np.linalg.norm(x - gm @ f.T))
    assert errors[1] < errors[0]


def test_two_classes_and_decay_and_export(spark):
    soft = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.1), (2, 1, 0.9)], "doc_id long, topic_id int, weight double")
    assert {r.doc_id: r.topic_id for r in ranking.argmax_label(soft).collect()} == {1: 0, 2: 1}
    assert [r.median for r in ranking.decay(soft).orderBy("rank").collect()] == pytest.approx([0.7, 0.3])
    table = spark.createDataFrame([(1, 'say "x"')], "id int, t string")
    assert [r.line for r in ranking.export_table(table, ["id"], "csv").orderBy("line_no").collect()] == ['"id","t"', '1,"say ""x"""']
    with pytest.raises(ValueError, match="isn't"):
        ranking.export_table(table, ["id"], "html")


def test_names_can_be_generated_and_overridden(spark):
    weights = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.0), (-1, "c", 1.0)], "topic_id int, term string, weight double")
    other = spark.createDataFrame([(0, "Mine")], "topic_id int, name string")
    assert {r.topic_id: r.name for r in ranking.topic_names(weights, 2, other).collect()} == {0: "Mine", -1: "-1_c"}
    got = {r.topic_id: r.name for r in naming.analyze(weights, lambda ps: [p.rsplit(": ", 1)[1] for p in ps]).collect()}
    assert got == {0: "a, b", -1: "Outliers"}
    signed = spark.createDataFrame([(0, "a", 2.0), (0, "b", -1.0)], "topic_id int, term string, weight double")
    assert naming.signed_names(signed, 1).first().name == "A/B"


def test_windows_may_be_short_at_the_end_and_pooling_skips_nan(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(9))), (2, "")], "doc_id long, text string")
    assert [(r.chunk, r.n) for r in chunks.windows(docs, 4, 4).orderBy("chunk").collect()] == [(0, 4), (4, 4), (8, 1)]
    rows = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, float("nan"))], "doc_id long, chunk int, topic_id int, weight double")
    assert chunks.pool(rows).first().weight == 1 and chunks.pool(rows, F.max).first().weight == 1


def test_agreement_of_equal_labels_is_one(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "t string, f string")
    r = evaluate.agreement(rows, "t", "f").first()
    assert (r.fmi, r.homogeneity, r.completeness) == pytest.approx((1, 1, 1))


def test_importance_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 2}", "en" if i % 2 else "de") for i in range(24)], "doc_id long, text string, lang string")
    out = []
    for n in (1, 3):
        part = docs.repartition(n)
        rows = importance.ctf_idf(importance.topic_counts(text.fit_terms(part, min_df=2), tables.language_topics(part)))
        out.append(sorted((r.topic_id, r.term, round(r.weight, 9)) for r in rows.collect()))
    assert out[0] == out[1] and out[0]


def test_store_and_sources(spark, tmp_path):
    store.save(f"file://{tmp_path}/m", spark, {"t": spark.range(3)}, {"k": 2})
    got, params = store.load(f"file://{tmp_path}/m", spark)
    assert got["t"].count() == 3 and params == {"k": 2}
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert tables.read_corpus(spark, f"file://{tmp_path}/a.txt", "text").count() == 2
    with pytest.raises(ValueError, match="format"):
        tables.read_corpus(spark, "x", "avro")


def test_stream_of_batches_extends_the_vocabulary(spark, tmp_path):
    schema = "doc_id long, text string"
    src = f"file://{tmp_path}/src"
    spark.createDataFrame([(1, "red green"), (2, "red blue")], schema).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)
    online.fit_stream(read(), f"file://{tmp_path}/h", 2).awaitTermination()
    spark.createDataFrame([(3, "violet red")], schema).write.mode("append").parquet(src)
    online.fit_stream(read(), f"file://{tmp_path}/h", 2).awaitTermination()
    h = online.latest(spark, f"file://{tmp_path}/h", 99, 2)
    assert {r.term for r in h.collect()} == {"red", "green", "blue", "violet"} and h.where("h0 < 0 or h1 < 0").isEmpty()


def test_event_time_windows_in_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    q = online.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count() == online.sessions(events).agg(F.sum("n")).first()[0]
