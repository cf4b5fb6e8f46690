"""Queries of topic trees, naming, retrieval, persistence and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from themeloom.functions import r6
from themeloom.operators import bags, hierarchy, importance, ranking, similarity
from themeloom.plans.register import query
from themeloom.plans.sql import r6 as q6
from themeloom.plans.sql import with_
from themeloom.sources import store, tables
from themeloom.sources.store import settle
from themeloom.sources.tables import corpus, table
from themeloom.streaming import online


def _labels(spark, sf):
    return tables.language_topics(corpus(spark, sf))


def _tree(spark, sf):
    """Root, languages, and below each language its documents' thirds."""
    labels = _labels(spark, sf)
    sub = labels.groupBy("topic_id", (F.col("doc_id") % 3).cast("int").alias("sub_id")).agg(F.count(F.lit(1)).alias("n"))
    return hierarchy.divide(hierarchy.create_root(labels), sub)


_TREE = dict(
    sizes="SELECT topic_id, count(*) AS n FROM lab GROUP BY topic_id",
    subs="SELECT topic_id, CAST(doc_id % 3 AS INTEGER) AS sub_id, count(*) AS n FROM lab GROUP BY ALL",
    tree="SELECT '' AS path, 0 AS level, (SELECT count(*) FROM lab) AS n, NULL AS topic_id UNION ALL SELECT CAST(topic_id AS VARCHAR), 1, n, topic_id FROM sizes UNION ALL SELECT topic_id || '.' || sub_id, 2, n, sub_id FROM subs",
)


def _dotted():
    return F.array_join(F.transform("path", lambda x: x.cast("string")), ".")


@query(with_("SELECT path, level, n FROM tree WHERE level <= 1", **_TREE))
def create_root(spark, sf):
    return hierarchy.create_root(_labels(spark, sf)).select(_dotted().alias("path"), "level", "n")


@query(with_("SELECT path, level, n FROM tree", **_TREE))
def divide_topics(spark, sf):
    return _tree(spark, sf).select(_dotted().alias("path"), "level", "n")


@query(with_("SELECT path, level, n FROM tree WHERE level <= 1", **_TREE))
def cut_tree(spark, sf):
    return hierarchy.cut(_tree(spark, sf), 1).select(_dotted().alias("path"), "level", "n")


@query(with_("SELECT path, n FROM tree WHERE level = 2", **_TREE))
def collect_leaves(spark, sf):
    return hierarchy.leaves(_tree(spark, sf)).select(_dotted().alias("path"), "n")


@query(with_("SELECT path, CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS topic_id FROM tree WHERE level = 2", **_TREE))
def flatten_tree(spark, sf):
    return hierarchy.flatten(_tree(spark, sf)).select(_dotted().alias("path"), "topic_id")


@query(with_("SELECT repeat('  ', level) || CASE WHEN level = 0 THEN 'Root' ELSE path END || ' (' || n || ')' AS line FROM tree", **_TREE))
def print_tree(spark, sf):
    return hierarchy.lines(_tree(spark, sf)).select("line")


_JOINED = dict(
    lab2="SELECT doc_id, CASE WHEN topic_id IN (1, 2) THEN 1 ELSE topic_id END AS topic_id FROM lab",
    tt2="SELECT topic_id, term, CAST(sum(tf) AS BIGINT) AS tf FROM dtm JOIN lab2 USING (doc_id) GROUP BY ALL",
)


@query(with_(f"SELECT topic_id, term, {q6('tf * ln(1 + (sum(tf) OVER () / CAST((SELECT count(DISTINCT topic_id) FROM lab2) AS DOUBLE)) / sum(tf) OVER (PARTITION BY term))')} AS weight FROM tt2", **_JOINED))
def join_topics(spark, sf):
    docs = corpus(spark, sf)
    labels = hierarchy.join_topics(tables.language_topics(docs), [1, 2])
    return importance.ctf_idf(importance.topic_counts(tables.dtm(docs), labels)).select("topic_id", "term", r6("weight").alias("weight"))


def _topic_rows(spark, sf):
    """The few topic rows that linkage works on: ids, centres, sizes."""
    rows = table(spark, sf, "embeddings")
    means = similarity.centroids(rows).join(rows.groupBy(F.col("label").alias("topic_id")).agg(F.count(F.lit(1)).alias("n")), "topic_id").orderBy("topic_id").collect()
    return [r.topic_id for r in means], np.array([list(r.v) for r in means]), [r.n for r in means]


@query()
def smallest_linkage(spark, sf):
    ids, v, n = _topic_rows(spark, sf)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(hierarchy.smallest_linkage(ids, v, n, 3))], "step int, smallest int, nearest int, distance double, n long")


@query()
def linkages(spark, sf):
    _, v, _ = _topic_rows(spark, sf)
    return spark.createDataFrame([(m, i, *x) for m in hierarchy.LINKAGES for i, x in enumerate(hierarchy.linkage(v, m))], "method string, step int, a int, b int, distance double, n long")


@query()
def reduce_topics(spark, sf):
    ids, v, _ = _topic_rows(spark, sf)
    mapping = hierarchy.reduce_topics(ids, hierarchy.linkage(v, "average"), 4)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic_id"))
    return hierarchy.relabel(labels, mapping)


@query(with_("SELECT doc_id, topic_id FROM lab"))
def reset_topics(spark, sf):
    """Joined labels beside the original ones, which come back."""
    labels = _labels(spark, sf)
    joined = hierarchy.join_topics(labels, [0, 3]).withColumnRenamed("topic_id", "joined")
    return joined.join(labels, "doc_id").select("doc_id", "topic_id")


_NAMES = "SELECT topic_id, topic_id || '_' || string_agg(term, '_' ORDER BY rank) AS name, string_agg(term, ', ' ORDER BY rank) AS words FROM (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM cwr) WHERE rank <= 4 GROUP BY topic_id"


@query(with_("SELECT topic_id, 'Name this topic. Its keywords are: ' || words AS prompt FROM (" + _NAMES + ")"))
def analyzer_prompts(spark, sf):
    """Prompts that a text generator would be given, a topic a row."""
    from themeloom.operators.naming import prompts

    weights = importance.ctf_idf(tables.topic_terms(corpus(spark, sf))).withColumn("weight", r6("weight"))
    return prompts(weights, 4)


@query(with_("SELECT topic_id, array_to_string(list_transform(string_split(words, ', ')[1:2], lambda w: upper(w[1]) || w[2:]), ' and ') AS name FROM (" + _NAMES + ")"))
def analyze_topics(spark, sf):
    from themeloom.operators.naming import analyze

    weights = importance.ctf_idf(tables.topic_terms(corpus(spark, sf))).withColumn("weight", r6("weight"))
    return analyze(weights)


@query(
    with_(
        "SELECT d.doc_id, rank, round(score, 6) + 0.0 AS score FROM (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (SELECT doc_id, sum(w.weight * tf) AS score FROM dtm JOIN w USING (term) GROUP BY doc_id)) d WHERE rank <= 20",
        qt="SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM benchmark WHERE item_id = 0",
        qs="SELECT topic_id, sum(weight) AS s FROM cwr JOIN qt USING (term) GROUP BY topic_id",
        best="SELECT arg_max(topic_id, round(s, 3)) AS topic_id FROM qs",
        w="SELECT term, weight FROM cwr JOIN best USING (topic_id)",
    )
)
def topic_retrieval(spark, sf):
    """A query text's best topic, and the documents that weigh most under it."""
    from themeloom.operators import text

    docs = corpus(spark, sf)
    found = bags.bags(docs, 10)
    weights = settle(importance.ctf_idf(importance.topic_counts(found, tables.language_topics(docs))).withColumn("weight", r6("weight")))
    asked = text.tokens(table(spark, sf, "benchmark").where("item_id = 0").withColumnRenamed("item_id", "doc_id")).select("term")
    best = weights.join(F.broadcast(asked), "term").groupBy("topic_id").agg(F.round(F.sum("weight"), 3).alias("s")).agg(F.max_by("topic_id", "s").alias("topic_id"))
    scores = bags.weighted(found, weights.join(F.broadcast(best), "topic_id")).select("doc_id", r6("p").alias("score"))
    return ranking.top(scores.withColumn("one", F.lit(1)), ["one"], "score", "doc_id", 20).select("doc_id", F.col("rank").cast("long").alias("rank"), "score")


@query(with_("SELECT topic_id, term, tf FROM tt"))
def store_round_trip(spark, sf):
    path = f"{store.shared_folder(spark)}/model-{uuid.uuid4().hex}"
    store.save(path, spark, {"topic_terms": tables.topic_terms(corpus(spark, sf))}, {"top_n": 10})
    return store.load(path, spark)[0]["topic_terms"]


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def source_json(spark, sf):
    path = f"{store.shared_folder(spark)}/json-{uuid.uuid4().hex}"
    corpus(spark, sf).select("doc_id", "text").write.json(path)
    return tables.read_corpus(spark, path, "json").select("doc_id", F.md5("text").alias("digest"))


@query()
def keynmf_partial_fit(spark, sf):
    """Topics after two micro-batches of the documents."""
    counts = tables.dtm(corpus(spark, sf), 20).select("doc_id", "term", F.col("tf").cast("double").alias("x"))
    h = online.online_step(None, counts.where("doc_id % 2 = 0"), 3)
    h = online.online_step(h, counts.where("doc_id % 2 = 1"), 3)
    return h.select("term", F.posexplode(F.array("h0", "h1", "h2")).alias("topic_id", "weight"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return online.windowed(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return online.sessions(rows).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
