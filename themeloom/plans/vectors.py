"""Queries of similarities, keywords, centroids, concepts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions import hash_vector, r6
from themeloom.operators import bags, evaluate, importance, similarity
from themeloom.plans.register import query
from themeloom.plans.sql import r6 as q6
from themeloom.plans.sql import with_
from themeloom.sources import tables
from themeloom.sources.store import settle
from themeloom.sources.tables import corpus, table


def _spaces(spark, sf):
    """Counts, term vectors and document vectors in the hash encoder's space."""
    found = bags.bags(corpus(spark, sf), 10)
    return bags.cells(found), tables.term_vectors(bags.names(found)), bags.vectors(found)


_NORMS = dict(
    tn="SELECT term, CAST(list_sum(list_transform(v, lambda x: x * x)) AS DOUBLE) AS n FROM tv",
    dn="SELECT doc_id, CAST(list_sum(list_transform(v, lambda x: x * x)) AS DOUBLE) AS n FROM dv",
    sims="SELECT d.doc_id, d.term, CAST(list_sum(list_transform(list_zip(tv.v, dv.v), lambda p: p[1] * p[2])) AS DOUBLE) / (sqrt(tn.n) * sqrt(dn.n)) AS sim FROM dtm d JOIN tv USING (term) JOIN tn USING (term) JOIN dv ON dv.doc_id = d.doc_id JOIN dn ON dn.doc_id = d.doc_id WHERE tn.n > 0 AND dn.n > 0",
    kw="SELECT doc_id, term, sim, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, term) AS rank FROM (SELECT doc_id, term, round(sim, 6) + 0.0 AS sim FROM sims) WHERE sim > 0",
)


@query(with_("SELECT doc_id, term, sim, rank FROM kw WHERE rank <= 10", **_NORMS))
def keyword_extract(spark, sf):
    return similarity.keywords(bags.scores(bags.bags(corpus(spark, sf), 10), 10), 10).withColumn("rank", F.col("rank").cast("long"))


_SEED = "list_transform(range(1, 33), lambda i: instr('0123456789abcdef', substr(md5('shonha'), i, 1)) * 2 - 17)"


@query(
    with_(
        f"SELECT doc_id, term, {q6('sim * pow(greatest(0.0, near), 2.0)')} AS sim FROM sims JOIN nr USING (doc_id)",
        nr=f"SELECT doc_id, CAST(list_sum(list_transform(list_zip(v, {_SEED}), lambda p: p[1] * p[2])) AS DOUBLE) / (sqrt(n) * sqrt(CAST(list_sum(list_transform({_SEED}, lambda x: x * x)) AS DOUBLE))) AS near FROM dv JOIN dn USING (doc_id)",
        **_NORMS,
    )
)
def seed_relevance(spark, sf):
    rows = bags.scores(bags.bags(corpus(spark, sf), 10), seed="shonha")
    return rows.select("doc_id", "term", r6(F.col("sim") * F.pow(F.greatest(F.lit(0.0), "near"), F.lit(2.0))).alias("sim"))


_MATCH = dict(
    nodes="SELECT term, v FROM tv",
    edges="SELECT a.term AS a, b.term AS b FROM nodes a JOIN nodes b ON a.term <> b.term WHERE round(CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS DOUBLE) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 6) >= 0.45",
)


@query("WITH RECURSIVE " + with_("SELECT n.term, min(r.b) AS root FROM nodes n JOIN reach r ON r.a = n.term GROUP BY n.term", reach="SELECT term AS a, term AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b", **_MATCH).removeprefix("WITH ").replace("reach AS MATERIALIZED", "reach AS"))
def term_match(spark, sf):
    """Components of terms whose vectors' cosine is 0.45 or more; an equal vector is a chance here, a translation in a shared space."""
    return similarity.alike(bags.frequent(bags.counted(corpus(spark, sf)), 10))


_CEN = "SELECT topic_id, list(x ORDER BY i) AS v FROM cen GROUP BY topic_id"


@query(with_(f"SELECT topic_id, i, {q6('x')} AS x FROM cen"))
def centroids(spark, sf):
    means = similarity.centroids(table(spark, sf, "embeddings"))
    return means.select("topic_id", F.posexplode("v").alias("i", "x")).select("topic_id", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


_DOC_CEN = dict(dc="SELECT topic_id, i, avg(CAST(x AS DOUBLE)) AS x FROM dvx JOIN lab USING (doc_id) GROUP BY ALL")
_COS = "sum(c.x * t.x) / (sqrt(sum(c.x * c.x)) * sqrt(sum(CAST(t.x * t.x AS DOUBLE))))"


@query(with_(f"SELECT c.topic_id, t.term, {q6(_COS)} AS weight FROM dc c JOIN tvx t ON t.i = c.i GROUP BY ALL", **_DOC_CEN))
def centroid_importance(spark, sf):
    _, terms, docs = _spaces(spark, sf)
    labelled = docs.join(tables.language_topics(corpus(spark, sf)), "doc_id")
    means = similarity.centroids(labelled, "topic_id", "v")
    return similarity.centroid_importance(means, terms).select("topic_id", "term", r6("weight").alias("weight"))


@query(
    with_(
        f"SELECT topic_id, term, {q6('sqrt((1 + n.weight) / 2 * ((1 + c.weight) / 2))')} AS weight FROM nw n JOIN cc c USING (topic_id, term)",
        nw="SELECT topic_id, term, (log2(p_wt) - log2(p_w)) / -(log2(p_wt) + log2(p_t)) AS weight FROM (SELECT f.topic_id, f.term, (tf + 5) / sum(tf + 5.0) OVER (PARTITION BY f.topic_id) AS p_wt, (cf + 5) / (SELECT sum(cf + 5.0) FROM voc) AS p_w, p_t FROM fulltt f JOIN voc USING (term) JOIN pt USING (topic_id))",
        pt="SELECT topic_id, (n + 5) / sum(n + 5.0) OVER () AS p_t FROM (SELECT topic_id, count(*) AS n FROM lab GROUP BY topic_id)",
        cc=f"SELECT c.topic_id, t.term, {_COS} AS weight FROM dc c JOIN tvx t ON t.i = c.i GROUP BY ALL",
        **_DOC_CEN,
    )
)
def combined_importance(spark, sf):
    docs = corpus(spark, sf)
    found = bags.bags(docs, 10)
    terms, vectors = tables.term_vectors(bags.names(found)), bags.vectors(found)
    labels = tables.language_topics(docs)
    full = settle(importance.dense(importance.topic_counts(found, labels), labels, bags.names(found)))
    npmi = importance.npmi(full, labels.groupBy("topic_id").agg(F.count(F.lit(1)).alias("m")))
    means = similarity.centroids(vectors.join(labels, "doc_id"), "topic_id", "v")
    return importance.combined(npmi, similarity.centroid_importance(means, terms)).select("topic_id", "term", r6("weight").alias("weight"))


_DIST = {
    "cosine": "1 - sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)))",
    "euclidean": "sqrt(sum((a.x - b.x) * (a.x - b.x)))",
    "sqeuclidean": "sum((a.x - b.x) * (a.x - b.x))",
    "cityblock": "sum(abs(a.x - b.x))",
    "chebyshev": "max(abs(a.x - b.x))",
    "correlation": "1 - corr(a.x, b.x)",
    "braycurtis": "sum(abs(a.x - b.x)) / sum(abs(a.x + b.x))",
    "canberra": "sum(abs(a.x - b.x) / (abs(a.x) + abs(b.x)))",
    "hamming": "avg(CAST(a.x <> b.x AS DOUBLE))",
    "jaccard": "sum(CAST(a.x <> b.x AS DOUBLE)) / count(*)",
    "minkowski": "pow(sum(pow(abs(a.x - b.x), 3)), 1 / CAST(3 AS DOUBLE))",
}


@query(with_("SELECT a.topic_id AS a_id, b.topic_id AS b_id, " + ", ".join(f"{q6(x)} AS {m}" for m, x in _DIST.items()) + " FROM cen a JOIN cen b ON a.topic_id < b.topic_id AND a.i = b.i GROUP BY ALL"))
def topic_distance(spark, sf):
    out = similarity.distances(similarity.centroids(table(spark, sf, "embeddings")), list(_DIST))
    return out.select("a_id", "b_id", *(r6(m).alias(m) for m in _DIST))


@query(
    with_(
        f"SELECT n.doc_id, s.topic_id, {q6('coalesce(p, 0) / (nd * nt)')} AS weight FROM n CROSS JOIN s LEFT JOIN p USING (doc_id, topic_id)",
        idf="SELECT term, ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) AS idf FROM voc",
        x="SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) * idf AS x FROM dtm JOIN idf USING (term)",
        n="SELECT doc_id, sqrt(sum(x * x)) AS nd FROM x GROUP BY doc_id",
        s="SELECT topic_id, sqrt(sum(weight * weight)) AS nt FROM cw GROUP BY topic_id",
        p="SELECT doc_id, topic_id, sum(x * weight) AS p FROM x JOIN cw USING (term) GROUP BY ALL",
    )
)
def cluster_transform_lexical(spark, sf):
    docs = corpus(spark, sf)
    found = bags.bags(docs, 10)
    counts = bags.cells(found)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_docs)).select("term", F.log(F.col("n") / F.col("df")).alias("idf"))
    weights = settle(importance.ctf_idf(importance.topic_counts(found, tables.language_topics(docs))))
    return similarity.lexical_transform(found, idf, weights).select("doc_id", "topic_id", r6("weight").alias("weight"))


@query(with_(f"SELECT vec_id, c.topic_id, {q6('sum(e.x * c.x) / (sqrt(sum(e.x * e.x)) * sqrt(sum(c.x * c.x)))')} AS weight FROM emx e JOIN cen c USING (i) GROUP BY ALL"))
def cluster_transform_centroid(spark, sf):
    rows = table(spark, sf, "embeddings")
    return similarity.centroid_transform(rows, similarity.centroids(rows)).select("vec_id", "topic_id", r6("weight").alias("weight"))


_SEEDS = {"north": (("shonha", "thatnd"), ("eraner", "wasthe")), "south": (("delaque",), ("dasund", "verein"))}


def _seed_rows(c):
    return " UNION ALL ".join(f"SELECT '{c}' AS concept, {s} AS polarity, '{p}' AS phrase" for s, ps in ((1, _SEEDS[c][0]), (-1, _SEEDS[c][1])) for p in ps)


@query(
    with_(
        f"SELECT doc_id, concept, {q6('sum(d.x * u.x)')} AS score FROM dvx d JOIN u USING (i) GROUP BY ALL",
        seeds=" UNION ALL ".join(_seed_rows(c) for c in _SEEDS),
        sx="SELECT concept, polarity, i, CAST(instr('0123456789abcdef', substr(md5(phrase), i, 1)) * 2 - 17 AS DOUBLE) AS x FROM seeds, range(1, 33) AS r(i)",
        ax="SELECT concept, i, sum(m * polarity) AS x FROM (SELECT concept, polarity, i, avg(x) AS m FROM sx GROUP BY ALL) GROUP BY ALL",
        u="SELECT concept, i, x / sqrt(sum(x * x) OVER (PARTITION BY concept)) AS x FROM ax",
    )
)
def concept_projection(spark, sf):
    _, _, docs = _spaces(spark, sf)
    phrases = spark.createDataFrame([(p,) for c in _SEEDS.values() for s in c for p in s], "phrase string").select("phrase", hash_vector("phrase").alias("v"))
    return similarity.concept_projection(docs, _SEEDS, phrases).select("doc_id", "concept", r6("score").alias("score"))


@query(with_(f"SELECT topic_id, i, {q6('sum(x * w) / sum(w)')} AS x FROM (SELECT vec_id, i, x FROM emx) JOIN (SELECT vec_id, k AS topic_id, CAST(1 + vec_id % (k + 2) AS DOUBLE) AS w FROM embeddings, range(3) AS r(k)) USING (vec_id) GROUP BY ALL"))
def topic_embedding(spark, sf):
    rows = table(spark, sf, "embeddings")
    soft = rows.select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("topic_id")).withColumn("weight", (1 + F.col("vec_id") % (F.col("topic_id") + 2)).cast("double"))
    return similarity.topic_embedding(rows, soft, "vec_id", "embedding").select("topic_id", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


@query(with_(f"SELECT a.vec_id, a.i, {q6('CASE WHEN a.vec_id % 7 = 0 OR b.x IS NULL THEN a.x ELSE (a.x + b.x) / 2 END')} AS x FROM emx a LEFT JOIN emx b ON b.i = a.i AND b.vec_id = a.vec_id + CASE WHEN a.vec_id % 2 = 0 THEN 1 ELSE -1 END"))
def multimodal_join(spark, sf):
    """Text vectors with image vectors, every seventh image missing."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    images = rows.select((F.col("vec_id") + F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1)).alias("vec_id"), F.col("embedding").alias("image"))
    both = rows.join(images, "vec_id", "left").withColumn("image", F.when(F.col("vec_id") % 7 != 0, F.col("image")))
    return both.select("vec_id", F.posexplode(similarity.multimodal("embedding", "image")).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


@query(
    with_(
        "SELECT gx, gy, arg_min(term, (d, term)) AS term FROM (SELECT gx, gy, term, round(pow(x - px, 2) + pow(y - py, 2), 9) AS d FROM pts, grid) GROUP BY ALL",
        pts="SELECT term, CAST(v[1] AS DOUBLE) AS x, CAST(v[2] AS DOUBLE) AS y FROM tv",
        box="SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts",
        grid="SELECT CAST(a AS INTEGER) AS gx, CAST(b AS INTEGER) AS gy, x0 + a * (x1 - x0) / 19 AS px, y0 + b * (y1 - y0) / 19 AS py FROM box, range(20) AS r(a), range(20) AS s(b)",
    )
)
def concept_compass(spark, sf):
    terms = tables.term_vectors(tables.dtm(corpus(spark, sf)).select("term").distinct())
    return similarity.compass(terms.select("term", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y")))


_TOP = "SELECT topic_id, term FROM (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM cwr) WHERE rank <= 10"


def _top_words(spark, sf):
    from themeloom.operators import ranking

    weights = importance.ctf_idf(tables.topic_terms(corpus(spark, sf))).withColumn("weight", r6("weight"))
    return ranking.top(weights, ["topic_id"]).select("topic_id", "term")


@query(with_(f"SELECT {q6('count(DISTINCT term) / CAST(count(*) AS DOUBLE)')} AS diversity FROM ({_TOP})"))
def eval_diversity(spark, sf):
    return evaluate.diversity(_top_words(spark, sf)).select(r6("diversity").alias("diversity"))


@query(with_(f"SELECT topic_id, {q6('avg(s)')} AS coherence FROM (SELECT a.topic_id, CAST(list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) AS DOUBLE) / (sqrt(list_sum(list_transform(x.v, lambda z: z * z))) * sqrt(list_sum(list_transform(y.v, lambda z: z * z)))) AS s FROM tw a JOIN tw b ON a.topic_id = b.topic_id AND a.term < b.term JOIN tv x ON x.term = a.term JOIN tv y ON y.term = b.term) GROUP BY topic_id", tw=_TOP))
def eval_coherence(spark, sf):
    words = _top_words(spark, sf)
    return evaluate.coherence(words, tables.term_vectors(words.select("term").distinct())).select("topic_id", r6("coherence").alias("coherence"))


@query(
    with_(
        f"SELECT {q6('tp / sqrt(pa * pb)')} AS fmi, {q6('1 - hab / ha')} AS homogeneity, {q6('1 - hba / hb')} AS completeness FROM (SELECT sum(n * (n - 1) / 2.0) AS tp, -sum(n / t * ln(n / nb)) AS hab, -sum(n / t * ln(n / na)) AS hba FROM cell JOIN ra USING (a) JOIN rb USING (b), tot), (SELECT sum(na * (na - 1) / 2.0) AS pa, -sum(na / t * ln(na / t)) AS ha FROM ra, tot), (SELECT sum(nb * (nb - 1) / 2.0) AS pb, -sum(nb / t * ln(nb / t)) AS hb FROM rb, tot)",
        cell="SELECT lang AS a, source AS b, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY ALL",
        ra="SELECT a, sum(n) AS na FROM cell GROUP BY a",
        rb="SELECT b, sum(n) AS nb FROM cell GROUP BY b",
        tot="SELECT sum(n) AS t FROM cell",
    )
)
def eval_clustering(spark, sf):
    return evaluate.agreement(corpus(spark, sf), "lang", "source").select(*(r6(c).alias(c) for c in ("fmi", "homogeneity", "completeness")))


@query(
    with_(
        f"SELECT doc_id, chunk, n, {q6('d / sqrt(d2)')} AS head FROM (SELECT doc_id, chunk, max(n) AS n, sum(CASE WHEN i = 1 THEN CAST(s AS DOUBLE) ELSE 0 END) AS d, sum(CAST(s * s AS DOUBLE)) AS d2 FROM (SELECT doc_id, chunk, i, count(*) AS n, sum(x) AS s FROM win GROUP BY ALL) GROUP BY doc_id, chunk)",
        words="SELECT item_id AS doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos, len(w) AS len FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark)",
        win="SELECT doc_id, chunk, i, instr('0123456789abcdef', substr(md5(term), i, 1)) * 2 - 17 AS x FROM words, range(0, 100000, 8) AS r(chunk), range(1, 33) AS s(i) WHERE chunk < len AND pos >= chunk AND pos < chunk + 10",
    )
)
def late_windows(spark, sf):
    """Windows of ten tokens, eight apart: the mean of their vectors, unit length; its first coordinate."""
    from themeloom.operators import chunks

    docs = table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    rows = chunks.windows(docs, 10, 8)
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("n").cast("long").alias("n"), r6(F.col("v")[0]).alias("head"))

