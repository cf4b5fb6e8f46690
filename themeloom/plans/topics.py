"""Queries of term importance, rankings, tables and time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from themeloom.functions import r6
from themeloom.operators import importance, ranking, similarity, timebins
from themeloom.plans.register import query
from themeloom.plans.sql import r6 as q6
from themeloom.plans.sql import with_
from themeloom.sources import tables
from themeloom.sources.tables import corpus, table


def _weights(spark, sf, normalized=False):
    """c-TF-IDF of languages at six digits, the weights that lists are made of."""
    return importance.ctf_idf(tables.topic_terms(corpus(spark, sf)), normalized).withColumn("weight", r6("weight"))


def _out(rows):
    return rows.select("topic_id", "term", r6("weight").alias("weight"))


_TOP10 = "SELECT topic_id, term, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM cwr"


@query(with_(f"SELECT topic_id, term, weight, rank FROM ({_TOP10}) WHERE rank <= 10"))
def ctf_idf_top_terms(spark, sf):
    return ranking.top(_weights(spark, sf), ["topic_id"]).select("topic_id", "term", "weight", F.col("rank").cast("long").alias("rank"))


@query(with_("SELECT topic_id, term, weight FROM cwr"))
def ctf_idf(spark, sf):
    return _weights(spark, sf)


@query(with_(f"SELECT topic_id, term, {q6('weight / sum(tf) OVER (PARTITION BY topic_id)')} AS weight FROM cw JOIN tt USING (topic_id, term)"))
def ctf_idf_normalized(spark, sf):
    return _weights(spark, sf, True)


@query(
    with_(
        f"SELECT topic_id, term, {q6('(t / sum(t) OVER (PARTITION BY topic_id)) * ln((SELECT count(*) FROM documents) / sum(t) OVER (PARTITION BY term))')} AS weight FROM st",
        st="SELECT topic_id, term, sum(tf * weight) AS t FROM dtm JOIN soft USING (doc_id) GROUP BY ALL",
    )
)
def soft_ctf_idf(spark, sf):
    docs = corpus(spark, sf)
    counts = importance.soft_counts(tables.dtm(docs), tables.soft_topics(docs))
    return _out(importance.soft_ctf_idf(counts, docs.agg(F.count(F.lit(1)).alias("n_docs"))))


def _npmi_sql(sign: str) -> str:
    return with_(
        f"SELECT topic_id, term, {q6(f'(log2(p_wt) - log2(p_w)) / -(log2(p_wt) {sign} log2(p_t))')} AS weight FROM (SELECT f.topic_id, f.term, (tf + 5) / sum(tf + 5.0) OVER (PARTITION BY f.topic_id) AS p_wt, (cf + 5) / (SELECT sum(cf + 5.0) FROM voc) AS p_w, p_t FROM fulltt f JOIN voc USING (term) JOIN pt USING (topic_id))",
        pt="SELECT topic_id, (n + 5) / sum(n + 5.0) OVER () AS p_t FROM (SELECT topic_id, count(*) AS n FROM lab GROUP BY topic_id)",
    )


def _dense(spark, sf):
    docs = corpus(spark, sf)
    counts = tables.topic_terms(docs)
    labels = tables.language_topics(docs)
    return importance.dense(counts, labels, counts.select("term").distinct()), labels.groupBy("topic_id").agg(F.count(F.lit(1)).alias("m"))


@query(_npmi_sql("+"))
def npmi_importance(spark, sf):
    return _out(importance.npmi(*_dense(spark, sf)))


@query(_npmi_sql("-"))
def npmi_importance_compat(spark, sf):
    return _out(importance.npmi(*_dense(spark, sf), compat=True))


def _fighting_sql(a: str, a0: str) -> str:
    return with_(
        f"SELECT topic_id, term, {q6('(ln(y1 / (n1 + a0 - y1)) - ln(y2 / (n - n1 + a0 - y2))) / sqrt(1 / y1 + 1 / y2)')} AS weight FROM (SELECT topic_id, term, tf + {a} AS y1, cf - tf + {a} AS y2, CAST(sum(tf) OVER (PARTITION BY topic_id) AS DOUBLE) AS n1, (SELECT CAST(sum(cf) AS DOUBLE) FROM voc) AS n, {a0} AS a0 FROM fulltt JOIN voc USING (term))"
    )


@query(_fighting_sql("CAST(cf AS DOUBLE)", "(SELECT CAST(sum(cf) AS DOUBLE) FROM voc)"))
def fighting_words(spark, sf):
    return _out(importance.fighting_words(_dense(spark, sf)[0]))


@query(_fighting_sql("CAST(0.5 AS DOUBLE)", "(SELECT count(*) * CAST(0.5 AS DOUBLE) FROM voc)"))
def fighting_words_flat_prior(spark, sf):
    return _out(importance.fighting_words(_dense(spark, sf)[0], 0.5))


@query(
    with_(
        f"SELECT doc_id, term, {q6('ln((n - df + 0.5) / (df + 0.5)) * (tf * 9.0) / (tf + 8.0 * (0.3 + 0.7 * len / mean))')} AS weight FROM (SELECT doc_id, term, tf, sum(tf) OVER (PARTITION BY doc_id) AS len, df FROM dtm JOIN voc USING (term)), (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean FROM (SELECT sum(tf) AS len FROM dtm GROUP BY doc_id))"
    )
)
def bm25(spark, sf):
    return importance.bm25(tables.dtm(corpus(spark, sf))).select("doc_id", "term", r6("weight").alias("weight"))


def _axial_sql(expr: str) -> str:
    return with_(f"SELECT term, topic_id, {q6(expr)} AS weight FROM (SELECT term, i - 1 AS topic_id, CAST(x AS DOUBLE) AS x, sqrt(sum(CAST(x AS DOUBLE) * x) OVER (PARTITION BY term)) AS n FROM tvx WHERE i <= 3)")


def _coords(spark, sf):
    vectors = tables.term_vectors(tables.dtm(corpus(spark, sf)).select("term").distinct())
    return vectors.select("term", F.posexplode(F.slice("v", 1, 3)).alias("topic_id", "x")).withColumn("x", F.col("x").cast("double"))


def _axial(spark, sf, mode):
    return importance.axial(_coords(spark, sf), mode).select("term", F.col("topic_id").cast("long").alias("topic_id"), r6("weight").alias("weight"))


@query(_axial_sql("x"))
def axial_importance(spark, sf):
    return _axial(spark, sf, "axial")


@query(_axial_sql("x / n"))
def angular_importance(spark, sf):
    return _axial(spark, sf, "angular")


@query(_axial_sql("x * x * (x / n)"))
def axial_combined_importance(spark, sf):
    return _axial(spark, sf, "combined")


@query(with_("SELECT topic_id, count(*) AS n FROM lab GROUP BY topic_id"))
def topic_sizes(spark, sf):
    return tables.language_topics(corpus(spark, sf)).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_("SELECT topic_id, count(*) FILTER (weight / m >= 0.05) AS n FROM soft, (SELECT max(weight) AS m FROM soft) GROUP BY topic_id"))
def topic_sizes_soft(spark, sf):
    soft = tables.soft_topics(corpus(spark, sf))
    return soft.crossJoin(F.broadcast(soft.agg(F.max("weight").alias("m")))).groupBy("topic_id").agg(F.count_if(F.col("weight") / F.col("m") >= 0.05).alias("n"))


@query(with_(f"SELECT topic_id, {q6('sum(weight) / sum(sum(weight)) OVER ()')} AS share_sum, {q6('avg(weight)')} AS share_mean, {q6('sum(w2) / sum(sum(w2)) OVER ()')} AS share_rows FROM (SELECT topic_id, weight, weight / sum(weight) OVER (PARTITION BY doc_id) AS w2 FROM soft) GROUP BY topic_id"))
def topic_share(spark, sf):
    soft = tables.soft_topics(corpus(spark, sf))
    out = None
    for mode in ("sum", "mean", "rows"):
        part = ranking.share(soft, mode).select("topic_id", r6("share").alias(f"share_{mode}"))
        out = part if out is None else out.join(part, "topic_id")
    return out


@query(with_(f"SELECT rank, {q6('quantile_cont(w, 0.025)')} AS low, {q6('quantile_cont(w, 0.5)')} AS median, {q6('quantile_cont(w, 0.975)')} AS high FROM (SELECT w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, topic_id) AS rank FROM (SELECT doc_id, topic_id, round(weight, 6) AS w FROM soft)) GROUP BY rank"))
def topic_decay(spark, sf):
    return ranking.decay(tables.soft_topics(corpus(spark, sf))).select(F.col("rank").cast("long").alias("rank"), *(r6(c).alias(c) for c in ("low", "median", "high")))


@query(f"SELECT lang AS name, {q6('100.0 * count(*) / sum(count(*)) OVER ()')} AS percentage FROM documents GROUP BY lang")
def percentages(spark, sf):
    n = corpus(spark, sf).groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("name", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percentage"))


@query(with_(f"SELECT conv_id, topic_id, {q6('avg(w)')} AS weight FROM (SELECT conv_id, CAST(k AS INTEGER) AS topic_id, CAST(length(text) % (k + 7) AS DOUBLE) AS w FROM conversations, range(3) AS r(k)) GROUP BY ALL"))
def pool_flat(spark, sf):
    """Chunk rows pooled to their document by the mean."""
    rows = table(spark, sf, "conversations").select("conv_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("topic_id"))
    rows = rows.withColumn("w", (F.col("n") % (F.col("topic_id") + 7)).cast("double"))
    return rows.groupBy("conv_id", "topic_id").agg(r6(F.avg("w")).alias("weight"))


@query(with_("SELECT topic_id, term, weight, rank FROM (SELECT topic_id, term, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight, term) AS rank FROM cwr) WHERE rank <= 10"))
def bottom_terms(spark, sf):
    return ranking.top(_weights(spark, sf), ["topic_id"], lowest=True).select("topic_id", "term", "weight", F.col("rank").cast("long").alias("rank"))


@query(with_("SELECT topic_id, doc_id, weight, rank FROM (SELECT topic_id, doc_id, round(weight, 6) + 0.0 AS weight, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 6) DESC, doc_id) AS rank FROM soft) WHERE rank <= 10"))
def top_documents(spark, sf):
    soft = tables.soft_topics(corpus(spark, sf)).withColumn("weight", r6("weight"))
    return ranking.top(soft, ["topic_id"], tie="doc_id").select("topic_id", "doc_id", "weight", F.col("rank").cast("long").alias("rank"))


_CLEANED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    with_(
        f"SELECT topic_id, side, rank, doc_id, weight, CASE WHEN length({_CLEANED}) > 300 THEN substr({_CLEANED}, 1, 300) || '...' ELSE {_CLEANED} END AS document FROM sided JOIN documents USING (doc_id) WHERE rank <= 5",
        rounded="SELECT doc_id, topic_id, round(weight, 6) + 0.0 AS weight FROM soft",
        sided="SELECT *, 'highest' AS side, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, doc_id) AS rank FROM rounded UNION ALL SELECT *, 'lowest', row_number() OVER (PARTITION BY topic_id ORDER BY weight, doc_id) FROM rounded",
    )
)
def representative_documents(spark, sf):
    docs = corpus(spark, sf)
    out = ranking.representative_documents(tables.soft_topics(docs).withColumn("weight", r6("weight")), docs, 5, True)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(with_("SELECT topic_id, round(weight, 6) + 0.0 AS weight FROM soft WHERE doc_id = 7 ORDER BY weight DESC LIMIT 10"))
def topic_distribution(spark, sf):
    """One document's topics."""
    return tables.soft_topics(corpus(spark, sf)).where("doc_id = 7").orderBy(F.desc("weight"), "topic_id").limit(10).select("topic_id", r6("weight").alias("weight"))


@query(
    with_(
        "SELECT h.topic_id, highest, lowest FROM h JOIN l USING (topic_id)",
        h="SELECT topic_id, string_agg(printf('%s(%.2f)', term, weight), ', ' ORDER BY rank) AS highest FROM (" + _TOP10 + ") WHERE rank <= 10 GROUP BY topic_id",
        l="SELECT topic_id, string_agg(printf('%s(%.2f)', term, weight), ', ' ORDER BY rank) AS lowest FROM (SELECT topic_id, term, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight, term) AS rank FROM cwr) WHERE rank <= 10 GROUP BY topic_id",
    )
)
def topics_table(spark, sf):
    return ranking.topics_table(_weights(spark, sf), 10, scores=True, negative=True)


@query(with_(f"SELECT topic_id, CASE topic_id WHEN 1 THEN 'English' ELSE topic_id || '_' || string_agg(term, '_' ORDER BY rank) END AS name FROM ({_TOP10}) WHERE rank <= 4 GROUP BY topic_id"))
def topic_names(spark, sf):
    other = spark.createDataFrame([(1, "English")], "topic_id int, name string")
    return ranking.topic_names(_weights(spark, sf), 4, other)


@query(with_("SELECT topic_id, bool_or(weight < 0) AS negative FROM cwr GROUP BY topic_id"))
def has_negative_side(spark, sf):
    return _weights(spark, sf).groupBy("topic_id").agg(F.bool_or(F.col("weight") < 0).alias("negative"))


@query(with_("SELECT label AS topic_id, vec_id, sim, rank FROM (SELECT label, vec_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM (SELECT label, vec_id, round(sum(x * c.x) / (sqrt(sum(x * x)) * sqrt(sum(c.x * c.x))), 6) + 0.0 AS sim FROM (SELECT vec_id, label, i, x FROM emx) e JOIN (SELECT topic_id, i, x FROM cen) c ON c.topic_id = e.label AND c.i = e.i GROUP BY ALL)) WHERE rank <= 20".replace("sum(x * c.x)", "sum(e.x * c.x)").replace("sum(x * x)", "sum(e.x * e.x)")))
def top_images(spark, sf):
    """The twenty vectors nearest to their topic's centre: an image is its embedding here."""
    rows = table(spark, sf, "embeddings")
    means = similarity.centroids(rows)
    near = rows.join(F.broadcast(means), rows["label"] == means["topic_id"])
    from themeloom.functions import cosine

    return ranking.top(near.select("topic_id", "vec_id", r6(cosine("embedding", "v")).alias("sim")), ["topic_id"], "sim", "vec_id", 20).withColumn("rank", F.col("rank").cast("long"))


@query(with_("SELECT doc_id, term, tf, rank FROM (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM dtm) WHERE rank <= 5"))
def prune_keywords(spark, sf):
    return ranking.top(tables.dtm(corpus(spark, sf)), ["doc_id"], "tf", "term", 5).withColumn("rank", F.col("rank").cast("long"))


@query(with_("SELECT doc_id, arg_max(topic_id, w * 10 - topic_id) AS topic_id FROM raw GROUP BY doc_id"))
def argmax_label(spark, sf):
    return ranking.argmax_label(tables.soft_topics(corpus(spark, sf)))


def _times(spark, sf):
    """doc_id, us: documents have no time of their own; an hour apart from the first event on, by doc_id."""
    first = table(spark, sf, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t0"))
    return corpus(spark, sf).select("doc_id").crossJoin(F.broadcast(first)).select("doc_id", (F.col("t0") + F.col("doc_id") * 3600000000).alias("us"))


def _bins(spark, sf):
    return timebins.bin_equal(_times(spark, sf), "us", 10)


@query(with_("SELECT doc_id, bin FROM binned"))
def bin_timestamps(spark, sf):
    return _bins(spark, sf)


_EDGES = [0, 1_000_000_000_000_000, 1_704_500_000_000_000, 1_705_500_000_000_000, 1_800_000_000_000_000, 4_000_000_000_000_000]


@query(f"SELECT event_id, CAST(len(list_filter({_EDGES}, lambda e: e <= epoch_us(ts))) - 1 AS INTEGER) AS bin FROM events")
def bin_timestamps_edges(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timebins.bin_edges(rows, "us", _EDGES, "event_id")


@query("SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS bin, edge AS \"start\", lead(edge) OVER (ORDER BY edge) AS \"end\" FROM (SELECT unnest(" + str(_EDGES) + ") AS edge) QUALIFY lead(edge) OVER (ORDER BY edge) IS NOT NULL")
def time_slices(spark, sf):
    edges = spark.createDataFrame([(e,) for e in _EDGES], "edge long")
    return timebins.slices(edges).withColumn("bin", F.col("bin").cast("int"))


_OVER = dict(
    bt="SELECT bin, topic_id, term, CAST(sum(tf) AS BIGINT) AS tf FROM dtm JOIN lab USING (doc_id) JOIN binned USING (doc_id) GROUP BY ALL",
    ba="SELECT bin, sum(n) / CAST(count(*) AS DOUBLE) AS a FROM (SELECT bin, topic_id, sum(tf) AS n FROM bt GROUP BY ALL) GROUP BY bin",
    bw="SELECT bin, topic_id, term, round(tf * ln(1 + a / sum(tf) OVER (PARTITION BY bin, term)), 6) + 0.0 AS weight FROM bt JOIN ba USING (bin)",
)


def _over(spark, sf):
    docs = corpus(spark, sf)
    return timebins.importance_over_time(tables.dtm(docs), tables.language_topics(docs), _bins(spark, sf)).withColumn("weight", r6("weight"))


@query(with_("SELECT bin, topic_id, term, weight FROM bw", **_OVER))
def cluster_over_time(spark, sf):
    return _over(spark, sf)


@query(with_(f"SELECT bin, topic_id, {q6('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY bin)')} AS importance FROM lab JOIN binned USING (doc_id) GROUP BY bin, topic_id"))
def topic_share_over_time(spark, sf):
    return timebins.share_over_time(tables.language_topics(corpus(spark, sf)), _bins(spark, sf)).withColumn("importance", r6("importance"))


@query(
    with_(
        "SELECT b.bin, t.topic_id, coalesce(words, 'Topic not present.') AS words FROM (SELECT DISTINCT bin FROM bw) b CROSS JOIN (SELECT DISTINCT topic_id FROM bw) t LEFT JOIN (SELECT bin, topic_id, string_agg(term, ', ' ORDER BY r) AS words FROM (SELECT bin, topic_id, term, row_number() OVER (PARTITION BY bin, topic_id ORDER BY weight DESC, term) AS r FROM bw WHERE weight <> 0) WHERE r <= 5 GROUP BY ALL) w ON w.bin = b.bin AND w.topic_id = t.topic_id",
        **_OVER,
    )
)
def topics_over_time(spark, sf):
    return timebins.topics_over_time(_over(spark, sf))


@query(
    with_(
        f"SELECT bin, topic_id, term, {q6('(t / sum(t) OVER (PARTITION BY bin, topic_id)) * ln(n / sum(t) OVER (PARTITION BY bin, term))')} AS weight FROM (SELECT bin, topic_id, term, sum(tf * weight) AS t FROM dtm JOIN soft USING (doc_id) JOIN binned USING (doc_id) GROUP BY ALL) JOIN (SELECT bin, count(*) AS n FROM binned GROUP BY bin) USING (bin)"
    )
)
def gmm_over_time(spark, sf):
    """Soft topics by bin."""
    docs = corpus(spark, sf)
    out = timebins.soft_importance_over_time(tables.dtm(docs), tables.soft_topics(docs), _bins(spark, sf))
    return out.withColumn("weight", r6("weight"))


@query("SELECT CAST(least(floor((us - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, event_type, count(*) AS n FROM (SELECT event_type, epoch_us(ts) AS us FROM events), (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) + 1 AS hi FROM events) GROUP BY ALL")
def events_over_time(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.join(timebins.bin_equal(rows, "us", 10, "event_id"), "event_id").groupBy("bin", "event_type").agg(F.count(F.lit(1)).alias("n"))
