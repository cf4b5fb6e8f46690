"""Queries of sources, sinks, text and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions import clean, dress_html, r6, strip_think
from themeloom.operators import bags, ranking, text
from themeloom.plans.register import query
from themeloom.plans.sql import TOKEN, with_
from themeloom.plans.sql import r6 as q6
from themeloom.sources import tables
from themeloom.sources.tables import corpus, table

STOP = ("the", "and", "of", "to", "in", "der", "die", "das", "und", "de", "la", "le", "les", "et", "el", "los", "que", "en")
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
LANG_STOP = {"en": ("the", "and", "of", "to"), "de": ("der", "die", "und", "das"), "fr": ("de", "la", "le", "et"), "es": ("de", "la", "que", "el")}


@query("SELECT doc_id, lang, source, length(text) AS chars, md5(text) AS digest FROM documents")
def source_corpus(spark, sf):
    return corpus(spark, sf).select("doc_id", "lang", "source", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(f"SELECT vec_id, label, len(embedding) AS dims, {q6('sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))')} AS norm FROM embeddings")
def source_embeddings(spark, sf):
    from themeloom.functions import norm

    return table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), r6(norm("embedding")).alias("norm"))


@query("SELECT page_id, url, length(html) AS chars FROM pages")
def source_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length("html").cast("long").alias("chars"))


@query(with_("SELECT doc_id, array_to_string(v, ' ') AS v FROM dv"))
def encode_documents(spark, sf):
    counts = tables.dtm(corpus(spark, sf))
    v = tables.document_vectors(counts, tables.term_vectors(counts.select("term").distinct()))
    return v.select("doc_id", F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("v"))


@query(with_("SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_terms FROM tok GROUP BY doc_id"))
def tokenize(spark, sf):
    return text.tokens(corpus(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("n_terms"))


@query(with_(f"SELECT doc_id, term, tf FROM dtm WHERE term NOT IN {STOP_SQL}"))
def default_vectorizer(spark, sf):
    return text.fit_terms(corpus(spark, sf), min_df=10, stop=STOP)


@query(
    with_(
        "SELECT doc_id, term, 1 AS x FROM dtm0 JOIN kept USING (term)",
        kept="SELECT term FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM dtm0 GROUP BY term) WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY cf DESC, term LIMIT 500",
    )
)
def vectorizer_knobs(spark, sf):
    docs = corpus(spark, sf)
    counts = text.doc_terms(text.tokens(docs))
    vocab = text.vocabulary(counts, min_df=5, max_df=0.5, n_docs=docs.count(), max_features=500)
    return text.restrict(counts, vocab).select("doc_id", "term", F.lit(1).alias("x"))


@query(with_("SELECT term, cf, df FROM voc"))
def vocabulary(spark, sf):
    return text.vocabulary(text.doc_terms(text.tokens(corpus(spark, sf))))


@query(with_("SELECT doc_id, term, tf FROM dtm"))
def doc_term_matrix(spark, sf):
    return tables.dtm(corpus(spark, sf))


@query(with_("SELECT item_id AS doc_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '" + TOKEN + "')) AS term FROM benchmark) JOIN voc USING (term) GROUP BY ALL"))
def doc_term_transform(spark, sf):
    vocab = text.vocabulary(text.doc_terms(text.tokens(corpus(spark, sf))))
    other = table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    return text.restrict(text.doc_terms(text.tokens(other)), vocab)


_WORDS = "SELECT doc_id, list_filter(regexp_extract_all(lower(text), '" + TOKEN + "'), lambda t: t NOT IN " + STOP_SQL + ") AS w FROM documents"
_ALL_WORDS = "SELECT doc_id, regexp_extract_all(lower(text), '" + TOKEN + "') AS w FROM documents"
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS term FROM words" for n in (1, 2, 3))


@query(with_("SELECT n, term, count(*) AS cf FROM grams GROUP BY ALL HAVING count(*) >= 3", grams=_GRAMS, words=_WORDS))
def ngrams(spark, sf):
    return text.ngrams(corpus(spark, sf), 1, 3, stop=STOP).groupBy("n", "term").agg(F.count(F.lit(1)).alias("cf")).where("cf >= 3")


@query(
    with_(
        f"SELECT term, n, cf, {q6('npmi')} AS npmi FROM (SELECT term, n, g.cf, log2(((g.cf + 5) / t) / (((a.c + 5) / t) * ((b.c + 5) / t))) / -log2((g.cf + 5) / t) AS npmi FROM g, total, u a, u b WHERE n > 1 AND a.w = split_part(g.term, ' ', 1) AND b.w = split_part(g.term, ' ', -1)) WHERE npmi > 0.5",
        grams=_GRAMS,
        words=_ALL_WORDS,
        g="SELECT n, term, CAST(count(*) AS DOUBLE) AS cf FROM grams GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10",
        u="SELECT term AS w, cf AS c FROM g WHERE n = 1",
        total="SELECT sum(c) + count(*) * 5.0 AS t FROM u",
    )
)
def phrases(spark, sf):
    return text.phrases(corpus(spark, sf)).select("term", "n", F.col("cf").cast("double").alias("cf"), r6("npmi").alias("npmi"))


@query()
def stem_terms(spark, sf):
    return text.stems(text.tokens(corpus(spark, sf)))


_LANG_CASE = "CASE lang " + " ".join(f"WHEN '{x}' THEN t NOT IN ({', '.join(repr(w) for w in ws)})" for x, ws in LANG_STOP.items()) + " ELSE true END"


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}]{{2,}}'), lambda t: {_LANG_CASE})) AS term FROM documents) GROUP BY ALL")
def lang_tokens(spark, sf):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{2,}"), F.lit(0))

    def keep(t):
        out = F.lit(True)
        for code, words in LANG_STOP.items():
            out = F.when(F.col("lang") == code, ~t.isin(*words)).otherwise(out)
        return out

    return corpus(spark, sf).select("doc_id", F.explode(F.filter(found, keep)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_CLEAN}) > 300 THEN substr({_CLEAN}, 1, 300) || '...' ELSE {_CLEAN} END AS document FROM documents")
def clean_document(spark, sf):
    return corpus(spark, sf).select("doc_id", clean("text").alias("document"))


@query("SELECT page_id, replace(replace(replace(replace(replace(substr(trim(regexp_replace(html, '\\s+', ' ', 'g')), 1, 900), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages")
def sanitize_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", dress_html("html").alias("html"))


@query("SELECT item_id, trim(text) AS text FROM benchmark")
def strip_think_blocks(spark, sf):
    told = F.concat(F.lit("<think>a\nb</think> "), F.col("text"), F.lit("<think>c</think>"))
    return table(spark, sf, "benchmark").select("item_id", strip_think(told).alias("text"))


@query("SELECT vec_id, CASE WHEN label % 5 = 0 THEN -1 ELSE CAST(dense_rank() OVER (PARTITION BY label % 5 = 0 ORDER BY label) - 1 AS INTEGER) END AS topic_id FROM embeddings")
def factorize_labels(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") % 5 != 0, F.col("label")).alias("label"))
    return text.factorize(rows, "vec_id", "label")


@query("SELECT doc_id, CAST(quality = 0 AS INTEGER) AS class_0, CAST(quality = 1 AS INTEGER) AS class_1 FROM labels")
def one_hot(spark, sf):
    return table(spark, sf, "labels").select("doc_id", *((F.col("quality") == i).cast("int").alias(f"class_{i}") for i in (0, 1)))


@query("SELECT vec_id, i - 1 AS i, x FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS x, list_sort(embedding, 'DESC')[8] AS t FROM embeddings) WHERE x >= t")
def topk_activation(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("t", F.sort_array("embedding", False)[7])
    return rows.select("vec_id", "t", F.posexplode("embedding").alias("i", "x")).where("x >= t").select("vec_id", F.col("i").cast("long").alias("i"), "x")


@query(
    with_(
        "SELECT doc_id, latent, round(sqrt(sum(a)), 6) + 0.0 AS weight FROM (SELECT doc_id, latent, tf * a AS a FROM dtm JOIN act USING (term)) GROUP BY ALL",
        act="SELECT term, latent, a FROM (SELECT term, latent, CAST(x AS DOUBLE) AS a, row_number() OVER (PARTITION BY term ORDER BY x DESC, latent) AS r FROM (SELECT term, i - 1 AS latent, x FROM tvx)) WHERE r <= 4 AND a > 0",
    )
)
def latent_terms(spark, sf):
    """Term activations through a top-4 gate (identity weights), summed by document, square root."""
    rows = bags.latents(bags.bags(corpus(spark, sf), 10))
    return rows.select("doc_id", "latent", r6(F.sqrt("a")).alias("weight"))


_COUNTS = "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL"


@query(f"SELECT * FROM (SELECT 0 AS line_no, '| lang | source | n |' AS line UNION ALL SELECT 1, '| - | - | - |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY lang, source), '| ' || lang || ' | ' || source || ' | ' || n || ' |' FROM ({_COUNTS}))")
def export_markdown(spark, sf):
    out = ranking.export_table(corpus(spark, sf).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), ["lang", "source"])
    return out.select(F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""SELECT * FROM (SELECT 0 AS line_no, '"lang","source","n"' AS line UNION ALL SELECT row_number() OVER (ORDER BY lang, source), '"' || lang || '","' || source || '",' || n FROM ({_COUNTS}))""")
def export_csv(spark, sf):
    out = ranking.export_table(corpus(spark, sf).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), ["lang", "source"], "csv")
    return out.select(F.col("line_no").cast("long").alias("line_no"), "line")


@query(with_("SELECT term FROM (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '" + TOKEN + "')) AS term FROM benchmark)) WHERE term NOT IN (SELECT term FROM voc)"))
def vocab_new(spark, sf):
    vocab = text.vocabulary(text.doc_terms(text.tokens(corpus(spark, sf))))
    other = text.tokens(table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")).select("term").distinct()
    return other.join(vocab, "term", "left_anti")


@query(with_("SELECT term FROM voc UNION SELECT term FROM (SELECT unnest(regexp_extract_all(lower(text), '" + TOKEN + "')) AS term FROM benchmark)"))
def vocab_union(spark, sf):
    vocab = text.vocabulary(text.doc_terms(text.tokens(corpus(spark, sf)))).select("term")
    other = text.tokens(table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")).select("term")
    return vocab.union(other).distinct()


@query("SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 25) AS BIGINT) AS batch FROM documents")
def batched(spark, sf):
    """Batches of 25 of each source in order of id. Ranges of ids are ranked by themselves and offset by the counts before them, so no task sorts a whole source."""
    from pyspark.sql import Window

    rows = corpus(spark, sf).select("doc_id", "source", F.floor(F.col("doc_id") / 4096).alias("part"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("source", "part").count().select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    own = rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id")) - 1)
    own = own.join(cells, own["source"].eqNullSafe(cells["s"]) & (own["part"] == cells["p"]))
    return own.select("doc_id", F.floor((F.col("at") + F.col("before")) / 25).alias("batch"))


@query(with_("SELECT doc_id, pos, start, substr(lower(text), CAST(start AS BIGINT), length(term)) AS term FROM (SELECT doc_id, text, pos, term, instr_at AS start FROM toks)", toks="SELECT item_id AS doc_id, text, pos, w[pos + 1] AS term, length(array_to_string(list_transform(range(0, pos), lambda k: gaps[k + 1] || w[k + 1]), '')) + length(gaps[pos + 1]) + 1 AS instr_at FROM (SELECT item_id, text, regexp_extract_all(lower(text), '" + TOKEN + "') AS w, regexp_split_to_array(lower(text), '" + TOKEN + "') AS gaps FROM benchmark), LATERAL (SELECT unnest(range(len(w))) AS pos)"))
def token_offsets(spark, sf):
    """Tokens with the place, from 1, where each starts."""
    low = F.lower("text")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), low.alias("t"), F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)).alias("w"), F.split(low, TOKEN).alias("gaps"))
    rows = rows.select("doc_id", "t", F.posexplode(F.arrays_zip("w", F.slice("gaps", 1, F.size("w")).alias("g"))).alias("pos", "x"), "w", "gaps")
    before = F.aggregate(F.slice(F.arrays_zip(F.col("gaps").alias("g"), F.col("w").alias("w")), 1, F.col("pos")), F.lit(0), lambda s, x: s + F.length(x["g"]) + F.length(x["w"]))
    start = before + F.length(F.element_at("gaps", F.col("pos") + 1)) + 1
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), start.cast("long").alias("start"), F.substring("t", start, F.length(F.element_at("w", F.col("pos") + 1))).alias("term"))
