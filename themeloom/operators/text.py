"""Text to terms: tokens, document-term counts, vocabularies, n-grams and phrases, all in long form."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import terms
from themeloom.functions.porter import stem
from themeloom.sources.store import ready, settle


def tokens(docs: DataFrame, text: str = "text", stop: Iterable[str] = ()) -> DataFrame:
    """doc_id, pos, term. Stop words leave no gap: pos counts the words that stay."""
    found = terms(text)
    if stop := list(stop):
        found = F.filter(found, lambda t: ~t.isin(stop))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "term"))


def doc_terms(toks: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(dtm: DataFrame, min_df: int = 10, max_df: float | None = None, n_docs: int | None = None, max_features: int | None = None) -> DataFrame:
    """term, cf, df. max_df is a share of n_docs; max_features keeps the most frequent, ties by term."""
    out = dtm.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    if max_df is not None:
        out = out.where(F.col("df") <= max_df * n_docs)
    if max_features is not None:
        out = out.orderBy(F.desc("cf"), "term").limit(max_features)
    return out


def restrict(dtm: DataFrame, vocab: DataFrame) -> DataFrame:
    """The counts of a fixed vocabulary; terms outside it are dropped."""
    return dtm.join(vocab.select("term"), "term").select("doc_id", "term", "tf")


def fit_terms(docs: DataFrame, text: str = "text", min_df: int = 10, stop: Iterable[str] = ()) -> DataFrame:
    """doc_id, term, tf of terms in min_df documents or more."""
    dtm = doc_terms(tokens(docs, text, stop))
    return restrict(dtm, vocabulary(dtm, min_df))


def ngrams(docs: DataFrame, low: int = 1, high: int = 3, text: str = "text", stop: Iterable[str] = ()) -> DataFrame:
    """doc_id, n, term: runs of low to high words, joined by a space, over the words that stop words leave."""
    found = terms(text)
    if stop := list(stop):
        found = F.filter(found, lambda t: ~t.isin(stop))
    rows = docs.select("doc_id", found.alias("w"))

    def of(n: int) -> DataFrame:
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
        return rows.where(F.size("w") >= n).select("doc_id", F.lit(n).alias("n"), F.explode(runs).alias("term"))

    parts = [of(n) for n in range(low, high + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def phrases(docs: DataFrame, high: int = 3, min_df: int = 10, smoothing: float = 5, threshold: float = 0.5) -> DataFrame:
    """term, n, cf, npmi of the n-grams whose first and last words' NPMI is over the threshold; counts are the corpus's."""
    ids = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if ids[0] == ids[1]:
        from themeloom.operators import bags

        grams = bags.grams(docs, high)
    else:
        grams = ngrams(docs, 1, high).groupBy("n", "term").agg(F.count(F.lit(1)).alias("cf"), F.countDistinct("doc_id").alias("df"))
    grams = settle(grams.where(F.col("df") >= min_df))
    words = grams.where("n = 1").select("term", "cf")
    total = words.agg((F.sum("cf") + F.count(F.lit(1)) * F.lit(float(smoothing))).alias("total"))
    long = grams.where("n > 1").select("term", "n", "cf", F.substring_index("term", " ", 1).alias("w1"), F.substring_index("term", " ", -1).alias("w2"))
    long = long.join(words.select(F.col("term").alias("w1"), F.col("cf").alias("c1")), "w1").join(words.select(F.col("term").alias("w2"), F.col("cf").alias("c2")), "w2").crossJoin(F.broadcast(total))
    p = lambda c: (F.col(c) + F.lit(float(smoothing))) / F.col("total")
    npmi = F.log2(p("cf") / (p("c1") * p("c2"))) / -F.log2(p("cf"))
    return long.select("term", "n", "cf", npmi.alias("npmi")).where(F.col("npmi") > threshold)


def ids_of(column: str, rows: DataFrame) -> DataFrame:
    """value, id: the distinct values in order, from 0; null, NaN and -1 aren't among them."""
    known = rows.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    return known.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias("id"))


def factorize(rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, topic_id: labels as numbers from 0 in their order; a missing label (null) is -1."""
    ids = ids_of(label, rows)  # no hint: labels may be many, and a join of measured size broadcasts them if they are few
    return rows.join(ids, rows[label] == ids["value"], "left").select(key, F.coalesce("id", F.lit(-1)).alias("topic_id"))


def stems(rows: DataFrame, term: str = "term") -> DataFrame:
    """Distinct terms with their stem, by the suffix steps of Porter (1980); run over distinct terms, not tokens."""
    ready(rows.sparkSession)

    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return rows.select(term).distinct().withColumn("stem", stemmed(term))
