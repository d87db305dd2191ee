"""Sparse retrieval: BM25 statistics, weights and ranking.

Ranking straight from texts counts only the terms that are asked for, in one pass over the texts: what is asked, and one
row for each document, is dealt by document once, and the vocabulary, the number of documents, their mean length and
the sums of scores are all drawn from that dealing. The asked terms and their vocabulary, which is no larger, are
broadcast if their number, checked first, allows it; beyond ``BROADCAST_TERMS`` they are joined by term instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import tokens

K1, B = 1.5, 0.75
BROADCAST_TERMS = 1 << 19  # some 50 MB


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """AGG-05: (key, term, tf, length) of each document."""
    words = docs.select(F.col(key), tokens(F.col(text)).alias("terms"))
    return words.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """AGG-04: one row (n_docs, avgdl)."""
    return docs.select(F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("length")).agg(F.count("*").alias("n_docs"), F.avg("length").alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5) + 1)


def _saturated() -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))


def model(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """AGG-04: (term, df, idf, avgdl) of ``counts`` (a row for each document and term) and the one row of ``stats``."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")


def weigh(counts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """RET-01: (key, term, idf, weight) under a ``model``; terms that it doesn't know have no weight:
    idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))."""
    return counts.join(known, "term").select(key, "term", "idf", (F.col("idf") * _saturated()).alias("weight"))


def index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """RET-01: (key, term, idf, weight) of every term of every document."""
    counts = term_counts(docs, key, text)
    return weigh(counts, model(counts, statistics(docs, text)), key)


def broadcast_if_few(terms: DataFrame) -> DataFrame:
    """``terms``, to be broadcast if their number is known to allow it."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def ranked(scored: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(indexed: DataFrame, key: str, queries: DataFrame, query_key: str, k: int, text: str = "text", squared_idf: bool = False) -> DataFrame:
    """RET-02, TOP-02: (query_key, key, score, rank) of the best k documents for each query, from weights that are there.

    ``squared_idf``: the query's terms weigh their idf once more, which the document weights contain already.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    gain = F.col("weight") * F.col("idf") if squared_idf else F.col("weight")
    scored = indexed.join(broadcast_if_few(asked), "term").groupBy(query_key, key).agg(F.round(F.sum(gain), 6).alias("score"))
    return ranked(scored, query_key, key, k)


def search_texts(docs: DataFrame, key: str, queries: DataFrame, query_key: str, k: int, squared_idf: Sequence[bool] = (False,), text: str = "text") -> list[DataFrame]:
    """RET-02, TOP-02: a list as ``search`` gives for each of ``squared_idf``, straight from texts and in one pass."""
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    small = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    bounded = F.broadcast if small else (lambda df: df)
    terms = bounded(asked.select("term").distinct().withColumn("asked", F.lit(True)))
    body = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    # A row of the empty term stands for each document, so one pass counts documents and words as well. It is told by
    # its value within sums, not by a filter, which would move below the dealing and make it anew; so would a test for
    # null that a join needs, and hence no term is null.
    words = docs.select(F.col(key), body.alias("terms")).select(key, F.size("terms").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.col("terms"))).alias("term")).withColumn("term", F.coalesce("term", F.lit("")))
    met = words.join(terms, "term", "left").filter("asked or term = ''").select(key, "length", "term").repartition(key)
    counts = met.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    held = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("length") * F.col("tf")).alias("total"), F.sum("tf").alias("n"))
    whole = held.agg(F.max(F.when(F.col("term") == "", F.struct("n", "total"))).alias("x")).select(F.col("x.n").alias("n_docs"), (F.col("x.total") / F.col("x.n")).alias("avgdl"))
    known = bounded(held.crossJoin(F.broadcast(whole)).select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"))
    sums = [F.round(F.sum(F.col("weight") * F.col("idf") if s else F.col("weight")), 6).alias(f"score{int(s)}") for s in dict.fromkeys(squared_idf)]
    scored = weigh(counts, known, key).join(bounded(asked), "term").groupBy(key, query_key).agg(*sums)
    return [ranked(scored.select(query_key, key, F.col(f"score{int(s)}").alias("score")), query_key, key, k) for s in squared_idf]


def group_terms(docs: DataFrame, group: str, k: int = 12) -> DataFrame:
    """WIN-15: the k terms of most BM25 weight for each group as one text; short terms and numbers are left out."""
    words = docs.select(group, F.explode(tokens(F.col("text"))).alias("term"))
    counts = words.groupBy(group, "term").agg(F.count("*").alias("tf"))
    lengths = counts.groupBy(group).agg(F.sum("tf").alias("length"))
    n = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avgdl"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scored = counts.join(df, "term").join(lengths, group).select(group, "term", F.round(idf(F.col("n_docs"), F.col("df")) * saturated, 6).alias("score"))
    scored = scored.filter((F.length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$"))
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
