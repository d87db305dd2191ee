"""Fusing, filtering and thinning ranked candidates of many questions at once.

A candidate list is a DataFrame with a question key, a chunk key, a score and a rank from 1. All operators partition
by question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(lists: list[DataFrame], question: str, chunk: str, k: int, constant: int = 60) -> DataFrame:
    """WIN-01: (question, chunk, score, rank) by the sum of 1 / (constant + rank) over the lists."""
    every = lists[0].select(question, chunk, "rank")
    for other in lists[1:]:
        every = every.unionAll(other.select(question, chunk, "rank"))
    fused = every.groupBy(question, chunk).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    order = Window.partitionBy(question).orderBy(F.col("score").desc(), chunk)
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_per_key(hits: DataFrame, key: list[str], score: str, position: str) -> DataFrame:
    """WIN-14, SET-01: of the hits with one key the one of the highest score; of equal scores the first."""
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), position)
    return hits.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at")


def adaptive_threshold(best: Column, base: float = 0.35) -> Column:
    """FIL-11: ``base``, or 0.8 of the best score where that is under 0.30; ``base`` where there is none."""
    return F.when(best.isNull(), base).when(best < 0.30, best * 0.8).otherwise(base)


def above_threshold(hits: DataFrame, question: str, score: str, rank: str, base: float = 0.35, least: int = 2, adaptive: bool = True) -> DataFrame:
    """FIL-10: hits at or over the question's threshold; where fewer than ``least`` are, the first ``least``."""
    whole = Window.partitionBy(question)
    threshold = adaptive_threshold(F.max(score).over(whole), base) if adaptive else F.lit(base)
    marked = hits.withColumn("threshold", threshold)
    marked = marked.withColumn("passed", F.count_if(F.col(score) >= F.col("threshold")).over(whole))
    return marked.filter(F.when(F.col("passed") >= least, F.col(score) >= F.col("threshold")).otherwise(F.col(rank) <= least)).drop("passed")


def without_unlabeled(hits: DataFrame, question: str, title: str, unlabeled: str = "Unlabeled Section") -> DataFrame:
    """FIL-12: hits without a section go where they are a minority, of at most half."""
    whole = Window.partitionBy(question)
    n = F.count_if(F.col(title) == unlabeled).over(whole)
    marked = hits.withColumn("__n", n).withColumn("__all", F.count("*").over(whole))
    return marked.filter((F.coalesce(F.col(title), F.lit("")) != unlabeled) | (F.col("__n") * 2 > F.col("__all"))).drop("__n", "__all")


def thin_near_duplicates(hits: DataFrame, question: str, chunk: str, text: str, rank: str, threshold: float = 0.6) -> DataFrame:
    """RET-11: in rank order, a hit stays unless its words have a Jaccard likeness over ``threshold`` with those of a
    hit that stayed. A fold over each question's list, which retrieval has cut to its best few."""
    words = F.array_distinct(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    listed = hits.select(question, F.struct(F.col(rank).cast("int").alias("rank"), F.col(chunk).alias("chunk"), words.alias("words")).alias("hit")).groupBy(question).agg(F.array_sort(F.collect_list("hit")).alias("hits"))

    def alike(a: Column, b: Column) -> Column:
        either = F.size(F.array_union(a, b))
        return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)

    kept = F.aggregate("hits", F.filter("hits", lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: alike(x["words"], y["words"]) > threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return listed.select(question, F.explode(kept).alias("hit")).select(question, F.col("hit.chunk").alias(chunk), F.col("hit.rank").alias(rank))


def rank_changes(before: DataFrame, after: DataFrame, question: str, chunk: str) -> DataFrame:
    """WIN-02: rank and score of each reranked hit beside those it had."""
    old = before.select(question, chunk, F.col("rank").alias("rank_before"), F.col("score").alias("score_before"))
    new = after.select(question, chunk, F.col("rank").alias("rank_after"), F.col("score").alias("score_after"))
    return new.join(old, [question, chunk], "left").withColumn("score_change", F.round(F.col("score_after") - F.col("score_before"), 6))


def rerank(hits: DataFrame, question: str, score: Column, top_n: int, cap: int = 12) -> DataFrame:
    """TOP-03, TOP-04: by a new score, the best ``top_n`` of at most ``cap``; the old score is kept beside."""
    order = Window.partitionBy(question).orderBy(F.col("score").desc(), "rank")
    new = hits.withColumn("retrieval_score", F.col("score")).withColumn("retrieval_rank", F.col("rank")).withColumn("score", score)
    return new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(top_n, cap))


def with_fallback(scoped: DataFrame, wider: DataFrame, question: str, chunk: str, least: int = 3) -> DataFrame:
    """RET-09, SET-01: the scoped hits, and for questions with fewer than ``least`` of them the wider ones too."""
    few = wider.select(question).distinct().join(scoped.groupBy(question).agg(F.count("*").alias("n")), question, "left").filter(F.coalesce("n", F.lit(0)) < least).select(question)
    both = scoped.withColumn("stage", F.lit(0)).unionByName(wider.join(few, question, "left_semi").withColumn("stage", F.lit(1)))
    order = Window.partitionBy(question, chunk).orderBy(F.col("score").desc(), "stage", "rank")
    return both.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at")
