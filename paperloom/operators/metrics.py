"""Ranking quality: a run (question, item, rank) against relevant items (question, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(run: DataFrame, relevant: DataFrame, question: str, item: str) -> DataFrame:
    """The run with ``hit``, and every question with relevant items, of which ``n_relevant`` there are."""
    wanted = relevant.select(question, item).distinct()
    totals = wanted.groupBy(question).agg(F.count("*").alias("n_relevant"))
    hits = run.join(wanted.withColumn("hit", F.lit(True)), [question, item], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return hits.join(totals, question, "full").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))


def precision_at(k: int, item: str) -> Column:
    """WIN-04: distinct hits of the first k, over k."""
    return F.count_distinct(F.when(F.col("hit") & (F.col("rank") <= k), F.col(item))) / F.lit(k)


def recall_at(k: int, item: str) -> Column:
    """WIN-05: distinct hits of the first k, over the number of relevant items; 0 without any."""
    return F.coalesce(F.try_divide(F.count_distinct(F.when(F.col("hit") & (F.col("rank") <= k), F.col(item))), F.max("n_relevant")), F.lit(0.0))


def reciprocal_rank(k: int) -> Column:
    """WIN-03: 1 over the rank of the first hit of the first k, else 0."""
    return F.coalesce(1.0 / F.min(F.when(F.col("hit") & (F.col("rank") <= k), F.col("rank"))), F.lit(0.0))


def ndcg_at(k: int) -> Column:
    """WIN-06: gains of 1 over log2(rank + 1), against those of an ideal list; hits count as often as they come."""
    gain = F.coalesce(F.sum(F.when(F.col("hit") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.max("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return F.when(F.max("n_relevant") > 0, gain / ideal).otherwise(0.0)


def per_question(run: DataFrame, relevant: DataFrame, question: str, item: str, precisions=(2, 5), recalls=(3, 5), mrr: int = 5, ndcgs=(10,)) -> DataFrame:
    """All measures of each question, rounded to six places."""
    measures = {f"precision_at_{k}": precision_at(k, item) for k in precisions} | {f"recall_at_{k}": recall_at(k, item) for k in recalls} | {"reciprocal_rank": reciprocal_rank(mrr)} | {f"ndcg_at_{k}": ndcg_at(k) for k in ndcgs}
    return judged(run, relevant, question, item).groupBy(question).agg(*[F.round(c, 6).alias(n) for n, c in measures.items()])


def means(measured: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-06, AGG-07: number of questions and mean of every measure, over all or by columns."""
    names = [c for c in measured.columns if c.startswith(("precision", "recall", "reciprocal", "ndcg"))]
    return measured.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def failure(retrieved: Column, filtered: Column, final: Column) -> Column:
    """WIN-19: where a question's relevant items were lost."""
    return F.when(final, "ok").when(filtered, "rerank").when(retrieved, "filter").otherwise("recall")


def length_bin(n_words: Column) -> Column:
    """WIN-20."""
    return F.when(n_words <= 8, "<=8").when(n_words <= 16, "9-16").otherwise("17+")


def slices(measured: DataFrame, by: str, state: str = "state") -> DataFrame:
    """AGG-10: of each slice n, the share that is ok, mean recall and MRR, and the most common failure, the first by
    name of equals; null if there is none."""
    recall = next(c for c in measured.columns if c.startswith("recall"))
    whole = measured.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col(state) == "ok").cast("int")), 6).alias("ok_rate"), F.round(F.avg(recall), 6).alias("mean_recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
    counts = measured.filter(F.col(state) != "ok").groupBy(by, state).agg(F.count("*").alias("c"))
    common = counts.groupBy(by).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(state).alias("s")))["s"].alias("top_failure"))
    return whole.join(common, by, "left")


def stages(runs: DataFrame, relevant: DataFrame, question: str, item: str, stage: str, cuts=(1, 3, 5, 10)) -> DataFrame:
    """AGG-09: for each stage and cut the mean recall and nDCG over the questions with relevant items, and the MRR."""
    asked = relevant.select(question).distinct().crossJoin(F.broadcast(runs.select(stage).distinct()))  # a handful of stages
    wanted = relevant.select(question, item).distinct()
    totals = wanted.groupBy(question).agg(F.count("*").alias("n_relevant"))
    hits = runs.join(wanted.withColumn("hit", F.lit(True)), [question, item], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    every = asked.join(totals, question).join(hits, [question, stage], "left")
    measured = every.groupBy(question, stage).agg(*[recall_at(k, item).alias(f"r{k}") for k in cuts], *[ndcg_at(k).alias(f"n{k}") for k in cuts], reciprocal_rank(max(cuts)).alias("rr"))
    tall = measured.select(stage, "rr", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k in cuts])).alias("x"))
    return tall.groupBy(stage, F.col("x.k").alias("k")).agg(F.round(F.avg("x.r"), 6).alias("recall"), F.round(F.avg("x.n"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr"))
