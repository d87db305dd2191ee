"""Quality classifier by a sparse ensemble of rules.

A text is described by shares of characters, words and lines. Trees are grown on these statistics of labelled texts;
every path from a root to a node is a rule, a conjunction of bounds. A lasso logistic regression weighs the rules and
drops most of them. What is left is compiled into one Spark column expression over the statistics, so scoring is a map
without Python.

The fit rests on at most ``MOST`` labelled rows, those with the least hashes of their ids, in one partition: so it
doesn't depend on how the rows were dealt. Of them a quarter, told by a hash too, only chooses the penalty: the greatest
one whose loss there is within ``SLACK`` of the best one's; the weights are then fitted on all. Scoring covers all rows.

Cases: a null text is empty; an empty text has statistics 0 and a score like any other; a null label is none, and of
repeated labels of an id the greatest counts; labels without a document, and a null id, teach nothing; without labels
of both kinds the score is the smoothed share of good ones, (good + 1) / (labels + 2); rows with equal ids are scored
one by one; other columns are kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table

#: The most labelled rows that a model is fitted on.
MOST = 20000
TREES, DEPTH, BINS, LEAST_ROWS, SEED = 24, 3, 64, 5, 7
PENALTIES = (0.1, 0.03, 0.01, 0.003, 0.001)
SLACK = 0.002

STATISTICS = (
    "words", "word_length", "lower", "upper", "digits", "stops", "symbols", "distinct_words", "capital_words",
    "line_words", "stopped_lines", "distinct_lines",
)


def with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a struct ``__stat`` of ``STATISTICS`` of their ``text``, all doubles.

    Characters go class by class, so that each class is counted on what the ones before left.
    """
    kept = rows.columns
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda c: F.char_length(c).cast("double")
    rows = rows.withColumn("__t", body)
    rows = rows.withColumn("__ink", F.regexp_replace("__t", r"\s+", "")).withColumn("__words", F.filter(F.split("__t", r"\s+"), lambda w: w != ""))
    rows = rows.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: F.trim(x) != ""))
    left = "__ink"
    for name, kind in (("__lower", r"\p{Ll}+"), ("__upper", r"\p{Lu}+"), ("__digits", r"\p{Nd}+"), ("__stops", r"[.,;:!?'\"()-]+"), ("__symbols", r"[\p{L}\p{M}]+")):
        rows = rows.withColumn(name, F.regexp_replace(left, kind, ""))
        left = name
    ink, words, lines = count("__ink"), F.size("__words").cast("double"), F.size("__lines").cast("double")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    low = F.transform("__words", lambda w: F.lower(w))
    found = {
        "words": words,
        "word_length": share(ink, words),
        "lower": share(ink - count("__lower"), ink),
        "upper": share(count("__lower") - count("__upper"), ink),
        "digits": share(count("__upper") - count("__digits"), ink),
        "stops": share(count("__digits") - count("__stops"), ink),
        "symbols": share(count("__symbols"), ink),
        "distinct_words": share(F.size(F.array_distinct(low)).cast("double"), words),
        "capital_words": share(F.size(F.filter("__words", lambda w: w.rlike(r"^\p{Lu}"))).cast("double"), words),
        "line_words": share(words, lines),
        "stopped_lines": share(F.size(F.filter("__lines", lambda x: x.rlike(r"[.!?]\s*$"))).cast("double"), lines),
        "distinct_lines": share(F.size(F.array_distinct("__lines")).cast("double"), lines),
    }
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.struct(*[found[s].alias(s) for s in STATISTICS]).alias("__stat"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds (statistic, '<=' or '>', threshold), each statistic at most once on either side."""

    bounds: tuple[tuple[str, str, float], ...]

    def holds(self, stat: str = "__stat") -> Column:
        out = F.lit(True)
        for name, side, at in self.bounds:
            value = F.col(f"{stat}.{name}")
            out &= (value <= at) if side == "<=" else (value > at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {side} {at!r}" for name, side, at in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights; the log odds of a text are ``intercept`` and the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stat: str = "__stat") -> Column:
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds += F.when(rule.holds(stat), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def rules_of(trees: str) -> list[Rule]:
    """The paths to all nodes below the roots, from the printed form of a model of trees; equal ones once."""
    path: list[tuple[str, str, float]] = []
    found: dict[Rule, None] = {}
    base = 0
    for line in trees.splitlines():
        if "Tree " in line:
            base = len(line) - len(line.lstrip()) + 2
        test = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not test:
            continue
        depth = len(test[1]) - base
        path[depth:] = [(STATISTICS[int(test[2])], test[3], float(test[4]))]
        tight: dict[tuple[str, str], float] = {}
        for name, side, at in path:
            old = tight.get((name, side), at)
            tight[name, side] = min(old, at) if side == "<=" else max(old, at)
        found[Rule(tuple((name, side, at) for (name, side), at in sorted(tight.items())))] = None
    return list(found)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MOST) -> DataFrame:
    """(h, label, __stat) of at most ``most`` labelled rows of ``docs`` that aren't held out, in one partition.

    The ids are chosen first, so they are few enough to be broadcast, and no text moves.
    """
    by = F.xxhash64(F.col("k").cast("string"))
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("label")).dropna().groupBy("k").agg((F.max("label") > 0).cast("double").alias("label"))
    chosen = known.filter(~is_held_out(F.col("k"))).select("k", by.alias("h"), "label").orderBy("h", "k").limit(most)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").withColumn("th", F.xxhash64("t"))
    rows = with_statistics(rows, "t").select("h", "k", "th", "label", "__stat")
    return checkpoint(rows.orderBy("h", "k", "th").limit(most).select("h", "label", "__stat").coalesce(1))


def _fitted(rows: DataFrame, penalty: float):
    return LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST) -> Ensemble:
    """An ensemble from the labelled texts that aren't held out."""
    rows = sample(docs, labels, key, text, label, most)
    good, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).collect()[0]
    if good in (0, total):
        return Ensemble(_log_odds(good, total), ())
    vectors = VectorAssembler(inputCols=[f"s_{s}" for s in STATISTICS], outputCol="features")
    grown = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, minInstancesPerNode=LEAST_ROWS, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED)
    rules = rules_of(grown.fit(vectors.transform(rows.select("label", *[F.col(f"__stat.{s}").alias(f"s_{s}") for s in STATISTICS]))).toDebugString)
    if not rules:
        return Ensemble(_log_odds(good, total), ())
    marks = rows.select("h", "label", *[r.holds().cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    marks = checkpoint(VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(marks).select("h", "label", "features"))
    chooses = F.pmod("h", F.lit(4)) == 0
    learn, judge = marks.filter(~chooses), marks.filter(chooses)
    loss = {}
    if learn.select("label").distinct().count() == 2 and not judge.isEmpty():
        for penalty in PENALTIES:
            p = F.element_at(vector_to_array("probability"), 2)
            told = F.greatest(F.when(F.col("label") > 0, p).otherwise(1 - p), F.lit(1e-9))
            loss[penalty] = _fitted(learn, penalty).transform(judge).agg(F.avg(-F.log(told))).collect()[0][0]
    best = min(loss.values(), default=0.0)
    penalty = max((x for x in loss if loss[x] <= best + SLACK), default=PENALTIES[-1])
    model = _fitted(marks, penalty)
    weighed = zip(rules, model.coefficients.toArray().tolist(), strict=True)
    return Ensemble(float(model.intercept), tuple((r, w) for r, w in weighed if w))


def _log_odds(good: float, total: float) -> float:
    return math.log((good + 1) / (total - good + 1))


def score(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``rated``: score (0 to 1, higher: better) and predicted (1 if score >= 0.5, else 0)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = with_statistics(docs.select(row).withColumn("__body", F.col("__row")[text]), "__body").withColumn("__score", model.score())
    rated = F.struct(F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted")).alias("rated")
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c != "rated"], rated)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document of ``documents``, rated by an ensemble of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    done = score(docs.select("doc_id", "text"), model)
    return done.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("rated.score").alias("score"), F.col("rated.predicted").alias("predicted"))
