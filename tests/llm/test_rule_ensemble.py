import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from paperloom.llm import rule_ensemble as rules

from .fixtures import clashing, frame, odd_documents, words


def plain_statistics(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    found = [w for w in re.split(f"[{space}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    ink = [c for c in text if c not in space]
    n = len(ink)
    of = lambda test: sum(map(test, ink)) / n if n else 0.0
    kind = unicodedata.category
    stops = ".,;:!?'\"()-"
    return {
        "words": float(len(found)),
        "word_length": n / len(found) if found else 0.0,
        "lower": of(lambda c: kind(c) == "Ll"),
        "upper": of(lambda c: kind(c) == "Lu"),
        "digits": of(lambda c: kind(c) == "Nd"),
        "stops": of(lambda c: c in stops),
        "symbols": of(lambda c: c not in stops and kind(c) != "Nd" and kind(c)[0] not in "LM"),
        "distinct_words": len({w.lower() for w in found}) / len(found) if found else 0.0,
        "capital_words": sum(kind(w[0]) == "Lu" for w in found) / len(found) if found else 0.0,
        "line_words": len(found) / len(lines) if lines else 0.0,
        "stopped_lines": sum(bool(re.search(f"[.!?][{space}]*$", x)) for x in lines) / len(lines) if lines else 0.0,
        "distinct_lines": len(set(lines)) / len(lines) if lines else 0.0,
    }


def plain_score(model, text):
    stat = plain_statistics(text)
    odds = model.intercept
    for rule, weight in model.rules:
        if all(stat[name] <= at if side == "<=" else stat[name] > at for name, side, at in rule.bounds):
            odds += weight
    return 1 / (1 + math.exp(-odds))


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    return docs, labels


@pytest.fixture(scope="module")
def model(tables):
    return rules.fit(*tables)


def test_statistics(spark):
    rows = [(r[0], r[1]) for r in odd_documents()] + [(50, "A b. \n\nA b. \n12 Ünd?  \t"), (51, "a | b | c ***"), (52, "\n\n"), (53, "é x")]
    got = rules.with_statistics(frame(spark, rows, "doc_id long, text string"), "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["__stat"].asDict() == pytest.approx(plain_statistics(r.text)), r.doc_id


def test_score_is_that_of_the_rules(spark, model):
    docs = clashing(frame(spark, odd_documents())).withColumnRenamed("own", "rated").withColumnRenamed("base", "__stat")
    done = rules.score(docs, model)
    assert sorted(done.columns) == sorted(docs.columns) and done.count() == len(odd_documents())
    for r in done.collect():
        want = plain_score(model, r.text)
        assert r.rated.score == pytest.approx(want) and r.rated.predicted == int(want >= 0.5) and r.score == "extra"


def test_few_rules_and_held_out_accuracy(spark, tables, model):
    docs, labels = tables
    assert 0 < len(model.rules) < 60 and all(1 <= len(r.bounds) <= 2 * rules.DEPTH for r, _ in model.rules)
    rated = rules.score(docs, model).join(labels, "doc_id").select("doc_id", "quality", "rated.*").collect()
    away = [r for r in rated if held_out(r.doc_id)]
    assert len(away) > 50 and np.mean([r.quality == r.predicted for r in away]) > 0.97
    for quality in (0, 1):
        assert np.mean([r.predicted == quality for r in away if r.quality == quality]) > 0.9


def test_held_out_rows_teach_nothing(spark, tables, model):
    docs, labels = tables
    away = rules.is_held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(away, 1 - F.col("quality")).otherwise(F.col("quality")))
    junk = docs.withColumn("text", F.when(away, "1 2 3").otherwise(F.col("text"))).withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    assert rules.fit(junk, turned).rules == model.rules
    seen = rules.sample(docs, labels, "doc_id", "text", "quality")
    assert seen.count() == sum(not held_out(r.doc_id) for r in labels.collect()) and seen.rdd.getNumPartitions() == 1
    assert rules.sample(docs, labels, "doc_id", "text", "quality", most=10).count() == 10


def test_weights_are_the_lasso(spark):
    rng = np.random.default_rng(5)
    marks = (rng.random((400, 6)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * marks[:, 0] - 1.5 * marks[:, 1] - 0.2)))).astype(float)
    got = rules._fitted(spark.createDataFrame([(float(t), Vectors.dense(m)) for t, m in zip(y, marks, strict=True)], ["label", "features"]), 0.03)
    scaled = marks / marks.std(axis=0, ddof=1)
    w, b = np.zeros(6), 0.0
    for _ in range(20000):  # proximal gradient
        error = 1 / (1 + np.exp(-(scaled @ w + b))) - y
        b -= error.mean()
        w = w - 0.1 * (scaled.T @ error) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * 0.03, 0)
    assert got.coefficients.toArray() == pytest.approx(w / marks.std(axis=0, ddof=1), abs=0.01)
    assert got.intercept == pytest.approx(b, abs=0.01) and (w == 0).sum() >= 2


def test_rules_of_printed_trees():
    printed = """Model: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 3.5)
     If (feature 0 <= 1.5)
      Predict: 1.0
     Else (feature 0 > 1.5)
      Predict: 0.0
    Else (feature 0 > 3.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 3.5)
     Predict: 1.0
    Else (feature 0 > 3.5)
     Predict: 0.0
"""
    assert [str(r) for r in rules.rules_of(printed)] == ["words <= 3.5", "words <= 1.5", "words <= 3.5 and words > 1.5", "words > 3.5"]


def test_odd_labels(spark):
    docs = frame(spark, odd_documents())
    none = rules.fit(docs, frame(spark, [], "doc_id long, quality int"))
    assert none == rules.Ensemble(0.0, ())
    good = [i for i in range(12) if not held_out(i)]
    one = rules.fit(docs, frame(spark, [(i, 1) for i in good] + [(good[0], 0), (None, 0), (good[1], None), (999, 0)], "doc_id long, quality int"))
    n = sum(r[0] in good for r in odd_documents())
    assert one.rules == () and one.intercept == pytest.approx(math.log(n + 1))
    few = rules.fit(docs, frame(spark, [(good[0], 0), (good[1], 1)], "doc_id long, quality int"))
    assert rules.score(docs, few).count() == len(odd_documents())
    assert rules.score(frame(spark, []), none).count() == 0


def test_long_text(spark):
    text = words(9, 300000)
    got = rules.with_statistics(frame(spark, [(1, text)], "doc_id long, text string"), "text").collect()[0]
    assert got["__stat"].words == 300000
