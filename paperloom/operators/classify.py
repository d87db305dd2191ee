"""Text classification: hashed word n-grams, inverse document frequencies and logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import tokens


def fit(rows: DataFrame, label: str, features: int = 1 << 14, regularisation: float = 0.01, iterations: int = 30) -> PipelineModel:
    """RET-14: a model of ``rows`` (text, label)."""
    stages = [
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(labelCol=label, regParam=regularisation, maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(with_words(rows).withColumn(label, F.col(label).cast("double")))


def with_words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("words", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")))


def predict(model: PipelineModel, docs: DataFrame, key: str, k: int = 2) -> DataFrame:
    """RET-14, TOP-08: (key, label, probability, top): the best class and the best k with their probabilities."""
    p = vector_to_array("probability")
    ranked = F.slice(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("m"), i.alias("label"), x.alias("p")))), 1, k)
    out = model.transform(with_words(docs.select(key, "text"))).withColumn("top", F.transform(ranked, lambda x: F.struct(x["label"].alias("label"), x["p"].alias("probability"))))
    return out.select(key, F.col("prediction").cast("int").alias("label"), F.col("top")[0]["probability"].alias("probability"), "top")
