import glob

import pytest
from pyspark.sql import functions as F

from paperloom.operators import cells, vectors


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    cells.build(table, path)
    return path


def listed(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_every_row_is_indexed_and_recall_is_over_nine_tenths(spark, table, index):
    assert spark.read.parquet(f"{index}/rows").select("id").distinct().count() == table.count()
    asked = table.filter("vec_id % 100 = 0")
    near = {(r[0], r[2]) for r in listed(cells.search(spark, index, asked, 10))}
    exact = {(r[0], r[2]) for r in listed(vectors.cosine_topk(table, asked, 10))}
    recall = len(near & exact) / len(exact)
    probes, held = spark.read.parquet(f"{index}/probes").collect()[0].probes, spark.read.parquet(f"{index}/cells").count()
    print("recall", recall, "probes", probes, "cells", held)
    assert probes < held
    assert recall >= 0.9


def test_all_probes_are_exact(spark, table, index, monkeypatch):
    monkeypatch.setattr(cells, "SLICE", 50)
    monkeypatch.setattr(cells, "BLOCK", 7)
    asked = table.filter("vec_id % 100 = 0")
    assert listed(cells.search(spark, index, asked, 10, probes=10**6)) == listed(vectors.cosine_topk(table, asked, 10))


def test_cells_that_nothing_asks_for_are_not_read(spark, table, index):
    one = table.filter("vec_id = 0")
    found = cells.search(spark, index, one, 5, probes=2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert cells.search(spark, index, one, 5, probes=2).count() == found.count() == 5
        plan = cells.search(spark, index, one, 5, probes=2)
        plan.collect()
        leaves, files = plan._jdf.queryExecution().executedPlan().collectLeaves(), []
        for k in range(leaves.size()):
            n = leaves.apply(k).metrics().get("numFiles")
            files += [n.get().value()] if n.isDefined() else []
        assert 0 < max(files) <= len(glob.glob(f"{index}/rows/*/*.parquet")) / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [0.0, -1.0]), (5, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cells.build(df, f"{tmp_path}/a", cells=2)
    got = listed(cells.search(spark, f"{tmp_path}/a", df, 2, probes=9))
    assert [r for r in got if r[0] == 1] == [(1, 1, 2, 1.0), (1, 2, 3, 0.0)] and {r[0] for r in got} == {1, 2, 3, 5}
    cells.build(df.limit(0), f"{tmp_path}/b")
    assert cells.search(spark, f"{tmp_path}/b", df, 2).count() == 0
    cells.build(df.filter(F.col("vec_id") == 3), f"{tmp_path}/c")
    assert listed(cells.search(spark, f"{tmp_path}/c", df.filter("vec_id = 1"), 2)) == [(1, 1, 3, 0.0)]
