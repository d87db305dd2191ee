"""An approximate vector index: rows stored by the nearest of some centroids, searched in a few cells for each query.

Centroids are fitted by cosine on at most ``SAMPLE`` vectors, those with the least hashes; every row is assigned and
stored in its cell's folder. A query is compared with the rows of its ``probes`` nearest cells, by the exact cosine;
with as many probes as there are cells the search is exact, like ``vectors.cosine_topk``. Folders of cells that no
query asks for are not read.

How many probes are needed depends on how the vectors lie, so it is measured when the index is built: for ``ASKED``
rows, those with the least hashes, the exact neighbours are found, and as many probes are kept as reach the cells of
``RECALL`` of them.

The number of cells grows with the root of the number of rows up to ``MOST_CELLS``, so centroids fit anywhere. Rows of a
cell are dealt in slices of about ``SLICE``, its queries in blocks of about ``BLOCK``: a task holds one block and one
batch of rows, however large a cell is, and what leaves it is k rows for each query and batch.

Cases: null vectors and null keys are left out, as rows and as queries; a vector of zeros has cosine 0 with all, and lies
in the first cell; ties go by key; a row is not among its own neighbours; without a vector there is one cell and no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, MOST_CELLS, SEED, ROUNDS = 50000, 4096, 7, 15
ASKED, NEAREST, RECALL = 256, 10, 0.95
SLICE, BLOCK = 1 << 16, 2048


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()


def centroids(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> list[list[float]]:
    """The centers of ``rows`` (id, v)."""
    n = rows.count()
    cells = cells or min(MOST_CELLS, max(1, math.isqrt(n)))
    some = rows.filter(F.exists("v", lambda x: x != 0)).select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(sample)
    fitted = some.select(array_to_vector("v").alias("features")).coalesce(1)
    if fitted.count() <= 1:
        return [[float(x) for x in r.features] for r in fitted.collect()] or [[]]
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=ROUNDS, seed=SEED).fit(fitted)
    return [c.tolist() for c in model.clusterCenters()]


def _nearest(centers: list[list[float]], most: int):
    """A function of vectors: the ``most`` nearest cells of each, nearest first."""

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        matrix = np.array(centers, dtype=np.float64)
        for vectors in batches:
            if not matrix.shape[1] or not len(vectors):
                yield pd.Series([[0]] * len(vectors))
                continue
            unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            likeness = np.vstack(vectors.to_list()) @ unit.T
            yield pd.Series(list(np.argsort(-likeness, axis=1, kind="stable")[:, :most].astype(np.int32)))

    return found


def build(df: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> None:
    """RET-04: the index of all rows of ``df``, in place of what ``path`` held."""
    spark = df.sparkSession
    rows = _vectors(df, key, vector)
    centers = centroids(rows, cells, sample)
    dealt = rows.withColumn("cell", _nearest(centers, 1)(F.col("v"))[0])
    dealt.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/rows")
    spark.createDataFrame(list(enumerate(centers)), "cell int, center array<double>").join(stored.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    asked = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(ASKED)
    exact = search(spark, path, asked, NEAREST, len(centers), "id", "v").select("query_id", "id")
    homes = exact.join(stored.select("id", "cell"), "id").join(asked.select(F.col("id").alias("query_id"), _nearest(centers, len(centers))(F.col("v")).alias("order")), "query_id")
    needed = homes.select(F.array_position("order", F.col("cell")).cast("int").alias("n")).agg(F.expr(f"percentile_disc({RECALL}) WITHIN GROUP (ORDER BY n)").alias("probes"))
    needed.select(F.coalesce(F.col("probes").cast("int"), F.lit(1)).alias("probes")).write.mode("overwrite").parquet(f"{path}/probes")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """RET-04: (query_id, key, score, rank): the best k rows of each query's ``probes`` nearest cells (unless given, as
    many as were measured) by cosine, itself left out."""
    probes = probes or spark.read.parquet(f"{path}/probes").collect()[0].probes
    known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS at most
    asked = _vectors(queries, key, vector).select("id", "v", F.explode(_nearest([list(r.center) for r in known], probes)(F.col("v"))).alias("cell"))
    slices = spark.createDataFrame([(r.cell, -(-r.n // SLICE)) for r in known if r.n], "cell int, slices int")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(slices.join(blocks, "cell"))  # a row for each cell
    wanted = [r.cell for r in blocks.collect()]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/rows").filter(F.col("cell").isin(wanted))
    left = rows.join(plan, "cell").select("cell", part("slices").alias("slice"), upto("blocks").alias("block"), F.lit(1).alias("kind"), "id", "v")
    right = asked.join(plan, "cell").select("cell", upto("slices").alias("slice"), part("blocks").alias("block"), F.lit(0).alias("kind"), "id", "v")
    met = right.unionByName(left).repartition("cell", "slice", "block").sortWithinPartitions("cell", "slice", "block", "kind").mapInArrow(_best(k), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "score", "rank")


def _best(k: int):
    """The best k rows of each batch for each query of its group; a group's queries come before its rows."""

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, ids, held, matrix = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if tuple(place[lo, :3]) != group:
                    group, ids, held, matrix = tuple(place[lo, :3]), [], [], None
                own = batch.column(4).slice(lo, hi - lo).to_numpy()
                data = batch.column(5).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                data = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
                if place[lo, 3] == 0:
                    ids.append(own)
                    held.append(data)
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix, asked = np.vstack(held), np.concatenate(ids)
                score = np.round(matrix @ data.T, 6) + 0.0
                score[asked[:, None] == own[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(own, score.shape), -score))[:, :k]
                q, s = np.repeat(asked, top.shape[1]), np.take_along_axis(score, top, axis=1).ravel()
                keep = s > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(own[top].ravel()[keep]), pa.array(s[keep])], names=["query_id", "id", "score"])

    return found
