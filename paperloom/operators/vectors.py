"""Dense retrieval: cosine search of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """RET-04: (query_id, key, score, rank): the k rows nearest to each query by cosine, itself left out.

    The queries go out in blocks of ``BLOCK`` rows; each batch of rows is multiplied with a block at once and keeps its
    own best k for each query, so what is shuffled is k rows for each query and batch.
    """
    asked = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v")).filter("v is not null")
    n = asked.count()
    parts = []
    for block in range(max(1, -(-n // BLOCK))):
        some = asked.filter(F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n // BLOCK)))) == block).toPandas()
        parts.append(_best(vectors.select(F.col(key).cast("long").alias(key), vector), some, k, key))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best(vectors: DataFrame, asked, k: int, key: str) -> DataFrame:
    import numpy as np

    ids = asked["q"].to_numpy(dtype=np.int64)
    matrix = np.array([np.asarray(v, dtype=np.float64) for v in asked["v"]]) if len(asked) else np.zeros((0, 1))
    norms = np.sqrt((matrix * matrix).sum(axis=1)) if len(asked) else np.zeros(0)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows or not len(ids):
                continue
            own = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            data = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(own), -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.round(np.nan_to_num((matrix @ data.T) / (norms[:, None] * np.sqrt((data * data).sum(axis=1))[None, :])), 6)
            score[ids[:, None] == own[None, :]] = -np.inf
            top = np.lexsort((np.broadcast_to(own, score.shape), -score))[:, :k]
            q = np.repeat(ids, top.shape[1])
            s = np.take_along_axis(score, top, axis=1).ravel()
            keep = s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(own[top].ravel()[keep]), pa.array(s[keep])], names=["query_id", key, "score"])

    return vectors.mapInArrow(rows, f"query_id long, {key} long, score double")
