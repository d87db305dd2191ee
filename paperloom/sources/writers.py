"""Writers. Repeating a write leaves the same rows: what a document or batch has is replaced as a whole.

Rows that belong to a document lie in one of ``BUCKETS`` folders by a hash of its id, whatever the number of documents.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import NAMESPACE_DNS, uuid5

BUCKETS = 64
BUCKET = "bucket__"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def replace_parts(df: DataFrame, path: str, by: list[str], form: str = "parquet", buckets: int = BUCKETS) -> None:
    """SNK-03, SNK-08, STM-05: the rows of ``df`` take the place of those in ``path`` with the same ``by``; others stay.

    Only buckets that ``df`` has rows in are written anew. Old and new rows are first written beside the table, since a
    folder can't be read and replaced at once.
    """
    spark, name = df.sparkSession, path.rstrip("/")
    fresh = df.withColumn(BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    aside = f"{name}.new-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{aside}/fresh")
    rows = spark.read.parquet(f"{aside}/fresh")
    if exists(spark, name):
        touched = F.broadcast(rows.select(BUCKET).distinct())  # BUCKETS rows at most
        gone = rows.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(BUCKET).alias("__bucket")).distinct()
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col(BUCKET) == F.col("__bucket"))
        left = spark.read.schema(fresh.schema).format(form).load(name).join(touched, BUCKET, "left_semi").join(gone, same, "left_anti")
        rows.unionByName(left).write.parquet(f"{aside}/both")
        rows = spark.read.parquet(f"{aside}/both")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).format(form).save(name)
    files, at = _files(spark, aside)
    files.delete(at, True)


def with_point_ids(chunks: DataFrame, document: str, index: str) -> DataFrame:
    """SNK-11: the point id of a chunk, from its document and index."""
    return chunks.withColumn("point_id", uuid5(NAMESPACE_DNS, F.concat_ws(":", F.col(document).cast("string"), F.col(index).cast("string"))))


def hierarchy_json(sections: DataFrame, path: str, document: str = "document_id") -> None:
    """SNK-15: one object of sections for each document, a JSON line each."""
    fields = [c for c in sections.columns if c not in (document, "idx")]
    rows = sections.groupBy(document).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("s")))), lambda x: x["s"]).alias("sections"))
    rows.write.mode("overwrite").json(path)


def bm25_model(terms: DataFrame, stats: DataFrame, path: str) -> None:
    """SNK-14: a model that can be loaded: the vocabulary (term, df, idf) and one row (n_docs, avgdl, k1, b)."""
    from paperloom.operators import bm25

    terms.select("term", "df", "idf").write.mode("overwrite").parquet(f"{path}/terms")
    stats.select("n_docs", "avgdl", F.lit(bm25.K1).alias("k1"), F.lit(bm25.B).alias("b")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def artifacts(df: DataFrame, path: str, document: str = "document_id") -> None:
    """SNK-16, SNK-17: JSON rows of documents or hashes; what a document had is replaced."""
    replace_parts(df, path, [document], "json")


def index_documents(docs: DataFrame, path: str, document: str = "document_id", text: str = "text", force: bool = False) -> None:
    """SNK-12, RET-06: documents that the index doesn't have yet are chunked and added to it; with ``force`` all of
    ``docs`` are, and take the place of what they had.

    A call writes a batch of postings (document, chunk_index, term, tf, length), then a batch of chunks with point ids;
    the chunks commit it, so a call that failed between leaves nothing that counts. ``readers.chunk_index`` shows the
    newest batch of each document, and the model over all of them. Null ids are never indexed.
    """
    from paperloom.operators import bm25, chunking

    spark = docs.sparkSession
    docs = docs.filter(F.col(document).isNotNull())
    if not force and exists(spark, f"{path}/chunks"):
        docs = docs.join(spark.read.parquet(f"{path}/chunks").select(document).distinct(), document, "left_anti")
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    aside = f"{path.rstrip('/')}.new-{batch}"
    with_point_ids(chunking.split_windows(docs, document, text), document, "chunk_index").write.parquet(aside)
    chunks = spark.read.parquet(aside)
    if not chunks.isEmpty():
        key = F.struct(F.col(document), F.col("chunk_index"))
        counts = bm25.term_counts(chunks.select(key.alias("chunk"), F.col("content").alias("text")), "chunk")
        counts.select(f"chunk.{document}", "chunk.chunk_index", "term", "tf", "length").write.parquet(f"{path}/postings/batch={batch}")
        chunks.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/chunks")
    files, at = _files(spark, aside)
    files.delete(at, True)


def dataset(steps: DataFrame, hits: DataFrame, question: str, path: str) -> None:
    """SNK-20: a JSON line for each question with its step, contexts in order and their ids."""
    listed = hits.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content"))).alias("h"))
    rows = steps.join(listed, question, "left").withColumn("contexts", F.transform("h", lambda x: x["content"])).withColumn("chunk_ids", F.transform("h", lambda x: x["chunk_id"])).drop("h")
    rows.write.mode("overwrite").json(path)
