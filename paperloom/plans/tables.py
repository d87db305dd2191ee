"""The driver's tables and relations drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, idx, text): the lines of documents that aren't blank; the stand-in for text blocks."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("idx", "text")).filter("trim(text) <> ''").withColumn("idx", F.col("idx").cast("long"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, idx, title, level, numbering, page): lines of up to six words as headings; the level follows from
    the number of words, the numbering is the place where it is divisible by three, a page has four lines."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    rows = lines(spark, sf_dir).withColumn("n", n).filter("n <= 6")
    return rows.select("document_id", "idx", F.trim("text").alias("title"), ((F.col("n") + 1) / 2).cast("int").alias("level"), F.when(F.col("idx") % 3 == 0, F.col("idx").cast("string")).alias("numbering"), F.floor(F.col("idx") / 4).cast("long").alias("page"))


LINES_SQL = """
lines AS (
  SELECT document_id, idx, text FROM (
    SELECT doc_id AS document_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS idx, unnest(string_split(text, chr(10))) AS text FROM documents)
  WHERE trim(text) <> ''
)"""
SECTIONS_SQL = LINES_SQL + """,
sections AS (
  SELECT document_id, idx, trim(text) AS title, ((n + 1) // 2)::INT AS level, CASE WHEN idx % 3 = 0 THEN idx::VARCHAR END AS numbering, (idx // 4)::BIGINT AS page
  FROM (SELECT *, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM lines) WHERE n <= 6
)"""
TOKENS_SQL = r"""list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+'), lambda x: x <> '')"""


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.format(column)


__all__ = ["LINES_SQL", "SECTIONS_SQL", "T", "lines", "sections", "table", "tokens_sql"]
