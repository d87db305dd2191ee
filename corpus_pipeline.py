"""From raw documents to a mix: language ID, line dedup, near-duplicate join, decontamination, source weights.

Each stage is (name, function of (spark, docs, sf_dir)); what one returns is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of documents. Stages that hand texts to Python set the bytes of
an Arrow batch for the session (``common.BATCH``), since they are written after they return; ``run`` sets it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontam, fair_queue, jaccard_join, lang_mixture, template_lines
from paperloom.llm.common import BATCH, BATCH_BYTES, shared_folder, small_batches, table, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least share of a document's main language.
LEAST_SHARE = 0.5
#: Near duplicates: words of a shingle, and the least likeness. op9's query keeps its own.
NEAR_WORDS, NEAR_LIKE = 5, (80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, and mixtures without a main language, go."""
    spark.conf.set(BATCH, BATCH_BYTES)
    model = lang_mixture.fit(docs)
    found = lang_mixture.predict(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != lang_mixture.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; those of which nothing is left go."""
    done = template_lines.dedup(docs.select(*COLUMNS))
    touched = F.size("line_dedup.dropped") > 0
    left = done.filter(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(touched, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id, and of the least text hash among rows of
    that id; of repeated rows one.

    Rows that share an id are told apart by their text, whether they lie in one group or in several. A null id comes
    last. Documents without words are in no group: one of each id and text stays.
    """
    deal = F.xxhash64("__id", "__key").alias("__deal")
    docs = docs.select(*COLUMNS, F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__key"))
    found = jaccard_join.linked(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_LIKE).withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    order = F.struct(F.col("__id").isNull(), "__id", "__key")
    heads = found.filter("root is not null").groupBy("root").agg(F.min(order).alias("x")).select("x.__id", "x.__key")
    heads = heads.unionAll(found.filter("root is null").select("__id", "__key").distinct()).select(deal, F.col("__id").alias("__head"))
    # Texts are dealt by a hash of id and text, so no id is hot, and needn't move again to drop repeated rows.
    kept = docs.select("*", deal).join(heads, "__deal").filter(F.col("__id").eqNullSafe(F.col("__head")))
    return kept.dropDuplicates(["__deal", "__id"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    spark.conf.set(BATCH, BATCH_BYTES)
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix: doc_id, source, size, source_size, target, copies, taken."""
    return fair_queue.mix(docs).filter("copies > 0")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source_weights", weights),
]

#: Language ID and line dedup rest on hashed models that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
