"""Chunking: packing sentences into windows of a token budget with overlap."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from paperloom.functions.text import NAMESPACE_URL, token_estimate, uuid5

LEAST_CHARS = 80  # FIL-13


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def hard_split(sentence: str, size: int) -> list[str]:
    """CHK-03: a sentence over the budget, by words; a longer word is a part of its own."""
    parts: list[str] = []
    held: list[str] = []
    for word in sentence.split():
        if held and estimate(" ".join([*held, word])) > size:
            parts.append(" ".join(held))
            held = []
        held.append(word)
    return [*parts, " ".join(held)] if held else parts


def tail(sentences: list[str], overlap: int) -> list[str]:
    """CHK-02: the longest run of last sentences within the overlap."""
    kept: list[str] = []
    used = 0
    for s in reversed(sentences):
        used += estimate(s)
        if used > overlap:
            break
        kept.insert(0, s)
    return kept


def windows(text: str | None, size: int, overlap: int) -> list[str]:
    """CHK-01: sentences in order, packed until the next would pass ``size`` tokens; each window starts with the last
    sentences of the one before, as far as they fit ``overlap``."""
    import re

    sentences: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+", text or ""):
        if s := s.strip():
            sentences += [s] if estimate(s) <= size else hard_split(s, size)
    out: list[str] = []
    held: list[str] = []
    fresh = False
    for s in sentences:
        if fresh and estimate(" ".join([*held, s])) > size:
            out.append(" ".join(held))
            held, fresh = tail(held, overlap), False
            if held and estimate(" ".join([*held, s])) > size:
                held = []
        held.append(s)
        fresh = True
    return [*out, " ".join(held)] if fresh else out


def split_windows(docs: DataFrame, key: str, text: str = "text", levels: tuple[tuple[str, int, int], ...] = (("fine", 128, 32), ("coarse", 512, 64)), least_chars: int = LEAST_CHARS) -> DataFrame:
    """CHK-01..04, FIL-13: (key, chunk_level, chunk_index, content, token_count, n_chars) of every window of ``least_chars``
    characters or more; chunk_index runs over all chunks of a document, finer levels first.

    Packing depends on what came before, so it is done in Python, batch by batch, with no shuffle.
    """

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, names, places, texts = [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                n = 0
                for level, size, overlap in levels:
                    for w in windows(value, size, overlap):
                        if len(w) >= least_chars:
                            at.append(k)
                            names.append(level)
                            places.append(n)
                            texts.append(w)
                            n += 1
                    if len(texts) >= 4096:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names), pa.array(places, pa.int64()), pa.array(texts)], names=[key, "chunk_level", "chunk_index", "content"])
                        at, names, places, texts = [], [], [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=[key, "chunk_level", "chunk_index", "content"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, text).mapInArrow(rows, f"{key} {kind}, chunk_level string, chunk_index long, content string")
    return found.withColumn("token_count", token_estimate(F.col("content"))).withColumn("n_chars", F.length("content").cast("long"))


class ChunkTable:
    """CHK-01, CHK-04, CHK-08 as a table function of SQL:

        SELECT * FROM chunks(TABLE(papers) PARTITION BY id, key => 'id', body => 'text')

    gives for each row of the table what ``split_windows`` gives, under the table's own type of the key. ``levels`` and
    ``least_chars`` are optional: 'fine:128:32,coarse:512:64' and 80.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument, key: AnalyzeArgument, body: AnalyzeArgument, levels: AnalyzeArgument | None = None, least_chars: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name in (key, body):
            if not name.isConstantExpression or name.value not in row.dataType.names:
                raise ValueError("key and body must name columns of the table")
        out = StructType().add(key.value, row.dataType[key.value].dataType).add("chunk_level", "string").add("chunk_index", "long").add("content", "string").add("token_count", "long").add("n_chars", "long")
        return AnalyzeResult(schema=out)

    def eval(self, row, key, body, levels="fine:128:32,coarse:512:64", least_chars=LEAST_CHARS):
        n = 0
        for level, size, overlap in (x.split(":") for x in levels.split(",")):
            for w in windows(row[body], int(size), int(overlap)):
                if len(w) >= least_chars:
                    yield row[key], level, n, w, estimate(w), len(w)
                    n += 1


def register(spark: SparkSession, name: str = "chunks") -> None:
    """Make ``ChunkTable`` known to SQL; rows go to and from it in Arrow batches."""
    spark.udtf.register(name, F.udtf(ChunkTable, useArrow=True))


def payload(chunks: DataFrame) -> DataFrame:
    """PRJ-01: chunks with section_path as the titles on the way to their own, each once; a missing or empty title adds
    none."""
    own = F.when(F.col("section_title") != "", F.array("section_title"))
    none = F.array().cast("array<string>")
    return chunks.withColumn("section_path", F.array_distinct(F.concat(F.coalesce("section_path", none), F.coalesce(own, none))))


def section_texts(blocks: DataFrame, document: str = "document_id", section: str = "section_idx") -> DataFrame:
    """AGG-20, SRC-11: the blocks of a section in reading order, joined by blank lines; blank blocks are left out."""
    kept = blocks.filter(F.trim("text") != "")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.trim("text").alias("t")))), lambda x: x["t"]), "\n\n")
    return kept.groupBy(document, section).agg(ordered.alias("section_text"), F.count("*").alias("n_blocks"))


def fallback_chunks(unresolved: DataFrame, document: str = "document_id", least_words: int = 50) -> DataFrame:
    """CHK-07, CHK-11: blocks without a section as chunks, if they have words enough; numbered in order."""
    kept = unresolved.filter(F.size(F.split(F.trim("text"), r"\s+")) >= least_words)
    order = Window.partitionBy(document).orderBy("idx")
    return kept.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long")).withColumn("chunk_level", F.lit("coarse")).withColumn("section_title", F.lit("Unlabeled Section"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """CHK-05: a coarse chunk for each table (document_id, id, page, text, markdown, caption) with any content: its
    markdown, or else its text, after the caption."""
    body = F.coalesce(F.nullif(F.trim("markdown"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))
    content = F.concat_ws("\n", F.nullif(F.trim("caption"), F.lit("")), body)
    return tables.select("document_id", "id", "page", content.alias("content"), F.lit("table").alias("content_type"), F.lit("coarse").alias("chunk_level")).filter("content <> ''")


def figure_chunks(figures: DataFrame) -> DataFrame:
    """CHK-06, SNK-19: a coarse chunk for each figure (document_id, id, page, caption, image_path) with a caption once
    image markup is gone."""
    caption = F.trim(F.regexp_replace(F.coalesce("caption", F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " "))
    return figures.select("document_id", "id", "page", caption.alias("content"), "image_path", F.lit("figure").alias("content_type"), F.lit("coarse").alias("chunk_level")).filter("content <> ''")


def paper_chunks(sections: DataFrame, document: str = "document_id", size: int = 512, overlap: int = 64) -> DataFrame:
    """CHK-08: coarse chunks of sections (document, numbering, section_text) with ids made from what they are."""
    keyed = sections.withColumn("__key", F.struct(F.col(document).cast("string").alias("d"), F.coalesce("numbering", F.lit("")).alias("n"))).withColumn("__name", F.concat_ws("#", "__key.d", "__key.n"))
    parts = split_windows(keyed.select("__name", F.col("section_text").alias("text")), "__name", levels=(("coarse", size, overlap),))
    met = parts.join(keyed.select("__name", document, "numbering").dropDuplicates(["__name"]), "__name")
    return met.withColumn("chunk_id", uuid5(NAMESPACE_URL, F.concat_ws(":", "__name", F.col("chunk_index").cast("string")))).drop("__name")
