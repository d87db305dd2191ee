"""Readers of documents, hierarchies, elements, questions and models; every schema is stated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "section_id string, title string, level int, numbering string, parent_id string, page_start int, page_end int, child_section_ids array<string>, section_type string, font_size double, is_bold boolean, reading_order int"
BLOCK = "id string, page int, label string, text string, section_id string, section_title string, reading_order int"
QUESTION = "paper_id string, paper_type string, document_id string, section_id string, section_title string, question string, reference_answer string, relevant_chunk_ids array<string>, question_type string"
#: Errors of a file, in the order in which they are tested.
PDF_ERRORS = ("wrong_extension", "empty", "too_large", "not_pdf", "encrypted", "no_pages", "too_many_pages", "damaged")


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split(","))) + ">"


def sections(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08, SNK-15: one row for each section of hierarchy files, with or without a root named hierarchy."""
    listed = f"document_id string, sections array<{_struct(SECTION)}>"
    raw = spark.read.schema(f"{listed}, hierarchy {_struct_of(listed)}").option("multiLine", True).json(path)
    rows = raw.select(F.coalesce("hierarchy.document_id", "document_id").alias("document_id"), F.posexplode(F.coalesce("hierarchy.sections", "sections")).alias("idx", "s"))
    return rows.select("document_id", F.col("idx").cast("long").alias("idx"), "s.*")


def _struct_of(listed: str) -> str:
    head, tail = listed.split(", sections ", 1)
    return f"struct<{head.replace(' ', ': ')}, sections: {tail}>"


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09, SRC-11: text blocks of element files; a file without them has no rows."""
    raw = spark.read.schema(f"document_id string, text_blocks array<{_struct(BLOCK)}>").option("multiLine", True).json(path)
    return raw.select("document_id", F.posexplode_outer("text_blocks").alias("idx", "b")).filter("b is not null").select("document_id", F.col("idx").cast("long").alias("idx"), "b.*")


def questions(spark: SparkSession, path: str, with_answers: bool = False) -> DataFrame:
    """SRC-13, SRC-14: questions whose text and ids, and with answers those too, are filled in; one without a text stays.
    What can't be read has no field, and is left out."""
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(path)
    rows = rows.filter(F.coalesce(*[F.col(c).cast("string") for c in rows.columns]).isNotNull())
    blank = F.contains(F.coalesce("question", F.lit("")), F.lit("FILL IN")) | F.exists(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")), lambda x: F.contains(x, F.lit("FILL IN")))
    if with_answers:
        blank = blank | F.contains(F.coalesce("reference_answer", F.lit("")), F.lit("FILL IN"))
    return rows.filter(~blank)


def page_count(content: Column) -> Column:
    """SRC-01: the number of page objects that a file names in plain bytes; null if it packs objects away, so that only a
    parser could tell."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(~F.contains(text, F.lit("/ObjStm")), F.regexp_count(text, F.lit(r"/Type\s*/Page(?![A-Za-z])"))).cast("long")


def pdf_errors(path: Column, size: Column, content: Column, most_bytes: int = 50 << 20, least_pages: int = 1, most_pages: int | None = None) -> Column:
    """SRC-01, SRC-03: the errors of a file, empty if it is valid. Of a file that is encrypted nothing more is asked; one
    without the pointer to its table of objects that ends every file is damaged; pages are those of ``page_count``."""
    text, pages = F.decode(content, "ISO-8859-1"), page_count(content)
    is_pdf = (size > 0) & (F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "US-ASCII"))
    opened = is_pdf & ~F.contains(text, F.lit("/Encrypt"))
    whole = F.contains(text, F.lit("startxref"))
    tests = {
        "wrong_extension": ~F.lower(path).endswith(".pdf"),
        "empty": size == 0,
        "too_large": size > most_bytes,
        "not_pdf": (size > 0) & ~is_pdf,
        "encrypted": is_pdf & ~opened,
        "no_pages": opened & whole & (pages < least_pages),
        "too_many_pages": opened & whole & (pages > most_pages) if most_pages else F.lit(False),
        "damaged": opened & ~whole,
    }
    return F.array_compact(F.array(*[F.when(tests[e], F.lit(e)) for e in PDF_ERRORS]))


def files(spark: SparkSession, path: str, most_bytes: int = 50 << 20, least_pages: int = 1, most_pages: int | None = None) -> DataFrame:
    """SRC-01..03, FIL-18: path, size, sha256, page_count, errors, is_valid of the files in a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), page_count(F.col("content")).alias("page_count"), pdf_errors(F.col("path"), F.col("length"), F.col("content"), most_bytes, least_pages, most_pages).alias("errors"))
    return found.withColumn("is_valid", F.size("errors") == 0)


def element_id(label: Column, text: Column, page: Column, level: Column) -> Column:
    """SRC-06: the stable id of an element."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", blank(label), blank(text), blank(page), blank(level)))


def full_text(given: Column, rebuilt: Column) -> Column:
    """SRC-10: the text file's text, or what the blocks give."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), rebuilt)


def guide_steps(guides: DataFrame, key: str, payload: str) -> DataFrame:
    """SRC-20, PRJ-08, PRJ-09, ARR-14: (key, pass, step, objective, sections, questions) of guides that are a list of
    steps, or an object with steps, guide, or passes that have steps."""
    step = "array<struct<objective:string,section_to_read:array<string>,questions_to_answer:array<string>>>"
    v = guides.select(key, F.try_parse_json(payload).alias("v"))
    at = lambda path: F.try_variant_get("v", path, step)
    passes = F.array(*[F.struct(F.lit(n).alias("pass"), at(p).alias("steps")) for n, p in (("", "$"), ("steps", "$.steps"), ("guide", "$.guide"), ("pass1", "$.pass1.steps"), ("pass2", "$.pass2.steps"), ("pass3", "$.pass3.steps"))])
    rows = v.select(key, F.explode(F.filter(passes, lambda p: p["steps"].isNotNull())).alias("p"))
    return rows.select(key, F.col("p.pass"), F.posexplode("p.steps").alias("n", "s")).select(key, "pass", (F.col("n") + 1).alias("step"), "s.objective", F.col("s.section_to_read").alias("sections"), F.col("s.questions_to_answer").alias("questions"))


PAGES = "document_id string, page int, text string"
ELEMENTS = "document_id string, kind string, page int, reading_order int, text string, x0 double, y0 double, x1 double, y1 double"


def scanned_pages(found: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """SRC-04, SRC-07: (document_id, page, text, char_count, word_count) of the files of ``files`` with their content.

    ``extract`` turns a file into the texts of its pages; it runs where the file's task runs. A file that it can't
    read has no pages.
    """

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, k + 1, text) for k, text in enumerate(extract(bytes(content)))]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["document_id", "page", "text"])

    pages = found.select("path", "content").mapInPandas(rows, PAGES)
    return pages.withColumn("char_count", F.length("text")).withColumn("word_count", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def scanned_elements(found: DataFrame, extract: Callable[[bytes], list[dict]]) -> DataFrame:
    """SRC-05: elements of files: kind (section, text, table, figure, formula), page, reading order, text and box."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split()[0] for f in ELEMENTS.split(", ")]
        for batch in batches:
            out = [{"document_id": p} | e for p, c in zip(batch["path"], batch["content"], strict=True) for e in extract(bytes(c))]
            yield pd.DataFrame(out, columns=names)

    return found.select("path", "content").mapInPandas(rows, ELEMENTS)


def classifier(path: str):
    """SRC-16: a stored model."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def bundle(papers: DataFrame, children: dict[str, DataFrame], name: str, key: str = "paper_id") -> dict[str, DataFrame]:
    """SRC-21: the paper of a name, whatever its case, and the rows of each child table that are its."""
    paper = papers.filter(F.lower("paper_name") == name.lower())
    return {"paper": paper} | {n: df.join(paper.select(key), key, "left_semi") for n, df in children.items()}


def cached(found: DataFrame, cache: DataFrame) -> DataFrame:
    """SRC-17: files with what the cache has for their hash, null where it has nothing or nothing that parses."""
    held = cache.select("sha256", F.try_parse_json("payload").alias("payload")).filter("payload is not null").dropDuplicates(["sha256"])
    return found.join(held, "sha256", "left")


def bm25_model(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: a stored model as ``bm25.weigh`` takes it: (term, df, idf, avgdl)."""
    return spark.read.parquet(f"{path}/terms").crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats").select("avgdl")))


def chunk_index(spark: SparkSession, path: str, document: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK-12, RET-06: (chunks, postings, statistics) of an index: of each document the newest batch that is whole."""
    from paperloom.operators import bm25

    stored = spark.read.option("basePath", f"{path}/chunks").parquet(f"{path}/chunks")
    newest = stored.groupBy(document).agg(F.max("batch").alias("batch"))
    chunks = stored.join(newest, [document, "batch"], "left_semi")
    postings = spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings").join(newest, [document, "batch"], "left_semi")
    return chunks.drop("batch"), postings.drop("batch"), bm25.statistics(chunks, "content")
