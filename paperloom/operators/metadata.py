"""Document metadata by rules: readability, titles, abstracts, keywords, references, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

# Words that are no keywords.
NO_KEYWORDS = (
    "the", "and", "for", "with", "from", "this", "that", "are", "was", "were", "into", "using",
    "paper", "study", "result", "results", "method", "methods", "approach", "based", "analysis",
    "model", "models", "data", "new", "novel", "our", "their", "than", "also", "show", "shows",
)


def readability(pages: DataFrame, document: str, text: str = "text") -> DataFrame:
    """FIL-15, FIL-16, AGG-18, AGG-23: n_pages, n_words, mean characters, pages with under 50, whether recognition is
    needed, the class, and the confidence expected of it."""
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    few, all_ = F.count_if(n < 50), F.count("*")
    confidence = F.least(n / 500, F.lit(1.0)) * 0.4 + F.when(words > 10, 0.3).otherwise(0.15) + 0.3
    whole = pages.groupBy(document).agg(all_.alias("n_pages"), F.sum(words).alias("n_words"), F.round(F.avg(n), 6).alias("mean_chars"), few.alias("n_sparse"), F.round(F.avg(confidence), 6).alias("confidence"))
    sparse = F.col("n_sparse") / F.col("n_pages")
    return whole.withColumn("needs_ocr", (F.col("mean_chars") < 50) | (sparse > 0.3)).withColumn("readability", F.when(sparse == 0, "digital").when(sparse < 1, "hybrid").otherwise("scanned"))


def best_title(headings: DataFrame, document: str, order: str, title: str = "title", page: str = "page") -> DataFrame:
    """STR-18: the heading of the highest score, the first of equals: 3 for a page up to 2, 3 for a valid title, 1 for
    20 to 220 characters, 1 for a colon. Numbered headings and those of usual parts are no titles; where nothing else
    is left, the title is empty and the score null. A page that is null or 0 is unknown, and late."""
    t = F.col("__t")
    late = F.coalesce(F.nullif(F.col(page), F.lit(0)), F.lit(99))
    # The weights.
    score = F.when(late <= 2, 3).otherwise(0) + F.when(T.valid_clean_title(t), 3).otherwise(0) + F.when(F.length(t).between(20, 220), 1).otherwise(0) + F.when(F.contains(t, F.lit(":")), 1).otherwise(0)
    usable = (t != "") & ~T.heads_a_part(t)
    marked = headings.withColumn("__t", T.clean_title(F.col(title))).withColumn("__x", F.when(usable, F.struct(score.alias("score"), (-F.col(order)).alias("back"), t.alias("t"))))
    return marked.groupBy(document).agg(F.max("__x").alias("x")).select(document, F.coalesce("x.t", F.lit("")).alias("title"), "x.score")


def frequent_words(docs: DataFrame, document: str, text: str = "text", most: int = 10) -> DataFrame:
    """AGG-29: the most frequent words of three letters or more, earlier ones first among equals."""
    words = docs.select(document, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))).alias("pos", "word")).filter(~F.col("word").isin(*NO_KEYWORDS))
    counts = words.groupBy(document, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(document).orderBy(F.col("n").desc(), "first")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("first")


# A spaced-out heading, the text under a heading, after a plain word, and how much of a paper's paragraphs.
SPACED_ABSTRACT = r"(?imd)(^|\n)\s*A\s*B\s*S\s*T\s*R\s*A\s*C\s*T\s*[:\-]?\s*(\n|$)"
HEADED_ABSTRACT = r"(?is)(?:^|\n)#{1,6}\s*abstract\s*\n(.{40,6000}?)(?=\n#{1,6}\s|\z)"
PLAIN_ABSTRACT = r"(?is)\babstract\b\s*[:\-]?\s*(.{40,8000}?)(?=\bkeywords?\b|\bindex\s+terms\b|\bintroduction\b|\n\s*1\.?\s+[A-Za-z]|\n\s*#{1,6}\s|\z)"
ABSTRACT_PARAGRAPHS, ABSTRACT_CHARACTERS = 12, 1800


def abstract(text: Column) -> Column:
    """STR-21: the first valid one, cleaned, of the text under a heading Abstract, the text after the word, and the
    paragraphs before the introduction, until they have enough characters; empty without one."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    flat = F.regexp_replace(flat, SPACED_ABSTRACT, "$1## Abstract\n")
    first = F.slice(F.filter(F.transform(F.split(flat, "\n\n"), T.stripped), lambda p: p != ""), 1, ABSTRACT_PARAGRAPHS)
    stop = F.array_position(F.transform(first, lambda p: F.contains(F.lower(p), F.lit("introduction"))), True)
    before = F.slice(first, 1, F.when(stop > 0, stop - 1).otherwise(ABSTRACT_PARAGRAPHS).cast("int"))
    own = F.filter(before, lambda p: ~p.rlike(r"(?i)^#{1,6}\s*abstract\s*$"))
    opening = F.aggregate(own, F.lit(""), lambda a, p: F.when(a == "", p).when(F.length(a) > ABSTRACT_CHARACTERS, a).otherwise(F.concat(a, F.lit(" "), p)))
    tries = (F.regexp_extract(flat, HEADED_ABSTRACT, 1), F.regexp_extract(flat, PLAIN_ABSTRACT, 1), opening)
    return F.coalesce(F.get(F.filter(F.array(*[T.clean_abstract(t) for t in tries]), T.valid_abstract), 0), F.lit(""))


# What begins an entry, on a line of its own and inside a line, and the words of a reference heading.
ENTRY_LINE = r"^(\[\d+\]|\(\d+\)|\d+\.|\d+\)|[-•])\s+"
ENTRY_INLINE = r"\[\d+\]|\(\d+\)|\d+\.\s"
REFERENCE_WORDS = "references|bibliography|works cited"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _parts(text: Column, pattern: str) -> Column:
    """What stands between matches, stripped, if anything is left."""
    return F.filter(F.transform(F.split(text, pattern, -1), _stripped), lambda x: x != "")


def split_references(text: Column) -> Column:
    """STR-29: the entries of a reference block: its paragraphs if there are several; else its lines, where those
    without a marker go on with the entry before, or where all are over 30 characters; else what markers inside split;
    else none."""
    paragraphs = _parts(text, r"\r?\n\s*\r?\n+")
    first = _stripped(F.regexp_replace(F.get(paragraphs, 0), rf"(?i)^\s*(?:{REFERENCE_WORDS})\s*:?\s*", ""))
    paragraphs = F.filter(F.concat(F.array(first), F.slice(paragraphs, 2, F.greatest(F.size(paragraphs), F.lit(1)))), lambda x: x != "")
    lines = _parts(text, r"\r?\n+")
    marked = lambda x: x.rlike(ENTRY_LINE)
    goes_on = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), x)))
    merged = F.aggregate(lines, F.array().cast("array<string>"), lambda a, x: F.when(marked(x) | (F.size(a) == 0), F.concat(a, F.array(x))).otherwise(goes_on(a, x)))
    inline = _parts(text, rf"(?={ENTRY_INLINE})")
    several = F.size(lines) > 1
    return (
        F.when(F.size(paragraphs) > 1, paragraphs)
        .when(several & F.exists(lines, marked), merged)
        .when(several & F.forall(lines, lambda x: F.length(x) > 30), lines)
        .when(F.size(inline) > 1, inline)
        .otherwise(F.array().cast("array<string>"))
    )


def references(text: Column) -> Column:
    """STR-30: the entries after the first word of a reference heading; if nothing splits them, lines over 20 characters."""
    tail = _stripped(F.regexp_extract(text, rf"(?is)\b(?:{REFERENCE_WORDS})\b(.*)$", 1))
    found = split_references(tail)
    lines = F.filter(_parts(tail, r"\r?\n+"), lambda x: F.length(x) > 20)
    return F.when(F.size(found) > 0, found).otherwise(lines)


def reference_entries(docs: DataFrame, document: str, text: str = "text") -> DataFrame:
    """STR-29, STR-30: (document, n, entry): the references at the end of each text, in order."""
    return docs.select(document, F.posexplode(references(F.col(text))).alias("n", "entry")).withColumn("n", F.col("n").cast("long"))


def missing_fields(fields: list[str]) -> Column:
    """AGG-21: the names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields]))


def missing_core_fields(title: Column, abstract: Column, keywords: Column, sections: Column) -> Column:
    """ARR-18: of title, abstract, keywords and sections, in this order, those that are missing: an empty title, an
    abstract that isn't valid, and no keywords or sections (arrays)."""
    gone = {"title": F.coalesce(title, F.lit("")) == "", "abstract": ~T.valid_abstract(abstract), "keywords": F.coalesce(F.size(keywords), F.lit(0)) <= 0, "sections": F.coalesce(F.size(sections), F.lit(0)) <= 0}
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in gone.items()]))


def filled(current: dict[str, Column], found: dict[str, Column], lists: tuple[str, ...] = ()) -> dict[str, Column]:
    """ARR-16: each field that was found, or as it was unless it is null or empty; ``lists`` are arrays. What wasn't
    looked for stays."""
    empty = lambda k, c: F.coalesce(F.size(c) <= 0 if k in lists else c == "", F.lit(True))
    return {k: F.when(empty(k, c), found[k]).otherwise(c) if k in found else c for k, c in current.items()}



def paper_properties(formulas: Column, pages: Column, sections: Column) -> Column:
    """AGG-30: struct<paper_type, difficulty, math_heavy> by formulas a page and in all, then by length."""
    rate = F.when(pages > 0, formulas / pages).otherwise(0.0)
    kind = lambda paper, difficulty, heavy: F.struct(F.lit(paper).alias("paper_type"), F.lit(difficulty).alias("difficulty"), F.lit(heavy).alias("math_heavy"))
    return (
        F.when(rate >= 2.0, kind("theoretical_research", "advanced", True))
        .when((rate >= 1.0) | (formulas >= 10), kind("research_article", "intermediate", True))
        .when((rate >= 0.3) | (formulas >= 5) | (pages > 20) | (sections > 10), kind("research_article", "intermediate", False))
        .otherwise(kind("research_article", "beginner", False))
    )


def opening(text: Column, paragraphs: int = 3, most: int = 1200) -> Column:
    """PRJ-14: the first paragraphs that aren't blank, up to so many characters."""
    parts = F.filter(F.transform(F.split(text, "\n"), lambda p: T.collapsed(p)), lambda p: p != "")
    return F.substring(F.array_join(F.slice(parts, 1, paragraphs), "\n\n"), 1, most)


def keyword_sections(sections: DataFrame, keywords: DataFrame, document: str, order: str, title: str = "title", most: int = 1000) -> DataFrame:
    """ARR-17, TOP-10: for each document and keyword the first section whose title has it.

    The keywords are a list of presets; more than ``most`` are an error, as each title is compared with each.
    """
    words = [r["keyword"] for r in keywords.select("keyword").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} keywords")
    held = F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(F.lower(title), w))
    met = sections.select("*", F.explode(held).alias("keyword"))
    return met.groupBy(document, "keyword").agg(F.min_by(F.struct(F.col(order).alias("idx"), F.col(title).alias("title")), F.col(order)).alias("x"), F.count("*").alias("n")).select(document, "keyword", "x.idx", "x.title", "n")
