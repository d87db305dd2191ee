"""Elements of papers and the sections they belong to."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from paperloom.functions.text import collapsed, plain_title, sentence_with, stripped, title_key


def resolve_blocks(blocks: DataFrame, sections: DataFrame, document: str = "document_id") -> DataFrame:
    """JON-09: blocks (document, id, section_id, text, section_title, page) with resolved_id: the section of that id, or
    else of the sections whose title is the block's text or its section's title, but for case and numbering.

    Of several, those whose pages hold the block are chosen, if any (a section without an end is open); then the first
    in reading order (none counts as 0), then the least id. A null page is held by none.
    """
    known = sections.select(document, F.col("section_id").alias("__id"), title_key(F.col("title")).alias("__key"), "page_start", "page_end", F.coalesce("reading_order", F.lit(0)).alias("__order"))
    by_id = blocks.join(known.select(document, F.col("__id").alias("section_id"), F.col("__id").alias("__by_id")).distinct(), [document, "section_id"], "left")
    keys = F.array_distinct(F.array(title_key(F.coalesce("text", F.lit(""))), title_key(F.coalesce("section_title", F.lit("")))))
    asked = blocks.select(document, "id", "page", F.explode(keys).alias("__key")).filter("__key <> ''")
    out = ~F.coalesce((F.col("page") >= F.col("page_start")) & (F.col("page") <= F.coalesce("page_end", "page")), F.lit(False))
    near = asked.join(known, [document, "__key"]).groupBy(document, "id").agg(F.min(F.struct(out.alias("out"), "__order", "__id")).alias("x")).select(document, "id", F.col("x.__id").alias("__by_title"))
    return by_id.join(near, [document, "id"], "left").withColumn("resolved_id", F.coalesce("__by_id", "__by_title")).drop("__by_id", "__by_title")


def section_maps(sections: DataFrame, key: Column, document: str = "document_id", idx: str = "idx") -> DataFrame:
    """JON-19: (document, key, idx): the last section of each numbering or title."""
    return sections.withColumn("key", key).filter("key is not null").groupBy(document, "key").agg(F.max(idx).alias(idx))


def visual_ids(elements: DataFrame, document: str = "document_id") -> DataFrame:
    """ARR-13: (document, figures, tables): maps from section to the ids of its figures and of its tables, in order."""
    ids = elements.groupBy(document, "section_id", "kind").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pick = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("section_id", "ids")))))
    return ids.groupBy(document).agg(pick("figure").alias("figures"), pick("table").alias("tables"))


#: Characters of chunks, and probes, that are held against each other at once; a document with more has several rows.
SHEET, PIECE = 1 << 20, 4096


@F.pandas_udf(ArrayType(IntegerType()))
def first_held(texts: pd.Series, probes: pd.Series, sizes: pd.Series) -> pd.Series:
    """For each of a row's texts the place of the first of its probes that is in it, else null. Probes have so many
    characters at least.

    Where one may begin is told by the rolled hash of so many characters: those of neighbours differ by the character
    that leaves and the one that comes. From there every length that probes of that beginning have is looked up.
    """
    import numpy as np

    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def powers(of, n):
        return np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, of, dtype=np.uint64)]))

    def points(text):
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)

    def found(texts, probes, size):
        first, whole, ends = [None] * len(texts), "".join(texts), np.cumsum([len(t) for t in texts])
        n, places, lengths = len(whole), {}, {}
        for k, p in enumerate(probes):
            places.setdefault(p, k)
            lengths.setdefault(p[:size], set()).add(len(p))
        if n < size or not lengths:
            return first
        known = np.unique((points("".join(lengths)).reshape(-1, size) * powers(base, size)[:size]).sum(axis=1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(points(whole) * powers(base, n)[:n], dtype=np.uint64)])
        hashes = (sums[size:] - sums[: n - size + 1]) * powers(inverse, n)[: n - size + 1]
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
        for i, t in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
            for m in lengths.get(whole[i : i + size], ()):
                k = places.get(whole[i : i + m]) if i + m <= ends[t] else None
                if k is not None and (first[t] is None or k < first[t]):
                    first[t] = k
        return first

    return pd.Series([found(list(t), p, int(s)) for t, p, s in zip(texts, probes, sizes, strict=True)])


def title_mismatches(chunks: DataFrame, blocks: DataFrame, document: str = "document_id", probe: int = 96, least: int = 24) -> DataFrame:
    """ARR-19: text chunks (document, chunk_id, content, section_title, content_type) whose title isn't that of their
    blocks: (document, chunk_id, section_title, heading).

    Chunks and probes of a document meet in rows of a bounded size, a row of its chunks with a row of its probes; all
    is dealt by document, so inputs that are dealt so already aren't shuffled again.

    Expected is the heading of the first block (document, idx, text, heading) whose first ``probe`` characters are in
    the chunk. Blocks and chunks under ``least`` characters have no say, nor has an empty heading; titles are compared
    without case and numbering.
    """
    held = chunks.filter("content_type = 'text'").select(document, "chunk_id", "section_title", collapsed(F.col("content")).alias("c")).filter(F.length("c") >= least)
    probes = blocks.select(document, "idx", F.coalesce("heading", F.lit("")).alias("heading"), collapsed(F.col("text")).alias("t")).filter(F.length("t") >= least).select(document, "idx", "heading", F.substring("t", 1, probe).alias("p"))
    before = F.sum(F.length("c")).over(Window.partitionBy(document).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)) - F.length("c")
    sheets = held.withColumn("sheet", F.floor(before / SHEET)).groupBy(document, "sheet").agg(F.collect_list(F.struct("chunk_id", "section_title", "c")).alias("chunks"))
    nth = F.row_number().over(Window.partitionBy(document).orderBy("idx")) - 1
    pieces = probes.withColumn("piece", F.floor(nth / PIECE)).groupBy(document, "piece").agg(F.array_sort(F.collect_list(F.struct("idx", "heading", "p"))).alias("blocks"))
    met = sheets.join(pieces, document).withColumn("places", first_held(F.col("chunks.c"), F.col("blocks.p"), F.lit(least)))
    pairs = F.zip_with("chunks", "places", lambda c, k: F.when(k.isNotNull(), F.struct(c["chunk_id"].alias("chunk_id"), c["section_title"].alias("section_title"), F.get("blocks", k)["idx"].alias("idx"), F.get("blocks", k)["heading"].alias("heading"))))
    hits = met.select(document, F.explode(pairs).alias("x")).filter("x is not null").select(document, "x.*")
    first = hits.groupBy(document, "chunk_id", "section_title").agg(F.min(F.struct("idx", "heading")).alias("x")).select(document, "chunk_id", "section_title", F.col("x.heading").alias("heading"))
    return first.filter((F.col("heading") != "") & (title_key(F.coalesce("section_title", F.lit(""))) != title_key(F.col("heading"))))


def element_ids_by_title(labels: DataFrame, sections: DataFrame, document: str = "document_id", ids: tuple[str, ...] = ("text_ids", "table_ids", "figure_ids", "reference_ids")) -> DataFrame:
    """ARR-20: (document, label, element_ids): of the first section with that title, all its ids."""
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ids])
    first = sections.groupBy(document, F.col("title").alias("label")).agg(F.min_by(every, "idx").alias("element_ids"))
    return labels.join(first, [document, "label"], "left")


def nested(sections: DataFrame, children: str = "sections", title: str = "title") -> DataFrame:
    """ARR-10: (document_id, path, title) of sections nested to any depth of the schema, in the order of ``path``: a
    section, then those below it."""
    level = sections.select("document_id", F.posexplode("sections").alias("i", "s")).select("document_id", F.array("i").alias("path"), "s")
    levels = []
    while True:
        levels.append(level.select("document_id", "path", F.col(f"s.{title}").alias("title")))
        below = level.schema["s"].dataType
        if children not in below.names or not hasattr(below[children].dataType, "elementType") or not hasattr(below[children].dataType.elementType, "names"):
            return reduce(DataFrame.unionAll, levels)
        level = level.select("document_id", "path", F.posexplode(f"s.{children}").alias("i", "c")).select("document_id", F.concat("path", F.array("i")).alias("path"), F.col("c").alias("s"))


def distinct_headings(flat: DataFrame, document: str = "document_id") -> DataFrame:
    """SET-07: (document, headings): the titles of ``nested``, trimmed, not empty, each once where it comes first."""
    named = flat.withColumn("title", F.trim("title")).filter("title <> ''").groupBy(document, "title").agg(F.min("path").alias("path"))
    return named.groupBy(document).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "title"))), lambda x: x["title"]).alias("headings"))


def focus_blocks(blocks: DataFrame, abstracts: DataFrame | None = None, document: str = "document_id") -> DataFrame:
    """SET-12: (document, scope, text, idx): the distinct texts, stripped, of ``abstracts`` (document, abstract; before
    all others, with idx -1) and of blocks whose heading has the word abstract or else intro or introduction."""
    head = F.concat(F.lit(" "), plain_title(F.col("heading")), F.lit(" "))
    scope = F.when(F.contains(head, F.lit(" abstract ")), "abstract").when(F.contains(head, F.lit(" intro ")) | F.contains(head, F.lit(" introduction ")), "introduction")
    rows = blocks.select(document, scope.alias("scope"), stripped(F.col("text")).alias("text"), F.col("idx").cast("long").alias("idx"))
    if abstracts is not None:
        rows = abstracts.select(document, F.lit("abstract").alias("scope"), stripped(F.col("abstract")).alias("text"), F.lit(-1).cast("long").alias("idx")).unionAll(rows)
    return rows.filter("scope is not null and text <> ''").groupBy(document, "scope", "text").agg(F.min("idx").alias("idx"))


def term_contexts(terms: DataFrame, focus: DataFrame, document: str = "document_id") -> DataFrame:
    """STR-28: (document, term, context): the first sentence of ``focus_blocks`` with the term, else the beginning of
    the first block; empty without a block or a term."""
    found = F.struct(F.col("sentence").isNull().alias("missed"), "idx", F.coalesce("sentence", F.when(stripped(F.col("term")) != "", stripped(F.substring("text", 1, 400)))).alias("context"))
    met = terms.select(document, "term").distinct().join(focus, document, "left").withColumn("sentence", sentence_with(F.col("text"), F.col("term")))
    return met.groupBy(document, "term").agg(F.min(found).alias("x")).select(document, "term", F.coalesce("x.context", F.lit("")).alias("context"))


def merged_texts(near: DataFrame, tagged: DataFrame, document: str = "document_id") -> DataFrame:
    """SET-09: each block once for a section, whether it is the nearest heading's or its tag says so; joined in order."""
    both = near.select(document, "section_idx", "idx", "text").unionByName(tagged.select(document, "section_idx", "idx", "text")).distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n")
    return both.groupBy(document, "section_idx").agg(text.alias("section_text"))


def range_texts(pages: DataFrame, ranges: DataFrame, document: str = "document_id") -> DataFrame:
    """CHK-09, CHK-10: (document, section_idx, text): the pages of each range in order, joined by blank lines."""
    met = ranges.join(pages, document).filter(F.col("page").between(F.col("page_start"), F.coalesce("page_end", "page_start")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    return met.groupBy(document, "section_idx").agg(text.alias("text"))


def of_document(points: DataFrame, document: str, value) -> DataFrame:
    """SRC-19: the points of a document; a filter that reaches the scan, in place of paging."""
    return points.filter(F.col(document) == value)


def without_documents(points: DataFrame, gone: DataFrame, document: str) -> DataFrame:
    """SNK-18: the points left when those of some documents go."""
    return points.join(gone.select(document).distinct(), document, "left_anti")


def first_in_order(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
