"""From candidates to the context of an answer: scoped retrieval, selection, citations, definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import collapsed, is_reference_heading, shortened, stripped

from . import fusion


def in_scope(chunks: DataFrame, scopes: DataFrame, question: str, path_ids: str = "section_path_ids", document: str = "document_id") -> DataFrame:
    """RET-07, ARR-09: for each question (question, document, section_id) the chunks of that section and those below."""
    steps = chunks.withColumn("section_id", F.explode(path_ids))
    return steps.join(scopes, [document, "section_id"]).drop("section_id").dropDuplicates([question, *[c for c in chunks.columns if c != path_ids and c not in ("section_path",)]])


def of_type(chunks: DataFrame, questions: DataFrame, question: str, content_type: str, k: int, document: str = "document_id") -> DataFrame:
    """RET-08: the first k chunks of a content type for each question, without reranking."""
    order = Window.partitionBy(question).orderBy("chunk_index")
    return questions.join(chunks.filter(F.col("content_type") == content_type), document).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def enriched(hits: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """JON-13, PRJ-02: hits with the payload of their points; where both have a column, the payload's value wins."""
    both = [c for c in payload.columns if c in hits.columns and c != key]
    met = hits.alias("h").join(payload.alias("p"), F.col(f"h.{key}") == F.col(f"p.{key}"), "left")
    mine = [F.coalesce(F.col(f"p.{c}"), F.col(f"h.{c}")).alias(c) if c in both else F.col(f"h.{c}") for c in hits.columns]
    return met.select(*mine, *[F.col(f"p.{c}") for c in payload.columns if c not in hits.columns])


def select_context(hits: DataFrame, question: str, chunk: str, text: str, title: str, k: int, visuals: DataFrame | None = None, adaptive: bool = True, drop_unlabeled: bool = True, path: str | None = None) -> DataFrame:
    """RET-10, RET-12, FIL-07: of each question's reranked hits, with figures and tables added, the best k: without
    references, one for each chunk, over the threshold, not near-identical, without a minority of unlabeled sections.

    References, told by their title or by any title on their ``path`` (an array), go first, so that none raises the
    threshold or is one of the two that stay whatever their score."""
    every = hits.unionByName(visuals, allowMissingColumns=True) if visuals is not None else hits
    refers = F.coalesce(is_reference_heading(F.col(title)), F.lit(False))
    if path:
        refers |= F.coalesce(F.exists(F.col(path), lambda t: F.coalesce(is_reference_heading(t), F.lit(False))), F.lit(False))
    every = every.filter(~refers)
    order = Window.partitionBy(question).orderBy(F.col("score").desc(), "rank", chunk)
    best = fusion.best_per_key(every, [question, chunk], "score", "rank").withColumn("rank", F.row_number().over(order))
    kept = fusion.above_threshold(best, question, "score", "rank", adaptive=adaptive)
    thin = fusion.thin_near_duplicates(kept, question, chunk, text, "rank").select(question, chunk)
    kept = kept.join(thin, [question, chunk], "left_semi")
    if drop_unlabeled:
        kept = fusion.without_unlabeled(kept, question, title)
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# Candidates of the passes, what makes a pass too poor, and hits that are left.
SCOPED_K, FALLBACK_K, FEW, RERANKED = 20, 8, 3, 12


def question_hits(candidates: DataFrame, question: str, chunk: str, new_score: Column, title: str, path: str | None = None) -> DataFrame:
    """RET-09, RET-05, TOP-03, TOP-11: the reranked hits of each question, from all of its document's chunks with their
    ``score``, and whether they are ``scoped`` (under the question's sections, or there are none), ``leveled`` (of the
    chunk level that suits it), and the question's sections ``pinned``.

    First the best ``SCOPED_K`` in scope and level; if these are under ``FEW`` and nothing is pinned, also the best
    ``FALLBACK_K`` of the level. If that leaves none, as in an index without levels, the same without a level. The best
    of them by ``score`` are ranked by ``new_score``, and of the best ``RERANKED`` those that are references go.
    """
    order = Window.partitionBy(question).orderBy(F.col("score").desc(), chunk)
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(question)
    rows = fusion.best_per_key(candidates, [question, chunk], "score", chunk)
    passes = {"one": (F.col("scoped") & F.col("leveled"), SCOPED_K), "two": (F.col("leveled"), FALLBACK_K), "three": (F.col("scoped"), SCOPED_K), "four": (F.lit(True), FALLBACK_K)}
    for name, (test, k) in passes.items():
        rows = rows.withColumn(f"__{name}", test & (F.count_if(test).over(upto) <= k))
    n = {name: F.count_if(F.col(f"__{name}")).over(whole) for name in passes}
    rows = rows.withColumn("__n1", n["one"]).withColumn("__n2", n["two"]).withColumn("__n3", n["three"])
    free = ~F.col("pinned")
    leveled = F.col("__one") | ((F.col("__n1") < FEW) & free & F.col("__two"))
    none = (F.col("__n1") == 0) & (~free | (F.col("__n2") == 0))
    anyhow = F.col("__three") | ((F.col("__n3") < FEW) & free & F.col("__four"))
    merged = rows.filter(F.when(none, anyhow).otherwise(leveled)).drop("__n1", "__n2", "__n3", *[f"__{name}" for name in passes])
    first = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(RERANKED, SCOPED_K + FALLBACK_K))
    found = fusion.rerank(first, question, new_score, RERANKED)
    refers = is_reference_heading(F.col(title))
    if path:
        refers |= F.coalesce(F.exists(F.col(path), lambda t: F.coalesce(is_reference_heading(t), F.lit(False))), F.lit(False))
    return found.filter(~F.coalesce(refers, F.lit(False)))


def pinned(hits: DataFrame, pins: DataFrame, question: str, title: str = "section_title") -> DataFrame:
    """FIL-14: the hits whose title is pinned for the question, exactly; a question without any keeps one row without
    a hit, for which there is a fixed answer."""
    kept = hits.join(pins, [question, title], "left_semi")
    return pins.select(question).distinct().join(kept, question, "left").withColumn("found", F.col(title).isNotNull())


def extractive_answer(hits: DataFrame, question: str, rank: str, text: str, chunks: int = 2, most: int = 320) -> DataFrame:
    """PRJ-12: the first chunks, each cut at a word, as the answer."""
    order = Window.partitionBy(question).orderBy(rank)
    first = hits.filter(F.trim(text) != "").withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= chunks)
    part = F.struct("__n", shortened(collapsed(F.col(text)), most).alias("t"))
    return first.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("answer"))


def context_precision(judged: DataFrame, question: str, relevant: str) -> DataFrame:
    """RET-19, AGG-16: the share of a question's retrieved chunks, one row each, that are judged relevant; null if none
    is judged (``relevant`` null)."""
    return judged.groupBy(question).agg(F.when(F.count(relevant) > 0, F.count_if(relevant) / F.count("*")).alias("context_precision"))


def definitions(terms: DataFrame, term: str, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """RET-20: the definition of each term from the first table (term, definition) that has one, and its name."""
    out = terms.withColumn("__t", F.lower(F.trim(term)))
    for name, df in tables:
        known = df.filter("definition is not null").groupBy(F.lower(F.trim("term")).alias("__t")).agg(F.min("definition").alias(f"__{name}"))
        out = out.join(known, "__t", "left")
    definition = F.coalesce(*[F.col(f"__{n}") for n, _ in tables])
    source = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n, _ in tables])
    return out.withColumn("definition", definition).withColumn("source", source).drop("__t", *[f"__{n}" for n, _ in tables])


def guide_status(status: Column, payload: Column, found: Column | None = None) -> Column:
    """PRJ-15: missing without a row (``found``; unless given, without status and payload), the status if it is a known
    one, ready if the payload is a JSON object with anything in it, else pending."""
    there = found if found is not None else status.isNotNull() | payload.isNotNull()
    known = F.lower(F.trim(status))
    filled = F.coalesce(payload.rlike(r"^\s*\{\s*[^\s}]"), F.lit(False))
    return F.when(~there, "missing").when(known.isin("pending", "ready", "failed"), known).when(filled, "ready").otherwise("pending")


def step_questions(questions: Column, sections: Column, objective: Column, expected: Column, most: int = 2) -> Column:
    """ARR-15: a step's questions that aren't blank, up to ``most``; else made from its first section, and from its
    objective or, without one, its expected output."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    kept = F.filter(F.transform(F.coalesce(questions, F.array().cast("array<string>")), strip), lambda q: q != "")
    place = F.coalesce(F.get(sections, 0), F.lit("this section"))
    takeaway = F.concat(F.lit("What is the main takeaway from "), place, F.lit("?"))
    helps = F.concat(F.lit("How does "), place, F.lit(" help with: "), strip(objective), F.lit("?"))
    explain = F.concat(F.lit("What should you be able to explain after reading "), place, F.lit("?"))
    made = F.when(strip(objective) != "", F.array(takeaway, helps)).when(strip(expected) != "", F.array(takeaway, explain)).otherwise(F.array(takeaway))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(made), 1, most)


def passes_in_order(guides: DataFrame, name: str) -> DataFrame:
    """TOP-14: the rows named as passes (pass, a number and an underscore), by that number, then by name."""
    number = F.regexp_extract(name, "(?i)^pass([0-9]+)_", 1)
    return guides.filter(number != "").orderBy(number.cast("decimal(38)"), name)


def joined_references(texts: Column) -> Column:
    """SET-06: distinct reference texts in order, one a line."""
    return F.array_join(F.array_distinct(F.filter(F.transform(texts, stripped), lambda t: t != "")), "\n")


def is_reference_result(title: Column) -> Column:
    """FIL-07: the wider test of evaluation: a word of references anywhere in the title."""
    return F.coalesce(F.lower(title).rlike("reference|bibliography|citations"), F.lit(False))


def is_rate_limit(error: Column) -> Column:
    """FIL-22: an error that says to come back later."""
    return F.coalesce(F.lower(error).rlike("rate limit|rate_limit_exceeded|429|too many requests"), F.lit(False))


def listed(papers: DataFrame, key: str = "id") -> DataFrame:
    """PRJ-05: papers with the addresses of their file, bundle and deletion."""
    at = lambda head, tail: F.concat(F.lit(head), F.col(key).cast("string"), F.lit(tail))
    return papers.withColumn("pdf_url", at("/api/papers/", "/pdf")).withColumn("bundle_url", at("/api/papers/", "/bundle")).withColumn("delete_url", at("/api/cms/papers/", ""))


# The lists of element ids in a section's statistics.
ID_LISTS = ("formula_ids", "table_ids", "figure_ids", "text_block_ids")


def without_ids(sections: DataFrame, stats: str = "stats", children: str = "sections") -> DataFrame:
    """PRJ-07: sections without the lists of element ids in their statistics, and so those nested in them, to any
    depth of the schema."""

    def thin(value: Column, kind) -> Column:
        if stats in kind.names:
            value = value.withField(stats, value[stats].dropFields(*ID_LISTS))
        if nests(kind):
            inner = kind[children].dataType.elementType
            value = value.withField(children, F.transform(value[children], lambda s: thin(s, inner)))
        return value

    def nests(kind) -> bool:
        return children in kind.names and hasattr(kind[children].dataType, "elementType") and hasattr(kind[children].dataType.elementType, "names")

    out = sections.withColumn(stats, F.col(stats).dropFields(*ID_LISTS))
    if nests(sections.schema):
        inner = sections.schema[children].dataType.elementType
        out = out.withColumn(children, F.transform(children, lambda s: thin(s, inner)))
    return out
