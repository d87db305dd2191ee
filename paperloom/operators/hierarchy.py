"""Section hierarchies: parents, paths, page ranges, carried headings, and joins by page.

A section is a row (document, idx, level, title, ...), idx ascending in reading order. Levels are 1 to ``MAX_LEVEL``,
so an ancestor chain is found with one window for each level instead of recursion; all share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVEL = 6


def with_ancestors(sections: DataFrame, document: str = "document_id", idx: str = "idx", level: str = "level") -> DataFrame:
    """WIN-09..11, ARR-02, ARR-03, ARR-11: ``ancestors`` (idx of the ancestors, root first), ``parent_idx`` and ``depth``.

    The parent is the nearest section before with a smaller level; an ancestor of level L is the last section of that
    level, if no section of a smaller level came since.
    """
    before = Window.partitionBy(document).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == n, F.col(idx))).over(before) for n in range(1, MAX_LEVEL)]
    marked = sections.withColumn("__last", F.array(*last))
    stack = F.filter("__last", lambda x, i: x.isNotNull() & (i + 1 < F.col(level)) & (x > F.coalesce(F.array_max(F.slice("__last", F.lit(1), i)), F.lit(-1))))
    marked = marked.withColumn("ancestors", stack)
    return marked.withColumn("parent_idx", F.try_element_at("ancestors", F.lit(-1))).withColumn("depth", F.size("ancestors") + 1).drop("__last")


def paths(sections: DataFrame, document: str = "document_id", idx: str = "idx", title: str = "title", number: str | None = None) -> DataFrame:
    """ARR-01, ARR-06, ARR-12: (document, idx, path): titles from the root to the section, or numbering where there is any."""
    label = F.coalesce(F.col(number), F.col(title)) if number else F.col(title)
    tree = with_ancestors(sections, document, idx)
    steps = tree.select(document, idx, F.posexplode(F.concat("ancestors", F.array(idx))).alias("at", "step"))
    names = sections.select(F.col(document), F.col(idx).alias("step"), label.alias("label"))
    return steps.join(names, [document, "step"]).groupBy(document, idx).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("path"))


def descendants(sections: DataFrame, document: str = "document_id", idx: str = "idx") -> DataFrame:
    """ARR-04, ARR-09: (document, ancestor, idx, distance): every section below another."""
    tree = with_ancestors(sections, document, idx)
    return tree.select(document, idx, F.size("ancestors").alias("n"), F.posexplode("ancestors").alias("at", "ancestor")).select(document, "ancestor", idx, (F.col("n") - F.col("at")).alias("distance"))


def children(sections: DataFrame, document: str = "document_id", idx: str = "idx") -> DataFrame:
    """ARR-05, AGG-19: (document, parent_idx, n_children, first_child, last_child)."""
    return with_ancestors(sections, document, idx).filter("parent_idx is not null").groupBy(document, "parent_idx").agg(F.count("*").alias("n_children"), F.min(idx).alias("first_child"), F.max(idx).alias("last_child"))


def leaves(sections: DataFrame, document: str = "document_id", idx: str = "idx") -> DataFrame:
    """SET-08: the sections that are no other's parent."""
    below = children(sections, document, idx).select(document, F.col("parent_idx").alias(idx))
    return sections.join(below, [document, idx], "left_anti")


def page_end(sections: DataFrame, document: str = "document_id", idx: str = "idx", page: str = "page") -> DataFrame:
    """WIN-07, WIN-08: page_end: the page before the next later page a section starts on, the own page without one,
    null for the last section; next_start: the next section's page."""
    order = Window.partitionBy(document).orderBy(page, idx)
    later = Window.partitionBy(document).orderBy(F.col(page).cast("long")).rangeBetween(1, Window.unboundedFollowing)
    ended = F.when(F.lead(idx).over(order).isNull(), None).otherwise(F.coalesce(F.min(page).over(later) - 1, F.col(page)))
    return sections.withColumn("page_end", ended).withColumn("next_start", F.lead(page).over(order))


def carried(rows: DataFrame, document: str, idx: str, value: Column, name: str = "carried") -> DataFrame:
    """WIN-12, WIN-13, SRC-06: the last non-null ``value`` up to each row, and the number of them so far."""
    upto = Window.partitionBy(document).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__v", value).withColumn(name, F.last("__v", ignorenulls=True).over(upto)).withColumn(f"{name}_part", F.count("__v").over(upto)).drop("__v")


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, part: Column | None = None) -> DataFrame:
    """JON-07, JON-08: each left row (by, at, ...) with the ``value`` of the latest right row at or before it; of right
    rows of one time the largest.

    One union and one window: no pairs are made, however many rows a key has on either side. ``part``, an expression
    of ``at`` that grows with it, such as its day, cuts the rows of a key into tasks of their own: what is open at the
    end of a part is carried to the next ones over one row for each key and part.
    """
    mine = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(right.schema[value].dataType))
    theirs = right.select(*by, at, F.lit(0).alias("__side"), F.col(value).alias("__value"))
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("__part", part if part is not None else F.lit(0))
    upto = Window.partitionBy(*by, "__part").orderBy(at, "__side", F.col("__value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(value, F.last("__value", ignorenulls=True).over(upto))
    if part is not None:
        ends = both.groupBy(*by, "__part").agg(F.max(F.when(F.col("__side") == 0, F.struct(at, "__value")))["__value"].alias("__end"))
        before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried_in = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
        found = found.join(carried_in, [*by, "__part"]).withColumn(value, F.coalesce(value, "__carried")).drop("__carried")
    return found.filter("__side = 1").drop("__side", "__value", "__part")


def page_range_join(elements: DataFrame, sections: DataFrame, document: str = "document_id", page: str = "page", start: str = "page_start", end: str = "page_end") -> DataFrame:
    """JON-05, JON-06, CHK-09: each element with every section of its document whose pages hold it.

    The equality on the document makes this a hash or merge join with a remainder; without it each pair is tried.
    """
    a, b = elements.alias("a"), sections.alias("b")
    inside = F.col(f"a.{page}").between(F.col(f"b.{start}"), F.coalesce(F.col(f"b.{end}"), F.col(f"b.{start}")))
    return a.join(b, (F.col(f"a.{document}") == F.col(f"b.{document}")) & inside).select("a.*", *[F.col(f"b.{c}") for c in sections.columns if c != document])


def pages_of(document_pages: DataFrame, sections: DataFrame, document: str = "document_id") -> DataFrame:
    """JON-08: for each page 1..n_pages of a document the section that is open on it."""
    pages = document_pages.select(document, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pages").cast("long"))).alias("page"))
    return asof(pages, sections.select(document, F.col("page").cast("long").alias("page"), "idx"), [document], "page", "idx")


def cross_references(blocks: DataFrame, sections: DataFrame, document: str = "document_id") -> DataFrame:
    """JON-14: (document, source, target, mention): "section 2.1" or "appendix B" in a block, and the section with that number."""
    text = F.lower("text")
    mentions = F.concat(F.regexp_extract_all(text, F.lit(r"\bsection\s+(\d+(?:\.\d+)*)\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\bappendix\s+([a-z0-9]+)\b"), F.lit(1)))
    found = blocks.select(document, F.col("idx").alias("source"), F.explode(F.array_distinct(mentions)).alias("mention"))
    return found.join(sections.select(document, F.lower("numbering").alias("mention"), F.col("idx").alias("target")), [document, "mention"]).select(document, "source", "target", "mention")


def hierarchy_confidence(sections: DataFrame, document: str = "document_id") -> DataFrame:
    """AGG-22, AGG-25: n_sections, max_level, n_roots, and the confidence in the hierarchy."""
    n = F.count("*")
    numbered = F.avg((F.coalesce("numbering", F.lit("")) != "").cast("double"))
    levels = F.when(F.min("level").between(1, 6) & F.max("level").between(1, 6), 1.0).otherwise(0.5)
    size = F.when(n.between(3, 30), 1.0).otherwise(0.7)
    return sections.groupBy(document).agg(n.alias("n_sections"), F.max("level").alias("max_level"), F.count_if(F.col("level") == 1).alias("n_roots"), F.round(F.least(numbered * 0.5 + levels * 0.3 + size * 0.2, F.lit(1.0)), 6).alias("confidence"))


def resolve_labels(labels: DataFrame, sections: DataFrame, document: str = "document_id") -> DataFrame:
    """JON-10..12: (document, label, idx, how): a section for each label by full label, title, numbering, the number
    it starts with, or one containing the other; the first way that finds one, and its first section.

    The first four are joins on equality; the last tries the sections of the label's document alone.
    """
    from paperloom.functions.text import title_key

    known = sections.select(document, "idx", F.lower(F.trim("title")).alias("title"), F.lower(F.trim(F.concat_ws(" ", "numbering", "title"))).alias("full"), "numbering")
    asked = labels.select(document, "label", F.lower(F.trim("label")).alias("l"))
    lead = F.nullif(F.regexp_extract("l", r"^(\d+(?:\.\d+)*)", 1), F.lit(""))
    ways = [F.col("l") == F.col("full"), F.col("l") == F.col("title"), F.col("l") == F.col("numbering"), lead == F.col("numbering")]
    tries = [asked.join(known, [document]).filter(w).select(document, "label", "idx", F.lit(k).alias("how")) for k, w in enumerate(ways)]
    near = asked.join(known, [document]).filter((title_key(F.col("l")) != "") & (F.contains("title", title_key(F.col("l"))) | F.contains("l", "title")))
    tries.append(near.select(document, "label", "idx", F.lit(4).alias("how")))
    every = tries[0]
    for t in tries[1:]:
        every = every.unionAll(t)
    return every.groupBy(document, "label").agg(F.min(F.struct("how", "idx")).alias("x")).select(document, "label", "x.idx", "x.how")


def section_keys(sections: DataFrame, document: str = "document_id", idx: str = "idx") -> DataFrame:
    """SNK-04: (document, idx, section_key): s.1.2 for the second child of the first section, and so on."""
    tree = with_ancestors(sections, document, idx)
    siblings = Window.partitionBy(document, F.coalesce("parent_idx", F.lit(-1))).orderBy(idx)
    tree = tree.withColumn("n", F.row_number().over(siblings))
    steps = tree.select(document, idx, F.posexplode(F.concat("ancestors", F.array(idx))).alias("at", "step"))
    numbers = tree.select(F.col(document), F.col(idx).alias("step"), "n")
    key = F.array_join(F.concat(F.array(F.lit("s")), F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"].cast("string"))), ".")
    return steps.join(numbers, [document, "step"]).groupBy(document, idx).agg(key.alias("section_key"))


def anchored_texts(documents: DataFrame, sections: DataFrame, document: str = "document_id", most: int | None = None) -> DataFrame:
    """WIN-17, WIN-18: (document, idx, start, section_text): the text from each title's first place, or with ``most``
    from behind it, to the next title's, at most so long. Titles are taken literally; those not found are left out."""
    found = sections.select(document, "idx", "title").join(documents.select(document, "text"), document).withColumn("start", F.expr("instr(text, title)").cast("long")).filter("start > 0")
    order = Window.partitionBy(document).orderBy("start", "idx")
    found = found.withColumn("next", F.lead("start").over(order))
    begin = F.col("start") + (F.length("title") if most else F.lit(0))
    body = F.substring(F.col("text"), begin, F.greatest(F.coalesce("next", F.length("text") + 1) - begin, F.lit(0)))
    return found.select(document, "idx", "start", (F.substring(F.trim(body), F.lit(1), F.lit(most)) if most else body).alias("section_text"))


def header_candidates(pages: DataFrame, document: str = "document_id", large: Column | None = None) -> DataFrame:
    """STR-15: (document, page, line, text): lines of three characters or more that are numbered, hold a section
    keyword, or for which ``large`` holds."""
    from paperloom.functions.text import has_section_keyword, numbering

    lines = pages.select(document, "page", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("text", F.trim("text")).filter(F.length("text") >= 3)
    test = numbering(F.col("text")).isNotNull() | has_section_keyword(F.col("text"))
    return lines.filter(test | large if large is not None else test)
