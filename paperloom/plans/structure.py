"""Queries of section hierarchies, page ranges, carried values and filters on chunk metadata.

Headings are the short lines of documents; see ``tables.sections``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunking, elements, hierarchy, lineage, metadata, store

from .catalog import query
from .tables import LINES_SQL, SECTIONS_SQL, lines, sections, table

#: Ancestors as the engine's own window per level doesn't: by recursion from each section to its nearest earlier one
#: of a smaller level.
PARENTS_SQL = SECTIONS_SQL + """,
parents AS (
  SELECT s.document_id, s.idx, s.level, s.title, s.numbering, s.page, max(p.idx) AS parent_idx
  FROM sections s LEFT JOIN sections p ON p.document_id = s.document_id AND p.idx < s.idx AND p.level < s.level GROUP BY ALL
),
up AS (
  SELECT document_id, idx, parent_idx AS ancestor, 1 AS distance FROM parents WHERE parent_idx IS NOT NULL
  UNION ALL
  SELECT up.document_id, up.idx, p.parent_idx, up.distance + 1 FROM up JOIN parents p ON p.document_id = up.document_id AND p.idx = up.ancestor WHERE p.parent_idx IS NOT NULL
)"""
R = "WITH RECURSIVE "


@query("section_tree", f"{R}{PARENTS_SQL} SELECT p.document_id, p.idx, p.level, p.parent_idx, (1 + count(up.ancestor))::INT AS depth FROM parents p LEFT JOIN up USING (document_id, idx) GROUP BY ALL")
def section_tree(spark, sf_dir):
    """WIN-09..11, ARR-03, ARR-11."""
    return hierarchy.with_ancestors(sections(spark, sf_dir)).select("document_id", "idx", "level", "parent_idx", "depth")


@query(
    "section_paths",
    f"{R}{PARENTS_SQL}, steps AS (SELECT document_id, idx, ancestor AS step, distance FROM up UNION ALL SELECT document_id, idx, idx, 0 FROM parents) SELECT t.document_id, t.idx, string_agg(s.title, ' > ' ORDER BY distance DESC) AS path FROM steps t JOIN sections s ON s.document_id = t.document_id AND s.idx = t.step GROUP BY ALL",
)
def section_paths(spark, sf_dir):
    """ARR-01, ARR-02, ARR-06, STR-31."""
    return hierarchy.paths(sections(spark, sf_dir)).select("document_id", "idx", F.array_join("path", " > ").alias("path"))


@query(
    "numbering_paths",
    f"{R}{PARENTS_SQL}, steps AS (SELECT document_id, idx, ancestor AS step, distance FROM up UNION ALL SELECT document_id, idx, idx, 0 FROM parents) SELECT t.document_id, t.idx, string_agg(coalesce(s.numbering, s.title), '/' ORDER BY distance DESC) AS path FROM steps t JOIN sections s ON s.document_id = t.document_id AND s.idx = t.step GROUP BY ALL",
)
def numbering_paths(spark, sf_dir):
    """ARR-12."""
    return hierarchy.paths(sections(spark, sf_dir), number="numbering").select("document_id", "idx", F.array_join("path", "/").alias("path"))


PARENT_IDS_SQL = f"""{SECTIONS_SQL}, nodes AS (
  SELECT document_id, 's' || idx AS id, title, 's' || CASE WHEN prev IS NULL AND document_id % 5 = 0 THEN nth_value(idx, 3) OVER (PARTITION BY document_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) WHEN idx % 4 <> 0 THEN prev END AS up
  FROM (SELECT *, lag(idx) OVER (PARTITION BY document_id ORDER BY idx) AS prev FROM sections)
),
walk AS (
  SELECT document_id, id AS start, up, [id] AS path, [title] AS titles FROM nodes
  UNION ALL
  SELECT w.document_id, w.start, n.up, list_prepend(n.id, w.path), list_prepend(n.title, w.titles)
  FROM walk w JOIN nodes n ON n.document_id = w.document_id AND n.id = w.up WHERE NOT list_contains(w.path, n.id)
),
whole AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY document_id, start ORDER BY len(path) DESC) = 1)"""


def _parent_ids(spark, sf_dir):
    """Sections with the id of the section before as parent; in every fifth document the first one hangs on the third,
    so that parents may run in a circle."""
    rows = sections(spark, sf_dir)
    order = Window.partitionBy("document_id").orderBy("idx")
    third = F.nth_value("idx", 3).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.lag("idx").over(order)
    up = F.when(before.isNull() & (F.col("document_id") % 5 == 0), third).when(F.col("idx") % 4 != 0, before)
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return rows.select("document_id", name(F.col("idx")).alias("section_id"), name(up).alias("parent_id"), "title", "idx")


@query("parent_paths", f"{R}{PARENT_IDS_SQL} SELECT document_id, start AS section_id, array_to_string(path, '/') AS path, array_to_string(titles, ' > ') AS titles, len(path)::INT AS depth, coalesce(list_contains(path, up), false) AS circular FROM whole")
def parent_paths(spark, sf_dir):
    """ARR-01, ARR-02, ARR-03, ARR-06, WIN-09 by parent ids, of any depth, circles cut."""
    nodes = _parent_ids(spark, sf_dir)
    found = lineage.paths(nodes, order="idx")
    titles = lineage.along(found, nodes, F.col("title")).withColumn("titles", F.array_join("labels", " > ")).drop("labels")
    return found.join(titles, ["document_id", "section_id"]).select("document_id", "section_id", F.array_join("path", "/").alias("path"), "titles", "depth", "circular")


@query("parent_descendants", f"{R}{PARENT_IDS_SQL} SELECT document_id, path[i] AS ancestor, start AS section_id, (len(path) - i)::INT AS distance FROM whole, unnest(range(1, len(path))) AS steps(i)")
def parent_descendants(spark, sf_dir):
    """ARR-04, ARR-09 by parent ids."""
    return lineage.descendants(lineage.paths(_parent_ids(spark, sf_dir), order="idx"))


@query("section_descendants", f"{R}{PARENTS_SQL} SELECT document_id, ancestor, idx, distance::INT AS distance FROM up")
def section_descendants(spark, sf_dir):
    """ARR-04, ARR-09."""
    return hierarchy.descendants(sections(spark, sf_dir))


@query("section_children", f"WITH {PARENTS_SQL.split(',' + chr(10) + 'up AS')[0]} SELECT document_id, parent_idx, count(*)::BIGINT AS n_children, min(idx) AS first_child, max(idx) AS last_child FROM parents WHERE parent_idx IS NOT NULL GROUP BY ALL")
def section_children(spark, sf_dir):
    """ARR-05, AGG-19."""
    return hierarchy.children(sections(spark, sf_dir))


@query("leaf_sections", f"WITH {PARENTS_SQL.split(',' + chr(10) + 'up AS')[0]} SELECT document_id, idx, title FROM sections s WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.document_id = s.document_id AND p.parent_idx = s.idx)")
def leaf_sections(spark, sf_dir):
    """SET-08."""
    return hierarchy.leaves(sections(spark, sf_dir)).select("document_id", "idx", "title")


@query(
    "page_ends",
    f"""WITH {SECTIONS_SQL} SELECT document_id, idx, page, CASE WHEN lead(idx) OVER o IS NULL THEN NULL ELSE coalesce(min(page) OVER (PARTITION BY document_id ORDER BY page RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, page) END AS page_end, lead(page) OVER o AS next_start
FROM sections WINDOW o AS (PARTITION BY document_id ORDER BY page, idx)""",
)
def page_ends(spark, sf_dir):
    """WIN-07, WIN-08."""
    return hierarchy.page_end(sections(spark, sf_dir)).select("document_id", "idx", "page", "page_end", "next_start")


@query("hierarchy_confidence", f"""WITH {SECTIONS_SQL} SELECT document_id, count(*)::BIGINT AS n_sections, max(level) AS max_level, (count(*) FILTER (level = 1))::BIGINT AS n_roots,
round(least(avg((numbering IS NOT NULL)::INT) * 0.5::DOUBLE + (CASE WHEN bool_and(level BETWEEN 1 AND 6) THEN 1.0 ELSE 0.5 END)::DOUBLE * 0.3::DOUBLE + (CASE WHEN count(*) BETWEEN 3 AND 30 THEN 1.0 ELSE 0.7 END)::DOUBLE * 0.2::DOUBLE, 1.0), 6) AS confidence FROM sections GROUP BY document_id""")
def hierarchy_confidence(spark, sf_dir):
    """AGG-22, AGG-25."""
    return hierarchy.hierarchy_confidence(sections(spark, sf_dir))


CARRIED_SQL = f"""{LINES_SQL}, h AS (SELECT *, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) <= 6 THEN idx END AS heading FROM lines),
c AS (SELECT document_id, idx, text, last_value(heading IGNORE NULLS) OVER w AS heading, count(heading) OVER w AS part FROM h WINDOW w AS (PARTITION BY document_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _carried(rows):
    value = F.when(F.size(F.split(F.trim("text"), r"\s+")) <= 6, F.col("idx"))
    return hierarchy.carried(rows, "document_id", "idx", value, "heading")


@query("carried_headings", f"WITH {CARRIED_SQL} SELECT document_id, idx, heading, part::BIGINT AS heading_part FROM c")
def carried_headings(spark, sf_dir):
    """WIN-12, WIN-13, SRC-06."""
    return _carried(lines(spark, sf_dir)).select("document_id", "idx", "heading", "heading_part")


@query("section_texts", f"WITH {CARRIED_SQL} SELECT document_id, heading AS section_idx, md5(string_agg(trim(text, ' '), chr(10) || chr(10) ORDER BY idx)) AS digest, count(*)::BIGINT AS n_blocks FROM c WHERE heading IS NOT NULL GROUP BY ALL")
def section_texts(spark, sf_dir):
    """AGG-20, SRC-10, SRC-11."""
    rows = _carried(lines(spark, sf_dir)).filter("heading is not null").withColumnRenamed("heading", "section_idx")
    return chunking.section_texts(rows).select("document_id", "section_idx", F.md5("section_text").alias("digest"), "n_blocks")


@query("unresolved_chunks", f"WITH {CARRIED_SQL} SELECT document_id, idx, (row_number() OVER (PARTITION BY document_id ORDER BY idx) - 1)::BIGINT AS chunk_index, 'Unlabeled Section' AS section_title FROM c WHERE heading IS NULL AND len(regexp_split_to_array(trim(text), '\\s+')) >= 50")
def unresolved_chunks(spark, sf_dir):
    """CHK-07, CHK-11."""
    return chunking.fallback_chunks(_carried(lines(spark, sf_dir)).filter("heading is null")).select("document_id", "idx", "chunk_index", "section_title")


@query("first_occurrence", f"WITH {SECTIONS_SQL} SELECT document_id, regexp_replace(trim(lower(title), ' '), '\\s+', ' ', 'g') AS norm, min(idx) AS first_idx, count(*)::BIGINT AS n FROM sections GROUP BY ALL")
def first_occurrence(spark, sf_dir):
    """WIN-16, SET-10."""
    norm = F.regexp_replace(F.trim(F.lower("title")), r"\s+", " ")
    return sections(spark, sf_dir).groupBy("document_id", norm.alias("norm")).agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"))


@query("pruned_repeats", f"WITH {SECTIONS_SQL} SELECT document_id, idx, title FROM sections QUALIFY row_number() OVER (PARTITION BY document_id, lower(trim(title)) ORDER BY page, idx) = 1 OR regexp_matches(lower(title), 'revisit|re-read|read again|return to|after reading|cross-check|compare|deepen|synthesize')")
def pruned_repeats(spark, sf_dir):
    """SET-11, FIL-23."""
    return store.prune_repeats(sections(spark, sf_dir), "document_id", ["page", "idx"], "title", F.col("title")).select("document_id", "idx", "title")


@query("repeated_titles", f"WITH {SECTIONS_SQL} SELECT document_id, lower(trim(title)) AS norm, count(*)::BIGINT AS n FROM sections GROUP BY ALL HAVING count(*) > 1")
def repeated_titles(spark, sf_dir):
    """SET-10."""
    return store.repeated(sections(spark, sf_dir), ["document_id"], "title")


@query("keyword_sections", f"WITH {SECTIONS_SQL}, k AS (SELECT unnest(['the', 'license', 'und', 'la']) AS keyword) SELECT document_id, keyword, min(idx) AS idx, arg_min(title, idx) AS title, count(*)::BIGINT AS n FROM sections JOIN k ON contains(lower(title), keyword) GROUP BY ALL")
def keyword_sections(spark, sf_dir):
    """ARR-07, ARR-17, TOP-10."""
    words = spark.createDataFrame([("the",), ("license",), ("und",), ("la",)], "keyword string")
    return metadata.keyword_sections(sections(spark, sf_dir), words, "document_id", "idx")


@query("resolved_labels", f"""WITH {SECTIONS_SQL}, a AS (SELECT DISTINCT document_id, title AS label FROM sections WHERE level = 1), l AS (SELECT document_id, label, lower(trim(label)) AS l FROM a),
k AS (SELECT document_id, idx, lower(trim(title)) AS title, lower(trim(concat_ws(' ', numbering, title))) AS whole, numbering FROM sections),
t AS (SELECT l.*, k.*, trim(regexp_replace(regexp_replace(l.l, '^\\s*\\d+(?:\\.\\d+)*\\s*[:.)-]?\\s*', ''), '\\s+', ' ', 'g'), ' ') AS key FROM l JOIN k ON l.document_id = k.document_id),
m AS (SELECT document_id, label, idx, CASE WHEN l = whole THEN 0 WHEN l = title THEN 1 WHEN l = numbering THEN 2 WHEN nullif(regexp_extract(l, '^(\\d+(?:\\.\\d+)*)', 1), '') = numbering THEN 3 WHEN key <> '' AND (contains(title, key) OR contains(l, title)) THEN 4 END AS how FROM t)
SELECT document_id, label, idx, how::INT AS how FROM m WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, label ORDER BY how, idx) = 1""")
def resolved_labels(spark, sf_dir):
    """JON-10..12."""
    rows = sections(spark, sf_dir)
    return hierarchy.resolve_labels(rows.filter("level = 1").select("document_id", F.col("title").alias("label")).distinct(), rows)


@query("cross_references", f"""WITH {SECTIONS_SQL}, m AS (SELECT document_id, idx AS source, unnest(list_distinct(list_concat(regexp_extract_all(lower(text), '\\bsection\\s+(\\d+(?:\\.\\d+)*)\\b', 1), regexp_extract_all(lower(text), '\\bappendix\\s+([a-z0-9]+)\\b', 1)))) AS mention
 FROM (SELECT document_id, idx, text || ' see section ' || (idx // 2) AS text FROM lines)) SELECT m.document_id, m.source, s.idx AS target, m.mention FROM m JOIN sections s ON s.document_id = m.document_id AND lower(s.numbering) = m.mention""")
def cross_references(spark, sf_dir):
    """JON-14: every line is given a mention, as there are none."""
    rows = lines(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" see section "), F.floor(F.col("idx") / 2).cast("string")))
    return hierarchy.cross_references(rows, sections(spark, sf_dir))


@query("page_elements", f"""WITH {SECTIONS_SQL}, e AS (SELECT document_id, idx, idx // 4 AS page FROM lines), r AS (SELECT document_id, idx AS section_idx, page AS page_start, lead(page) OVER (PARTITION BY document_id ORDER BY idx) AS page_end FROM sections)
SELECT e.document_id, e.idx, e.page, section_idx, page_start, page_end FROM e JOIN r ON r.document_id = e.document_id AND e.page BETWEEN page_start AND coalesce(page_end, page_start)""")
def page_elements(spark, sf_dir):
    """JON-05, JON-06, CHK-09."""

    ranges = sections(spark, sf_dir).select("document_id", F.col("idx").alias("section_idx"), F.col("page").alias("page_start"), F.lead("page").over(Window.partitionBy("document_id").orderBy("idx")).alias("page_end"))
    return hierarchy.page_range_join(lines(spark, sf_dir).select("document_id", "idx", F.floor(F.col("idx") / 4).cast("long").alias("page")), ranges)


@query("page_sections", f"""WITH {SECTIONS_SQL}, p AS (SELECT document_id, unnest(range(1, max(idx) // 4 + 2))::BIGINT AS page FROM lines GROUP BY document_id)
SELECT p.document_id, p.page, max(s.idx) AS idx FROM p LEFT JOIN sections s ON s.document_id = p.document_id AND s.page <= p.page GROUP BY ALL""")
def page_sections(spark, sf_dir):
    """JON-07, JON-08: the last section that begins on or before each page."""
    pages = lines(spark, sf_dir).groupBy("document_id").agg((F.floor(F.max("idx") / 4) + 1).alias("n_pages"))
    return hierarchy.pages_of(pages, sections(spark, sf_dir))


@query("asof_orders", """SELECT e.event_id, e.user_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_orders(spark, sf_dir):
    """JON-07: each event with its user's last order by then; of orders of one time the largest key. Users are cut by days, as one may have a third of all events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("at"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), "o_orderkey")
    return hierarchy.asof(events, orders, ["user_id"], "at", "o_orderkey", F.to_date("at")).select("event_id", "user_id", "o_orderkey")


FILTER_SQL = """SELECT doc_id, source, lang FROM documents WHERE lang IN ('en', 'es') AND list_has_any([source, lang], ['src1', 'src2', 'es']) AND NOT regexp_matches(text, '^\\s*(?:\\d+(?:\\.\\d+)*)?\\s*[:.)-]?\\s*(?i:references?|bibliography|works cited)\\b')"""


@query("payload_filter", FILTER_SQL)
def payload_filter(spark, sf_dir):
    """FIL-01..03, FIL-05, ARR-08, ARR-09: a conjunction of equality, any-of and must-not."""
    docs = table(spark, sf_dir, "documents")
    path = F.array("source", "lang")
    return docs.filter(F.col("lang").isin("en", "es") & F.arrays_overlap(path, F.array(F.lit("src1"), F.lit("src2"), F.lit("es"))) & ~T.is_reference_heading(F.col("text"))).select("doc_id", "source", "lang")


@query("title_lookup", f"WITH {SECTIONS_SQL} SELECT trim(regexp_replace(lower(title), '\\s+', ' ', 'g'), ' ') AS norm, array_to_string(list_sort(list(DISTINCT title)), '|') AS titles FROM sections WHERE trim(title) <> '' GROUP BY norm")
def title_lookup(spark, sf_dir):
    """SNK-13, SRC-12."""
    return store.title_lookup(sections(spark, sf_dir), F.array("title")).select("norm", F.array_join("titles", "|").alias("titles"))


@query("audit", f"""WITH {SECTIONS_SQL}, p AS (SELECT document_id, CASE WHEN idx % 7 = 0 THEN NULL WHEN idx % 5 = 0 THEN 'none such' ELSE title END AS title FROM sections), k AS (SELECT DISTINCT document_id, title FROM sections)
SELECT p.document_id, count(*)::BIGINT AS n_points, (count(*) FILTER (p.title IS NULL))::BIGINT AS n_untitled, (count(*) FILTER (p.title IS NOT NULL AND k.title IS NULL))::BIGINT AS n_unknown FROM p LEFT JOIN k USING (document_id, title) GROUP BY p.document_id""")
def audit(spark, sf_dir):
    """JON-16, JON-20, AGG-12."""
    rows = sections(spark, sf_dir)
    points = rows.withColumn("title", F.when(F.col("idx") % 7 == 0, None).when(F.col("idx") % 5 == 0, "none such").otherwise(F.col("title")))
    return store.audit(points, rows, "document_id", "title")


@query("section_keys", f"""{R}{PARENTS_SQL}, n AS (SELECT document_id, idx, row_number() OVER (PARTITION BY document_id, coalesce(parent_idx, -1) ORDER BY idx) AS n FROM parents),
steps AS (SELECT document_id, idx, ancestor AS step, distance FROM up UNION ALL SELECT document_id, idx, idx, 0 FROM parents)
SELECT t.document_id, t.idx, 's.' || string_agg(n.n::VARCHAR, '.' ORDER BY distance DESC) AS section_key FROM steps t JOIN n ON n.document_id = t.document_id AND n.idx = t.step GROUP BY ALL""")
def section_keys(spark, sf_dir):
    """SNK-04."""
    return hierarchy.section_keys(sections(spark, sf_dir))


@query("anchored_texts", f"""WITH {SECTIONS_SQL}, f AS (SELECT s.document_id, s.idx, s.title, d.text, instr(d.text, s.title)::BIGINT AS start FROM sections s JOIN documents d ON d.doc_id = s.document_id),
n AS (SELECT *, lead(start) OVER (PARTITION BY document_id ORDER BY start, idx) AS next FROM f WHERE start > 0)
SELECT document_id, idx, start, md5(substring(text, start, greatest(coalesce(next, length(text) + 1) - start, 0))) AS digest FROM n""")
def anchored_texts(spark, sf_dir):
    """WIN-17."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return hierarchy.anchored_texts(docs, sections(spark, sf_dir)).select("document_id", "idx", "start", F.md5("section_text").alias("digest"))


@query("section_snippets", f"""WITH {SECTIONS_SQL}, f AS (SELECT s.document_id, s.idx, s.title, d.text, instr(d.text, s.title)::BIGINT AS start FROM sections s JOIN documents d ON d.doc_id = s.document_id),
n AS (SELECT *, lead(start) OVER (PARTITION BY document_id ORDER BY start, idx) AS next FROM f WHERE start > 0)
SELECT document_id, idx, start, md5(substring(trim(substring(text, start + length(title), greatest(coalesce(next, length(text) + 1) - start - length(title), 0)), ' '), 1, 1800)) AS digest FROM n""")
def section_snippets(spark, sf_dir):
    """WIN-18."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return hierarchy.anchored_texts(docs, sections(spark, sf_dir), most=1800).select("document_id", "idx", "start", F.md5("section_text").alias("digest"))


@query("header_candidates", f"""WITH {LINES_SQL} SELECT document_id, idx AS line FROM lines WHERE length(trim(text, ' ')) >= 3 AND (regexp_matches(trim(text, ' '), '^([IVX]+)[\\.\\-]([A-Z]|\\d+)?\\s*') OR regexp_matches(trim(text, ' '), '^(\\d+(?:\\.\\d+)*)\\s+')
 OR regexp_matches(trim(text, ' '), '^([A-Z])[\\.\\)](\\d+)?\\s*') OR regexp_matches(trim(text, ' '), '^(\\d+)[\\.)\\]]\\s+') OR regexp_matches(lower(trim(text, ' ')), '{"|".join(T.SECTION_KEYWORDS)}'))""")
def header_candidates(spark, sf_dir):
    """STR-10, STR-13, STR-15."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    return hierarchy.header_candidates(pages).select("document_id", F.col("line").cast("long").alias("line"))


@query("table_chunks", f"""WITH {LINES_SQL} SELECT document_id, idx::VARCHAR AS id, (idx // 4)::BIGINT AS page, 'Table' || chr(10) || trim(text, ' ') AS content, 'table' AS content_type FROM lines WHERE contains(text, ' | ')""")
def table_chunks(spark, sf_dir):
    """CHK-05, CHK-06: lines with bars as tables."""
    rows = lines(spark, sf_dir).filter(F.contains("text", F.lit(" | ")))
    tables = rows.select("document_id", F.col("idx").cast("string").alias("id"), F.floor(F.col("idx") / 4).cast("long").alias("page"), "text", F.lit(None).cast("string").alias("markdown"), F.lit("Table").alias("caption"))
    return chunking.table_chunks(tables).drop("chunk_level")


@query("paper_chunks")
def paper_chunks(spark, sf_dir):
    """CHK-08: each document as one section; packing has no SQL."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("1").alias("numbering"), F.col("text").alias("section_text"))
    return chunking.paper_chunks(docs)


@query("section_numbers", f"WITH {SECTIONS_SQL} SELECT document_id, title AS key, max(idx) AS idx FROM sections GROUP BY ALL")
def section_numbers(spark, sf_dir):
    """JON-19: the last section of each title."""
    return elements.section_maps(sections(spark, sf_dir), F.col("title"))


KEY_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '^\\s*\\d+(?:\\.\\d+)*\\s*[:.)-]?\\s*', ''), '\\s+', ' ', 'g'), ' ')"


@query("resolved_blocks", f"""WITH {SECTIONS_SQL}, s AS (SELECT document_id, document_id || '_' || idx AS section_id, {KEY_SQL.format('title')} AS key, page AS page_start, CASE WHEN idx % 4 > 0 THEN page + 1 END AS page_end, idx AS reading_order FROM sections),
n1 AS (SELECT document_id, idx AS id, lead(title) OVER (PARTITION BY document_id ORDER BY idx) AS text, title, page + idx % 3 AS page, idx FROM sections),
b AS (SELECT document_id, id, CASE WHEN id % 2 = 0 THEN document_id || '_' || idx END AS section_id, {KEY_SQL.format("coalesce(text, '')")} AS k1, {KEY_SQL.format('title')} AS k2, page FROM n1),
c AS (SELECT DISTINCT b.document_id, b.id, b.page, s.section_id, s.reading_order, coalesce(b.page >= page_start AND (page_end IS NULL OR b.page <= page_end), false) AS held
  FROM b JOIN s ON s.document_id = b.document_id AND s.key <> '' AND s.key IN (b.k1, b.k2)),
r AS (SELECT * FROM (SELECT *, bool_or(held) OVER (PARTITION BY document_id, id) AS any_held FROM c) WHERE held OR NOT any_held),
n AS (SELECT document_id, id, section_id AS by_title FROM r QUALIFY row_number() OVER (PARTITION BY document_id, id ORDER BY reading_order, section_id) = 1)
SELECT b.document_id, b.id, coalesce(s.section_id, n.by_title) AS resolved_id FROM b LEFT JOIN s ON s.document_id = b.document_id AND s.section_id = b.section_id LEFT JOIN n ON n.document_id = b.document_id AND n.id = b.id""")
def resolved_blocks(spark, sf_dir):
    """JON-09: every second heading has an id; the others have the next heading as their text and their own as their
    section's title. Every fourth section has no end."""
    rows = sections(spark, sf_dir)
    name = F.concat_ws("_", F.col("document_id").cast("string"), F.col("idx").cast("string"))
    known = rows.select("document_id", name.alias("section_id"), "title", F.col("page").alias("page_start"), F.when(F.col("idx") % 4 > 0, F.col("page") + 1).alias("page_end"), F.col("idx").alias("reading_order"))
    following = F.lead("title").over(Window.partitionBy("document_id").orderBy("idx"))
    blocks = rows.select("document_id", F.col("idx").alias("id"), F.when(F.col("idx") % 2 == 0, name).alias("section_id"), following.alias("text"), F.col("title").alias("section_title"), (F.col("page") + F.col("idx") % 3).alias("page"))
    return elements.resolve_blocks(blocks, known).select("document_id", "id", "resolved_id")


@query("visual_ids", f"""WITH {SECTIONS_SQL}, e AS (SELECT document_id, level::VARCHAR AS section_id, idx::VARCHAR AS id, CASE WHEN idx % 2 = 0 THEN 'figure' ELSE 'table' END AS kind FROM sections),
g AS (SELECT document_id, kind, section_id, array_to_string(list_sort(list(id)), '+') AS ids FROM e GROUP BY ALL)
SELECT document_id, coalesce(string_agg(section_id || '=' || ids, ';' ORDER BY section_id) FILTER (kind = 'figure'), '') AS figures, coalesce(string_agg(section_id || '=' || ids, ';' ORDER BY section_id) FILTER (kind = 'table'), '') AS tables FROM g GROUP BY document_id""")
def visual_ids(spark, sf_dir):
    """ARR-13: headings of even places as figures, the others as tables, levels as sections."""
    rows = sections(spark, sf_dir).select("document_id", F.col("level").cast("string").alias("section_id"), F.col("idx").cast("string").alias("id"), F.when(F.col("idx") % 2 == 0, "figure").otherwise("table").alias("kind"))
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "+"))), ";")
    return elements.visual_ids(rows).select("document_id", shown(F.col("figures")).alias("figures"), shown(F.col("tables")).alias("tables"))


@query("title_mismatches", f"""WITH {CARRIED_SQL}, k AS (SELECT document_id, idx, coalesce(heading::VARCHAR, '') AS heading, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM c),
q AS (SELECT document_id, idx // 2 AS chunk_id, string_agg(t, ' ' ORDER BY idx) AS content, 'Part ' || (max(idx) // 3) AS section_title FROM k GROUP BY ALL),
m AS (SELECT q.document_id, q.chunk_id, section_title, arg_min('Part ' || heading, k.idx) AS heading, arg_min(heading, k.idx) AS plain FROM q JOIN k ON k.document_id = q.document_id AND length(k.t) >= 24 AND length(content) >= 24 AND contains(q.content, substring(k.t, 1, 96)) GROUP BY ALL)
SELECT document_id, chunk_id, section_title, heading FROM m WHERE plain <> '' AND lower(section_title) <> lower(heading)""")
def title_mismatches(spark, sf_dir):
    """ARR-19: two lines are a chunk, and each line a block with the heading that is carried to it. Lines are dealt by
    document once, for both."""
    rows = _carried(lines(spark, sf_dir).repartition("document_id")).select("document_id", "idx", "text", F.coalesce(F.col("heading").cast("string"), F.lit("")).alias("place"))
    blocks = rows.select("document_id", "idx", "text", F.when(F.col("place") != "", F.concat(F.lit("Part "), "place")).otherwise("").alias("heading"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", T.collapsed(F.col("text")).alias("t")))), lambda x: x["t"]), " ")
    chunks = rows.groupBy("document_id", F.floor(F.col("idx") / 2).cast("long").alias("chunk_id")).agg(joined.alias("content"), F.concat(F.lit("Part "), F.floor(F.max("idx") / 3).cast("long").cast("string")).alias("section_title")).withColumn("content_type", F.lit("text"))
    return elements.title_mismatches(chunks, blocks).select("document_id", "chunk_id", "section_title", "heading")


@query("range_texts", f"""WITH {SECTIONS_SQL}, p AS (SELECT document_id, idx // 4 AS page, string_agg(text, chr(10) ORDER BY idx) AS text FROM lines GROUP BY ALL)
SELECT s.document_id, s.idx AS section_idx, md5(string_agg(p.text, chr(10) || chr(10) ORDER BY p.page)) AS digest FROM sections s JOIN p ON p.document_id = s.document_id AND p.page BETWEEN s.page AND s.page + 1 GROUP BY ALL""")
def range_texts(spark, sf_dir):
    """CHK-09, CHK-10: two pages from each heading on."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    pages = lines(spark, sf_dir).groupBy("document_id", F.floor(F.col("idx") / 4).cast("long").alias("page")).agg(text.alias("text"))
    ranges = sections(spark, sf_dir).select("document_id", F.col("idx").alias("section_idx"), F.col("page").alias("page_start"), (F.col("page") + 1).alias("page_end"))
    return elements.range_texts(pages, ranges).select("document_id", "section_idx", F.md5("text").alias("digest"))


@query("element_ids_by_title", f"""WITH {SECTIONS_SQL}, f AS (SELECT document_id, title AS label, arg_min([idx::VARCHAR, level::VARCHAR], idx) AS ids FROM sections GROUP BY ALL)
SELECT document_id, label, array_to_string(ids, '|') AS element_ids FROM f""")
def element_ids_by_title(spark, sf_dir):
    """ARR-20."""
    rows = sections(spark, sf_dir).withColumn("a", F.array(F.col("idx").cast("string"))).withColumn("b", F.array(F.col("level").cast("string")))
    labels = rows.select("document_id", F.col("title").alias("label")).distinct()
    return elements.element_ids_by_title(labels, rows, ids=("a", "b")).select("document_id", "label", F.array_join("element_ids", "|").alias("element_ids"))


@query("documents_removed", "SELECT vec_id FROM embeddings WHERE label NOT IN (SELECT quality FROM labels)")
def documents_removed(spark, sf_dir):
    """SNK-18: the points left when those of some labels go."""
    gone = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))
    return elements.without_documents(table(spark, sf_dir, "embeddings").select("vec_id", "label"), gone, "label").select("vec_id")
