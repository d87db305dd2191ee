"""Queries of rules on headings, references, terms and section trees that work on what other queries make.

The tables have no headings with numbers, references or nested sections; each query says how it makes them of lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import answering, chunking, elements, hierarchy, terms

from .catalog import query
from .documents import SENTENCES_SQL, WORD_SQL
from .structure import PARENTS_SQL, R
from .tables import LINES_SQL, SECTIONS_SQL, lines, sections, table

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Section titles with numbers, in capitals, as appendices and as references.
HEADINGS_SQL = SECTIONS_SQL + f""",
h AS (
  SELECT document_id, idx, CASE WHEN idx % 4 = 0 THEN 'text' ELSE ' Section_Header' END AS label, CASE idx % 7
    WHEN 0 THEN (idx % 9) || '.' || (idx % 5) || ' ' || title WHEN 1 THEN translate(title, '{LOW}', '{UP}') WHEN 2 THEN 'Appendix ' || chr((97 + idx % 26)::INT) || ': ' || title
    WHEN 3 THEN 'IV-B ' || title WHEN 4 THEN 'Works of the Past, References' WHEN 5 THEN (idx % 9) || ') ' || title ELSE title END AS heading,
    CASE WHEN idx % 3 > 0 THEN (8 + idx % 11)::DOUBLE END AS font_size
  FROM sections
)"""


def _headings(spark, sf_dir):
    n, title = F.col("idx"), F.col("title")
    num = lambda k: (n % k).cast("string")
    made = (
        F.when(n % 7 == 0, F.concat(num(9), F.lit("."), num(5), F.lit(" "), title))
        .when(n % 7 == 1, F.translate(title, LOW, UP))
        .when(n % 7 == 2, F.concat(F.lit("Appendix "), F.char(97 + n % 26), F.lit(": "), title))
        .when(n % 7 == 3, F.concat(F.lit("IV-B "), title))
        .when(n % 7 == 4, F.lit("Works of the Past, References"))
        .when(n % 7 == 5, F.concat(num(9), F.lit(") "), title))
        .otherwise(title)
    )
    return sections(spark, sf_dir).select("document_id", "idx", F.when(n % 4 == 0, "text").otherwise(" Section_Header").alias("label"), made.alias("heading"), F.when(n % 3 > 0, (8 + n % 11).cast("double")).alias("font_size"))


@query(
    "heading_rules",
    rf"""WITH {HEADINGS_SQL},
m AS (SELECT *, regexp_replace(coalesce(nullif(regexp_extract(heading, '^([IVX]+)[\.\-]([A-Z]|\d+)?\s*'), ''), nullif(regexp_extract(heading, '^(\d+(?:\.\d+)*)\s+'), ''), nullif(regexp_extract(heading, '^([A-Z])[\.\)](\d+)?\s*'), ''), nullif(regexp_extract(heading, '^(\d+)[\.)\]]\s+'), '')), '\s+$', '') AS numbering,
  regexp_extract_all(heading, '[A-Za-z][A-Za-z''\-]*') AS words, trim(regexp_replace(heading, '\s+', ' ', 'g'), ' ') AS flat FROM h),
c AS (SELECT *, len(words) > 0 AND len(list_filter(words, lambda w, i: NOT (w = upper(w) OR (i > 1 AND lower(w) IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'via', 'with')) OR (left(w, 1) = upper(left(w, 1)) AND substr(w, 2) = lower(substr(w, 2)))))) = 0 AS title_case FROM m)
SELECT document_id, idx, numbering, title_case,
  (CASE WHEN numbering <> '' THEN len(numbering) - len(replace(numbering, '.', '')) + 1 WHEN font_size >= 16 THEN 1 WHEN font_size >= 14 THEN 2 WHEN font_size >= 12 THEN 3 WHEN font_size IS NOT NULL THEN 4 ELSE 1 END)::INT AS level,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(heading, '^([IVX]+)[\.\-]([A-Z]|\d+)?\s*', ''), '^(\d+(?:\.\d+)*)\s+', ''), '^([A-Z])[\.\)](\d+)?\s*', ''), '^(\d+)[\.)\]]\s+', ''), '^\s+|\s+$', '', 'g')) AS bare,
  lower(trim(label, ' ')) = 'section_header' AND len(regexp_extract_all(flat, '[A-Za-z0-9_]+')) BETWEEN 1 AND 12 AND (regexp_matches(flat, '^\d+[.\d]*\s') OR title_case) AS is_heading,
  CASE WHEN regexp_matches(trim(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' '), '^(appendix|appendices|supplement)') THEN 'appendix' END AS section_type,
  upper(nullif(regexp_extract(heading, '(?i)\bappendix\s+([a-zA-Z0-9]+)\b', 1), '')) AS appendix_label, regexp_matches(lower(heading), 'reference|bibliography|citations') AS is_reference FROM c""",
)
def heading_rules(spark, sf_dir):
    """STR-10..12, STR-14, FIL-07, FIL-08, FIL-09."""
    h = F.col("heading")
    return _headings(spark, sf_dir).select(
        "document_id", "idx", T.numbering(h).alias("numbering"), T.is_title_cased(h).alias("title_case"), T.level(h, F.col("font_size")).alias("level"), F.md5(T.unnumbered(h)).alias("bare"),
        T.is_heading(h, F.col("label")).alias("is_heading"), T.section_type(h).alias("section_type"), T.appendix_label(h).alias("appendix_label"), answering.is_reference_result(h).alias("is_reference"),
    )


@query(
    "reference_lists",
    rf"""WITH {LINES_SQL}, g AS (SELECT document_id, idx // 40 AS part, list(regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY idx) AS t FROM lines GROUP BY ALL)
SELECT document_id, part, md5(array_to_string(list_filter(t, lambda v, i: v <> '' AND list_position(t, v) = i), chr(10))) AS digest FROM g""",
)
def reference_lists(spark, sf_dir):
    """SET-06: forty lines as a block of references."""
    rows = lines(spark, sf_dir).groupBy("document_id", F.floor(F.col("idx") / 40).cast("long").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("t"))
    return rows.select("document_id", "part", F.md5(answering.joined_references(F.col("t"))).alias("digest"))


@query(
    "texts_without_references",
    r"""WITH p AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x, i: (i - 1) % 5 = 0) AS parts FROM documents),
s AS (SELECT *, list_reduce(list_concat([text], list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20)), lambda a, x: replace(a, x, '')) AS kept FROM p)
SELECT doc_id, length(kept)::BIGINT AS n_kept, md5(kept) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(kept, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS kept FROM s)""",
)
def texts_without_references(spark, sf_dir):
    """STR-24: each fifth line is a reference."""
    parts = F.filter(F.split("text", "\n"), lambda x, i: i % 5 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", T.without_texts(F.col("text"), parts).alias("kept")).select("doc_id", F.length("kept").cast("long").alias("n_kept"), F.md5("kept").alias("digest"))


@query(
    "texts_without_images",
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) <= 600 THEN flat ELSE coalesce(nullif(regexp_extract(left(flat, 600), '(?s)^(.*) ', 1), ''), left(flat, 600)) || '...' END AS short FROM t""",
)
def texts_without_images(spark, sf_dir):
    """STR-23: an image stands before each line."""
    held = F.regexp_replace("text", "\n", "\n![Image](data:image/png;base64,iVBORw0KGgo=)")
    return table(spark, sf_dir, "documents").select("doc_id", T.without_data_uris(held).alias("short"))


FOCUS_SQL = LINES_SQL + r""",
f AS (
  SELECT document_id, scope, text, min(idx) AS idx FROM (
    SELECT document_id, CASE idx // 4 % 5 WHEN 0 THEN 'abstract' WHEN 1 THEN 'introduction' END AS scope, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, idx FROM lines)
  WHERE scope IS NOT NULL AND text <> '' GROUP BY ALL
)"""


def _focus(spark, sf_dir):
    k = F.floor(F.col("idx") / 4) % 5
    return elements.focus_blocks(lines(spark, sf_dir).withColumn("heading", F.when(k == 0, "1. Abstract").when(k == 1, "2 Intro: scope").when(k == 2, "Abstraction").otherwise("Introductory")))


BUNDLE_SQL = rf"""WITH {FOCUS_SQL}, b AS (SELECT document_id, idx, scope, text, regexp_replace(text, '[\p{{L}}\p{{N}}_]*[^\x00-\x7F][\p{{L}}\p{{N}}_]*', chr(1), 'g') AS plain FROM f),
w AS (SELECT DISTINCT document_id, idx, scope, text, unnest(regexp_extract_all(plain, '{WORD_SQL}')) AS term FROM b),
n AS (SELECT *, (length(lower(text)) - length(replace(lower(text), lower(term), ''))) / length(lower(term)) AS n FROM w),
s AS (SELECT *, (n / greatest(max(n) OVER (PARTITION BY document_id, idx, scope), 1) * 0.3::DOUBLE + (CASE WHEN length(term) >= 6 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END) * 0.5::DOUBLE + 1 / 3 * 0.2::DOUBLE) AS whole FROM n),
k AS (SELECT document_id, idx, scope, term, round(whole::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS score FROM s WHERE length(term) > 3 AND lower(term) NOT IN ({', '.join(repr(x) for x in (*terms.STOPWORDS, *terms.GENERIC))}) AND whole >= 0.3 AND round(whole::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE >= 0.65),
best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY document_id, lower(term) ORDER BY score DESC, idx, scope, term) = 1),
t AS (SELECT b.document_id, b.term, b.score, array_to_string(list_sort(list_distinct(list(k.scope) FILTER (k.idx > b.idx OR (k.idx = b.idx AND k.scope = b.scope AND k.term = b.term)))), ',') AS scopes,
  CASE length(b.term) % 3 WHEN 0 THEN 'dictionary' WHEN 1 THEN 'wikipedia' END AS source FROM best b JOIN k ON k.document_id = b.document_id AND lower(k.term) = lower(b.term) GROUP BY ALL)
SELECT document_id, term, score, scopes, source, CASE WHEN source IS NULL THEN 'pending_llm' ELSE 'ready' END AS status,
  (row_number() OVER (PARTITION BY document_id ORDER BY CASE source WHEN 'dictionary' THEN 1 WHEN 'wikipedia' THEN 2 ELSE 4 END, score DESC, term))::INT AS rank FROM t QUALIFY rank <= 12"""


@query("bundle_terms", BUNDLE_SQL)
def bundle_terms(spark, sf_dir):
    """RET-18, RET-15, RET-17: terms of each document's focus blocks; every third length of a word has no definition."""
    blocks = _focus(spark, sf_dir).select(F.struct("document_id", "idx", "scope").alias("block"), "text")
    words = blocks.select("block", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(terms.CAPITALISED), F.lit(0)))).alias("term"))
    size = F.length("term") % 3
    source = F.when(size == 0, "dictionary").when(size == 1, "wikipedia")
    found = terms.scores(blocks, words, "block").select("block.*", "term", "score", source.alias("source"), F.when(source.isNotNull(), F.lit("known")).alias("definition"))
    return terms.bundle_terms(found, "document_id").select("document_id", "term", "score", F.array_join("scopes", ",").alias("scopes"), "source", "status", "rank")


@query("focus_texts", f"WITH {FOCUS_SQL} SELECT document_id, scope, idx, md5(text) AS digest FROM f")
def focus_texts(spark, sf_dir):
    """SET-12: pages as abstract, introduction and others."""
    return _focus(spark, sf_dir).select("document_id", "scope", "idx", F.md5("text").alias("digest"))


@query(
    "term_contexts",
    rf"""WITH {FOCUS_SQL}, t AS (SELECT doc_id AS document_id, regexp_extract(text, '[A-Za-z]{{8,}}') AS term FROM documents),
s AS (SELECT document_id, idx, text, unnest(generate_series(1, len(x))) AS place, unnest(x) AS sentence FROM (SELECT document_id, idx, text, {SENTENCES_SQL} AS x FROM f)),
met AS (SELECT document_id, term, arg_min(sentence, idx * 1000000 + place) AS context FROM t JOIN s USING (document_id) WHERE term <> '' AND contains(lower(sentence), lower(term)) GROUP BY ALL),
o AS (SELECT document_id, arg_min(trim(left(text, 400)), idx) AS opening FROM f GROUP BY ALL)
SELECT document_id, term, CASE WHEN term = '' THEN '' ELSE coalesce(context, opening, '') END AS context FROM (SELECT DISTINCT document_id, term FROM t WHERE term IS NOT NULL) LEFT JOIN met USING (document_id, term) LEFT JOIN o USING (document_id)""",
)
def term_contexts(spark, sf_dir):
    """STR-28: the first long word of a document as its term."""
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.regexp_extract("text", "[A-Za-z]{8,}", 0).alias("term")).filter("term is not null")
    return elements.term_contexts(named, _focus(spark, sf_dir))


@query("point_ids", f"""WITH {LINES_SQL}, r AS (SELECT document_id, idx, sha1(unhex('{T.NAMESPACE_DNS.replace('-', '')}') || encode(document_id || ':' || idx)) AS a, sha1(unhex('{T.NAMESPACE_URL.replace('-', '')}') || encode('pdf:' || sha256(text))) AS b FROM lines)
SELECT document_id, idx, {', '.join(f"left({c}, 8) || '-' || substr({c}, 9, 4) || '-5' || substr({c}, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr({c}, 17, 1)) - 1) % 4 + 1, 1) || substr({c}, 18, 3) || '-' || substr({c}, 21, 12) AS {n}" for c, n in (('a', 'point_id'), ('b', 'document_uuid')))} FROM r""")
def point_ids(spark, sf_dir):
    """SNK-11, STR-32: ids of chunks and documents."""
    return lines(spark, sf_dir).select("document_id", "idx", T.uuid5(T.NAMESPACE_DNS, F.concat_ws(":", F.col("document_id").cast("string"), F.col("idx").cast("string"))).alias("point_id"), T.uuid5(T.NAMESPACE_URL, F.concat(F.lit("pdf:"), F.sha2("text", 256))).alias("document_uuid"))


@query("section_scopes", f"{R}{PARENTS_SQL}, steps AS (SELECT document_id, idx, ancestor AS step FROM up UNION ALL SELECT document_id, idx, idx FROM parents), s AS (SELECT document_id, min(idx) AS step FROM parents WHERE parent_idx IS NOT NULL GROUP BY ALL UNION SELECT document_id, min(idx) FROM parents GROUP BY ALL) SELECT DISTINCT document_id AS question, document_id, idx FROM steps JOIN s USING (document_id, step)")
def section_scopes(spark, sf_dir):
    """RET-07, ARR-09: each document's first section and first nested section as the scope of a question."""
    rows = sections(spark, sf_dir)
    tree = hierarchy.with_ancestors(rows).select("document_id", "idx", "parent_idx", F.concat("ancestors", F.array("idx")).alias("section_path_ids"))
    first = lambda df: df.groupBy("document_id").agg(F.min("idx").alias("section_id"))
    scopes = first(tree).unionAll(first(tree.filter("parent_idx is not null"))).distinct().withColumn("question", F.col("document_id"))
    return answering.in_scope(tree.select("document_id", "idx", "section_path_ids"), scopes, "question").select("question", "document_id", "idx")


@query("typed_hits", f"WITH {LINES_SQL} SELECT document_id, chunk_index, rank::INT AS rank FROM (SELECT document_id, idx AS chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS rank FROM lines WHERE idx % 3 = 1) WHERE rank <= 5")
def typed_hits(spark, sf_dir):
    """RET-08: each third line as a figure, a question for each document."""
    chunks = lines(spark, sf_dir).select("document_id", F.col("idx").alias("chunk_index"), F.when(F.col("idx") % 3 == 1, "figure").otherwise("text").alias("content_type"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("question")).distinct()
    return answering.of_type(chunks, asked, "question", "figure", 5).select("document_id", "chunk_index", "rank")


@query("chunk_payloads", f"{R}{PARENTS_SQL}, w AS (SELECT u.document_id, u.idx, list(s.title ORDER BY u.distance DESC) AS t FROM up u JOIN sections s ON s.document_id = u.document_id AND s.idx = u.ancestor GROUP BY ALL), p AS (SELECT s.document_id, s.idx, list_concat(coalesce(t, []), [s.title]) AS t FROM sections s LEFT JOIN w USING (document_id, idx)) SELECT document_id, idx, array_to_string(list_filter(t, lambda v, i: list_position(t, v) = i), ' > ') AS section_path FROM p")
def chunk_payloads(spark, sf_dir):
    """PRJ-01: the titles on the way to a section, without its own, as its chunk's path."""
    rows = sections(spark, sf_dir)
    above = hierarchy.paths(rows).withColumn("section_path", F.slice("path", 1, F.size("path") - 1)).select("document_id", "idx", F.when(F.size("section_path") > 0, F.col("section_path")).alias("section_path"))
    return chunking.payload(rows.select("document_id", "idx", F.col("title").alias("section_title")).join(above, ["document_id", "idx"])).select("document_id", "idx", F.array_join("section_path", " > ").alias("section_path"))


@query("listed_papers", "SELECT doc_id AS id, '/api/papers/' || doc_id || '/pdf' AS pdf_url, '/api/papers/' || doc_id || '/bundle' AS bundle_url, '/api/cms/papers/' || doc_id AS delete_url FROM documents")
def listed_papers(spark, sf_dir):
    """PRJ-05."""
    return answering.listed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("retried_errors", "SELECT event_id, event_id % 500 = 429 OR event_id % 4 IN (1, 2) AS retry FROM events")
def retried_errors(spark, sf_dir):
    """FIL-22: events as errors with a code and a message."""
    message = F.element_at(F.array(*[F.lit(x) for x in ("quota used up", "Rate limit reached", "RATE_LIMIT_EXCEEDED", "rates")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", answering.is_rate_limit(F.concat_ws(" ", (F.col("event_id") % 500).cast("string"), message)).alias("retry"))


@query(
    "nested_headings",
    f"""WITH {LINES_SQL}, l AS (SELECT document_id, idx, trim(left(text, 12), ' ') AS title FROM lines),
n AS (SELECT document_id, 'Part ' || (idx // 16 % 3) AS title, (min(idx) // 16) * 1000000000 AS place FROM l GROUP BY document_id, idx // 16
  UNION ALL SELECT document_id, 'Page ' || (idx // 4 % 5), (min(idx) // 16) * 1000000000 + (idx // 4) * 1000 + 1 FROM l GROUP BY document_id, idx // 16, idx // 4
  UNION ALL SELECT document_id, title, (idx // 16) * 1000000000 + (idx // 4) * 1000 + 2 + idx % 4 FROM l),
d AS (SELECT document_id, title, min(place) AS place FROM n WHERE title <> '' GROUP BY ALL)
SELECT document_id, count(*)::BIGINT AS n, md5(string_agg(title, '|' ORDER BY place)) AS digest FROM d GROUP BY ALL""",
)
def nested_headings(spark, sf_dir):
    """ARR-10, SET-07: parts of four pages of four lines."""
    own = lines(spark, sf_dir).select("document_id", F.floor(F.col("idx") / 16).alias("part"), F.floor(F.col("idx") / 4).alias("page"), F.struct("idx", F.substring("text", 1, 12).alias("title")).alias("s"))
    page = own.groupBy("document_id", "part", "page").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    page = page.select("document_id", "part", F.struct("page", F.concat(F.lit("Page "), (F.col("page") % 5).cast("string")).alias("title"), "sections").alias("s"))
    part = page.groupBy("document_id", "part").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    part = part.select("document_id", F.struct("part", F.concat(F.lit("Part "), (F.col("part") % 3).cast("string")).alias("title"), "sections").alias("s"))
    flat = elements.nested(part.groupBy("document_id").agg(F.array_sort(F.collect_list("s")).alias("sections")))
    return elements.distinct_headings(flat).select("document_id", F.size("headings").cast("long").alias("n"), F.md5(F.array_join("headings", "|")).alias("digest"))


WAYS = (", which is ", " defined as ", " (", " i.e., ", ", also known as ", " refers to ", ": ")
DEFINED_SQL = ", ".join(f"regexp_extract(text, '(?i)' || regexp_escape(term) || '{way}', 1)" for way in (r",?\s+which\s+is\s+([^.]+)\.", r",?\s+defined\s+as\s+([^.]+)\.", r"\s+\(([^)]+)\)", r",?\s+i\.e\.?,?\s+([^.]+)\.", r",?\s+also\s+known\s+as\s+([^.]+)\.", r",?\s+refers\s+to\s+([^.]+)\.", r":\s+([^.]+)\."))


@query(
    "inline_definitions",
    f"""WITH t AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]{{5,}}') AS term, text FROM documents),
m AS (SELECT doc_id, term, upper(term) || list_extract([{', '.join(f"'{w}'" for w in WAYS)}], (doc_id % 7 + 1)::INT) || text || '.)' AS text FROM t WHERE term <> '')
SELECT doc_id, term, list_filter(list_transform([{DEFINED_SQL}], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), lambda x: length(x) BETWEEN 11 AND 299)[1] AS definition FROM m""",
)
def inline_definitions(spark, sf_dir):
    """STR-27: the first word of five letters as a term, which the text is said to be."""
    way = F.element_at(F.array(*[F.lit(w) for w in WAYS]), (F.col("doc_id") % 7 + 1).cast("int"))
    made = table(spark, sf_dir, "documents").withColumn("term", F.regexp_extract("text", "[A-Za-z]{5,}", 0)).filter("term <> ''").withColumn("text", F.concat(F.upper("term"), way, F.col("text"), F.lit(".)")))
    return made.select("doc_id", "term", terms.inline_definition(F.col("text"), F.col("term")).alias("definition"))


@query(
    "relevance_maps",
    """SELECT doc_id, chunk, relevant FROM (
  SELECT doc_id, unnest([1, 2, 3, 4]) AS chunk, unnest([quality = 1, toxic <> 0, true, false]) AS relevant FROM labels)""",
)
def relevance_maps(spark, sf_dir):
    """STR-35: labels as a judge's answers: a boolean, a number, the word false, and null; the fifth isn't asked for."""
    told = F.format_string('Judged: {"1": %s, "2": %s, "3": "false", "4": null, "5": true} so far.', F.when(F.col("quality") == 1, "true").otherwise("false"), F.col("toxic").cast("string"))
    found = table(spark, sf_dir, "labels").select("doc_id", F.explode(T.relevance_map(told, F.lit(4))).alias("chunk", "relevant"))
    return found.select("doc_id", "chunk", "relevant")
