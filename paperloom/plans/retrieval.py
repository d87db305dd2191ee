"""Queries of retrieval, fusion and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import answering, bm25, cells, fusion, metrics, vectors

from paperloom.sources import postings
from paperloom.sources.shared import checkpoint, shared_folder
from paperloom.sources.writers import delete

from .catalog import query
from .tables import table, tokens_sql

INDEX_SQL = f"""
words AS (SELECT doc_id, unnest(w) AS term, len(w) AS length FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)),
tf AS (SELECT doc_id, term, length, count(*) AS tf FROM words GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(len({tokens_sql('text')})) AS avgdl FROM documents),
idf AS (SELECT term, ln((n_docs - df + 0.5) / (df + 0.5) + 1) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
ix AS (SELECT doc_id, term, idf, idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / avgdl))) AS weight FROM tf JOIN idf USING (term)),
asked AS (SELECT item_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark)"""


def _ranked(gain: str, k: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT item_id, doc_id, round(sum({gain}), 6) AS score FROM asked JOIN ix USING (term) GROUP BY item_id, doc_id)) WHERE rank <= {k})"""


def _searches(spark: SparkSession, sf_dir: str, k: int) -> list[DataFrame]:
    """Two ranked lists from one pass: by weight, and by weight times idf."""
    return bm25.search_texts(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", k, (False, True))


def _search(spark: SparkSession, sf_dir: str, k: int, squared: bool = False) -> DataFrame:
    return bm25.search_texts(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", k, (squared,))[0]


@query("bm25_topk", f"WITH {INDEX_SQL} SELECT item_id, doc_id, score, rank::INT AS rank FROM {_ranked('weight', 5)}")
def bm25_topk(spark, sf_dir):
    """STR-01, AGG-04, AGG-05, RET-01, RET-02, TOP-02: the five best documents for each benchmark item."""
    return _search(spark, sf_dir, 5)


@query("indexed_topk", f"WITH {INDEX_SQL} SELECT item_id, doc_id, score, rank::INT AS rank FROM {_ranked('weight', 5)}")
def indexed_topk(spark, sf_dir):
    """SNK-12, RET-01, RET-02, RET-06, TOP-02: the same best five, from a stored index of two merged batches."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    for part in (0, 1):
        postings.add(docs.filter(F.pmod("doc_id", F.lit(2)) == part), path, "doc_id")
    postings.merge(spark, path)
    postings.vacuum(spark, path)
    found = checkpoint(postings.search(spark, path, table(spark, sf_dir, "benchmark"), "item_id", "doc_id", 5))
    delete(spark, path)
    return found


@query("bm25_squared_idf", f"WITH {INDEX_SQL} SELECT item_id, doc_id, score, rank::INT AS rank FROM {_ranked('weight * idf', 5)}")
def bm25_squared_idf(spark, sf_dir):
    """RET-02 as a dot product of two vectors that both hold the idf."""
    return _search(spark, sf_dir, 5, True)


@query("bm25_statistics", f"WITH {INDEX_SQL} SELECT term, round(idf, 6) AS idf, count(*)::BIGINT AS df FROM ix GROUP BY term, idf")
def bm25_statistics(spark, sf_dir):
    """AGG-04, SRC-15, SNK-14: the vocabulary with its idf."""
    return bm25.index(table(spark, sf_dir, "documents"), "doc_id").groupBy("term", F.round("idf", 6).alias("idf")).agg(F.count("*").alias("df"))


@query(
    "bm25_section_terms",
    f"""WITH w AS (SELECT source, unnest({tokens_sql('text')}) AS term FROM documents), c AS (SELECT source, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT source, sum(tf) AS length FROM c GROUP BY source), n AS (SELECT count(*) AS n_docs, avg(length) AS avgdl FROM l),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT source, term, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM (
  SELECT source, term, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / avgdl))), 6) AS score
  FROM c JOIN d USING (term) JOIN l USING (source), n WHERE length(term) >= 3 AND NOT regexp_matches(term, '^[0-9]+$'))) WHERE rank <= 12""",
)
def bm25_section_terms(spark, sf_dir):
    """WIN-15: the most telling terms of each source."""
    return bm25.group_terms(table(spark, sf_dir, "documents").select("source", "text"), "source")


COSINE_SQL = """(SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) QUALIFY rank <= {k})"""


def _cosine(spark, sf_dir, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.cosine_topk(rows, rows.filter("vec_id % 100 = 0"), k)


@query("cosine_topk", f"SELECT query_id, vec_id, score, rank::INT AS rank FROM {COSINE_SQL.format(k=10)}")
def cosine_topk(spark, sf_dir):
    """RET-03, RET-04: the ten nearest vectors to every hundredth."""
    return _cosine(spark, sf_dir, 10)


@query("cosine_cells")
def cosine_cells(spark, sf_dir):
    """RET-04, approximate: the ten nearest to every hundredth vector, from a stored index of cells; held to recall."""
    every, path = table(spark, sf_dir, "embeddings"), f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.build(every, path)
    found = checkpoint(cells.search(spark, path, every.filter("vec_id % 100 = 0"), 10))
    delete(spark, path)
    return found


@query(
    "rrf_fusion",
    f"""WITH {INDEX_SQL}, a AS {_ranked('weight', 20)}, b AS {_ranked('weight * idf', 20)}
SELECT item_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT item_id, doc_id, rank FROM b) GROUP BY item_id, doc_id)) WHERE rank <= 10""",
)
def rrf_fusion(spark, sf_dir):
    """WIN-01, RET-05: two ranked lists fused by reciprocal ranks."""
    return fusion.reciprocal_rank_fusion(_searches(spark, sf_dir, 20), "item_id", "doc_id", 10)


@query(
    "adaptive_threshold",
    f"""WITH c AS {COSINE_SQL.format(k=10)}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM c),
h AS (SELECT *, CASE WHEN best < 0.30 THEN best * 0.8 ELSE 0.35 END AS threshold FROM t), p AS (SELECT *, count(*) FILTER (score >= threshold) OVER (PARTITION BY query_id) AS passed FROM h)
SELECT query_id, vec_id, score, rank::INT AS rank, threshold FROM p WHERE CASE WHEN passed >= 2 THEN score >= threshold ELSE rank <= 2 END""",
)
def adaptive_threshold(spark, sf_dir):
    """FIL-10, FIL-11."""
    return fusion.above_threshold(_cosine(spark, sf_dir, 10), "query_id", "score", "rank")


@query(
    "unlabeled_minority",
    f"""WITH c AS (SELECT c.*, CASE WHEN label % 3 = 0 THEN 'Unlabeled Section' ELSE 'Section ' || label END AS title FROM {COSINE_SQL.format(k=10)} c JOIN embeddings USING (vec_id)),
m AS (SELECT *, count(*) FILTER (title = 'Unlabeled Section') OVER (PARTITION BY query_id) AS n, count(*) OVER (PARTITION BY query_id) AS a FROM c)
SELECT query_id, vec_id, score, rank::INT AS rank, title FROM m WHERE title <> 'Unlabeled Section' OR n * 2 > a""",
)
def unlabeled_minority(spark, sf_dir):
    """FIL-12."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, "Unlabeled Section").otherwise(F.concat(F.lit("Section "), F.col("label").cast("string"))).alias("title"))
    return fusion.without_unlabeled(_cosine(spark, sf_dir, 10).join(labels, "vec_id"), "query_id", "title").select("query_id", "vec_id", "score", "rank", "title")


@query(
    "merged_best_per_key",
    f"""WITH {INDEX_SQL}, a AS {_ranked('weight', 10)}, b AS {_ranked('weight * idf', 10)}, u AS (SELECT 0 AS stage, * FROM a UNION ALL SELECT 1 AS stage, * FROM b)
SELECT item_id, doc_id, score, rank::INT AS rank, stage FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, stage) AS n FROM u) WHERE n = 1""",
)
def merged_best_per_key(spark, sf_dir):
    """WIN-14, SET-01: two lists in one; a document's higher score stays."""
    a, b = (found.withColumn("stage", F.lit(stage)) for stage, found in enumerate(_searches(spark, sf_dir, 10)))
    return fusion.best_per_key(a.unionByName(b), ["item_id", "doc_id"], "score", "stage")


@query("near_duplicate_chunks")
def near_duplicate_chunks(spark, sf_dir):
    """RET-11: each item's best ten documents without near-identical ones; the fold has no SQL."""
    hits = _search(spark, sf_dir, 10).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return fusion.thin_near_duplicates(hits, "item_id", "doc_id", "text", "rank").withColumn("rank", F.col("rank").cast("long"))


@query(
    "rerank_changes",
    f"""WITH {INDEX_SQL}, a AS {_ranked('weight', 15)}, r AS (SELECT item_id, doc_id, rank AS rank_before, score AS score_before, round(score / sqrt(length(text)), 6) AS score_after FROM a JOIN documents USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score_after DESC, rank_before) AS rank_after FROM r)
SELECT item_id, doc_id, rank_after::INT AS rank_after, score_after, rank_before::INT AS rank_before, score_before, round(score_after - score_before, 6) AS score_change FROM n WHERE rank_after <= 5""",
)
def rerank_changes(spark, sf_dir):
    """TOP-03, TOP-04, WIN-02: a stand-in for a cross-encoder, which there is none of here: the score over the root of the length."""
    before = _search(spark, sf_dir, 15)
    with_text = before.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    after = fusion.rerank(with_text, "item_id", F.round(F.col("score") / F.sqrt(F.length("text")), 6), 5)
    return fusion.rank_changes(before, after, "item_id", "doc_id")


METRICS_SQL = f"""WITH c AS {COSINE_SQL.format(k=10)},
rel AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
tot AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id),
j AS (SELECT query_id, c.vec_id, rank, rel.vec_id IS NOT NULL AS hit, coalesce(n_relevant, 0) AS n_relevant FROM c LEFT JOIN rel USING (query_id, vec_id) FULL JOIN tot USING (query_id)),
m AS (SELECT query_id,
  round(count(DISTINCT vec_id) FILTER (hit AND rank <= 2) / 2.0::DOUBLE, 6) AS precision_at_2, round(count(DISTINCT vec_id) FILTER (hit AND rank <= 5) / 5.0::DOUBLE, 6) AS precision_at_5,
  round(coalesce(count(DISTINCT vec_id) FILTER (hit AND rank <= 3)::DOUBLE / nullif(max(n_relevant), 0), 0), 6) AS recall_at_3, round(coalesce(count(DISTINCT vec_id) FILTER (hit AND rank <= 5)::DOUBLE / nullif(max(n_relevant), 0), 0), 6) AS recall_at_5,
  round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit AND rank <= 5), 0), 6) AS reciprocal_rank,
  round(CASE WHEN max(n_relevant) > 0 THEN coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) / list_sum(list_transform(range(1, least(max(n_relevant), 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_at_10
  FROM j GROUP BY query_id)"""


def _measured(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(rows.select("vec_id", "label"), "label").filter("vec_id <> query_id")
    return metrics.per_question(_cosine(spark, sf_dir, 10), relevant, "query_id", "vec_id")


@query("ranking_metrics", METRICS_SQL + " SELECT * FROM m")
def ranking_metrics(spark, sf_dir):
    """WIN-03..06, SET-04: precision, recall, reciprocal rank and nDCG of the nearest vectors; those of the same label are relevant."""
    return _measured(spark, sf_dir)


MEASURES = ("precision_at_2", "precision_at_5", "recall_at_3", "recall_at_5", "reciprocal_rank", "ndcg_at_10")
MEANS_SQL = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEASURES)


@query("ranking_means", METRICS_SQL + f" SELECT count(*)::BIGINT AS n, {MEANS_SQL} FROM m")
def ranking_means(spark, sf_dir):
    """AGG-06, AGG-15."""
    return metrics.means(_measured(spark, sf_dir))


@query("ranking_means_by_label", METRICS_SQL + f" SELECT label::BIGINT AS label, count(*)::BIGINT AS n, {MEANS_SQL} FROM m JOIN embeddings ON vec_id = query_id GROUP BY label")
def ranking_means_by_label(spark, sf_dir):
    """AGG-07, AGG-14."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("label"))
    return metrics.means(_measured(spark, sf_dir).join(labels, "query_id"), ["label"])


STATES_SQL = """, s AS (SELECT m.*, label::BIGINT AS label, CASE WHEN reciprocal_rank > 0 THEN 'ok' WHEN ndcg_at_10 > 0 THEN 'rerank' ELSE 'recall' END AS state FROM m JOIN embeddings ON vec_id = query_id)"""


@query(
    "slice_failures",
    METRICS_SQL + STATES_SQL + """, f AS (SELECT label, state, count(*) AS c FROM s WHERE state <> 'ok' GROUP BY ALL), g AS (SELECT label, state FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, state) = 1)
SELECT s.label, count(*)::BIGINT AS n, round(avg((s.state = 'ok')::INT), 6) AS ok_rate, round(avg(recall_at_3), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mrr, any_value(g.state) AS top_failure FROM s LEFT JOIN g USING (label) GROUP BY s.label""",
)
def slice_failures(spark, sf_dir):
    """AGG-10, AGG-11, WIN-19."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("label"))
    state = metrics.failure(F.col("ndcg_at_10") > 0, F.col("ndcg_at_10") > 0, F.col("reciprocal_rank") > 0)
    return metrics.slices(_measured(spark, sf_dir).join(labels, "query_id").withColumn("state", state), "label")


@query(
    "ablation_means",
    f"""WITH {INDEX_SQL}, a AS {_ranked('weight', 10)}, b AS {_ranked('weight * idf', 10)}, r AS (SELECT 'bm25' AS config, item_id, doc_id, rank FROM a UNION ALL SELECT 'squared_idf', item_id, doc_id, rank FROM b),
h AS (SELECT config, item_id, min(rank) FILTER (contains(d.text, string_split(q.text, chr(10))[1])) AS first FROM r JOIN documents d USING (doc_id) JOIN benchmark q USING (item_id) GROUP BY config, item_id),
m AS (SELECT config, count(*)::BIGINT AS n, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM h GROUP BY config)
SELECT config, n, hit_rate, mrr, round(mrr - (SELECT mrr FROM m WHERE config = 'bm25'), 6) AS mrr_change FROM m""",
)
def ablation_means(spark, sf_dir):
    """AGG-08, AGG-09, RET-13: two configurations side by side; a document that holds the item's first line is relevant."""
    plain, squared = _searches(spark, sf_dir, 10)
    runs = plain.withColumn("config", F.lit("bm25")).unionByName(squared.withColumn("config", F.lit("squared_idf")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "\n")[0].alias("line"))
    first = runs.join(docs, "doc_id").join(items, "item_id").groupBy("config", "item_id").agg(F.min(F.when(F.contains("body", "line"), F.col("rank"))).alias("first"))
    out = first.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
    base = out.filter("config = 'bm25'").select(F.col("mrr").alias("base"))
    return out.crossJoin(F.broadcast(base)).select("config", "n", "hit_rate", "mrr", F.round(F.col("mrr") - F.col("base"), 6).alias("mrr_change"))


@query(
    "question_lengths",
    rf"""SELECT bin, count(*)::BIGINT AS n, count(*) FILTER (level = 'fine')::BIGINT AS n_fine FROM (SELECT CASE WHEN w <= 8 THEN '<=8' WHEN w <= 16 THEN '9-16' ELSE '17+' END AS bin,
CASE WHEN regexp_matches(lower(trim(text)), '^(what is|define|how many|when|who|which)') THEN 'fine' ELSE 'coarse' END AS level FROM (SELECT text, len({tokens_sql('text')}) AS w FROM conversations WHERE role = 'user')) GROUP BY bin""",
)
def question_lengths(spark, sf_dir):
    """WIN-20, STR-38."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select(metrics.length_bin(F.size(T.tokens(F.col("text")))).alias("bin"), T.chunk_level(F.col("text")).alias("level"))
    return asked.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "fine").alias("n_fine"))


@query("selected_contexts")
def selected_contexts(spark, sf_dir):
    """RET-10, RET-12: each item's best six documents as an answer's context; near-identical ones are folded, so no SQL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("Section "), F.col("source")).alias("title"))
    return answering.select_context(_search(spark, sf_dir, 15).join(docs, "doc_id"), "item_id", "doc_id", "text", "title", 6).select("item_id", "doc_id", "score", "rank")


@query(
    "stage_metrics",
    f"""WITH c AS {COSINE_SQL.format(k=10)}, s AS (SELECT 'retrieved' AS stage, * FROM c UNION ALL SELECT 'filtered', * FROM c WHERE score >= 0.2),
rel AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
tot AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id), a AS (SELECT query_id, stage, n_relevant, k FROM tot, (SELECT DISTINCT stage FROM s), (SELECT unnest([1, 3, 5, 10]) AS k)),
m AS (SELECT a.stage, a.k, a.query_id, count(DISTINCT s.vec_id) FILTER (rel.vec_id IS NOT NULL AND rank <= k)::DOUBLE / max(n_relevant) AS recall,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rel.vec_id IS NOT NULL AND rank <= k), 0) / max(list_sum(list_transform(range(1, least(n_relevant, k)::BIGINT + 1), lambda i: 1 / log2(i + 1)))) AS ndcg,
  coalesce(1.0::DOUBLE / min(rank) FILTER (rel.vec_id IS NOT NULL AND rank <= 10), 0) AS rr
  FROM a LEFT JOIN s USING (query_id, stage) LEFT JOIN rel ON rel.query_id = a.query_id AND rel.vec_id = s.vec_id GROUP BY ALL)
SELECT stage, k, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr FROM m GROUP BY stage, k""",
)
def stage_metrics(spark, sf_dir):
    """AGG-09: retrieved hits, and those over a score."""
    rows = table(spark, sf_dir, "embeddings")
    hits = _cosine(spark, sf_dir, 10)
    runs = hits.withColumn("stage", F.lit("retrieved")).unionByName(hits.filter("score >= 0.2").withColumn("stage", F.lit("filtered")))
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(rows.select("vec_id", "label"), "label").filter("vec_id <> query_id")
    return metrics.stages(runs, relevant, "query_id", "vec_id", "stage")
