"""Queries of the relational store over the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import answering, store

from .catalog import query
from .tables import table


@query("user_papers", "SELECT c_custkey, o_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'")
def user_papers(spark, sf_dir):
    """JON-01, JON-02: a three-way join through a bridge."""
    owners = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return store.linked(items, links, owners, "o_orderkey", "c_custkey")


@query("children_by_name", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) = lower('NATION_7')")
def children_by_name(spark, sf_dir):
    """JON-03, SRC-18, FIL-21."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return store.by_name(customers, nations, "k", "n_name", "NATION_7").select("c_custkey")


@query("latest_papers", "SELECT o_orderkey, epoch_us(o_orderdate) AS ordered_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_papers(spark, sf_dir):
    """TOP-05, PRJ-04: a top 50."""
    return store.latest_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ordered_at"))


@query("bundle", "SELECT o_orderkey, coalesce(l.status, o_orderstatus) AS status FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def bundle(spark, sf_dir):
    """JON-04: a value by key, else the fallback's."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"))
    return store.first_of(lines, table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey", "status")


NAMES = ("orders", "lineitem", "customer", "part", "supplier", "nation")


@query("row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*)::BIGINT AS n FROM {n}" for n in NAMES))
def row_counts(spark, sf_dir):
    """AGG-01..03."""
    return store.row_counts({n: table(spark, sf_dir, n) for n in NAMES})


@query("status_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, epoch_us(max(ts)) AS last_at, count(*)::BIGINT AS n_events FROM events GROUP BY user_id")
def status_latest(spark, sf_dir):
    """SNK-09: the last state of each user."""
    return store.latest_state(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id").withColumn("last_at", F.unix_micros(F.col("last_at").cast("timestamp")))


@query(
    "question_states",
    """WITH RECURSIVE e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END AS event
  FROM events
), run AS (
  SELECT user_id, 0 AS n, 'pending' AS state, 0 AS n_rejected FROM e GROUP BY user_id
  UNION ALL
  SELECT run.user_id, e.n, CASE WHEN event = 'complete' THEN 'completed' WHEN event = 'fail' THEN 'failed' WHEN state = 'completed' THEN state ELSE 'running' END,
    n_rejected + CASE WHEN event = 'claim' AND state = 'running' THEN 1 ELSE 0 END
  FROM run JOIN e ON e.user_id = run.user_id AND e.n = run.n + 1
)
SELECT user_id, state, n_rejected::BIGINT AS n_rejected FROM run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
)
def question_states(spark, sf_dir):
    """STM-03, SNK-09: each user's events as a question's: purchases complete it, errors fail it, all others claim it."""
    kind = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("claim")
    return store.question_states(table(spark, sf_dir, "events").withColumn("event", kind), "user_id", "ts", "event", "event_id")


@query("event_tally", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_tally(spark, sf_dir):
    """AGG-26, AGG-27, AGG-11."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("status_pivot", "SELECT user_id, (count(*) FILTER (event_type = 'view'))::BIGINT AS n_view, (count(*) FILTER (event_type = 'click'))::BIGINT AS n_click, (count(*) FILTER (event_type NOT IN ('view', 'click')))::BIGINT AS n_other FROM events GROUP BY user_id")
def status_pivot(spark, sf_dir):
    """AGG-24, AGG-26."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "view").alias("n_view"), F.count_if(kind == "click").alias("n_click"), F.count_if(~kind.isin("view", "click")).alias("n_other"))


INSERT_SQL = """WITH t AS (SELECT md5(text) AS digest, lang || doc_id % 500 AS name FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id, md5(text) AS digest, upper(lang) || doc_id % 700 AS name FROM documents WHERE doc_id % 2 = 1),
f AS (SELECT * FROM r WHERE digest NOT IN (SELECT digest FROM t) AND lower(name) NOT IN (SELECT lower(name) FROM t)), a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1)
SELECT doc_id, name FROM a QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id) = 1"""


@query("dedup_insert", INSERT_SQL)
def dedup_insert(spark, sf_dir):
    """SNK-01, SNK-02, JON-17, SRC-17: documents of odd ids inserted beside those of even ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    there = docs.filter("doc_id % 2 = 0").withColumn("name", F.concat("lang", (F.col("doc_id") % 500).cast("string")))
    new = docs.filter("doc_id % 2 = 1").withColumn("name", F.concat(F.upper("lang"), (F.col("doc_id") % 700).cast("string")))
    return store.insert_new(there, new, "digest", "name", "doc_id").select("doc_id", "name")


@query("known_hashes", "WITH d AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id FROM d WHERE n > 1")
def known_hashes(spark, sf_dir):
    """JON-18, FIL-21: the documents whose text an earlier one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "h").filter("doc_id <> first_id").select("doc_id")


@query("upsert", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT DISTINCT l_orderkey, 'R' FROM lineitem WHERE l_returnflag = 'R'")
def upsert(spark, sf_dir):
    """SNK-03, SNK-05..08: orders with a returned line get a new status."""
    changes = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("R").alias("o_orderstatus")).distinct()
    return store.upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), changes, ["o_orderkey"])


@query("keep_last", "SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1")
def keep_last(spark, sf_dir):
    """SNK-05, SNK-07."""
    return store.keep_last(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("l_linenumber")), ["l_orderkey"], F.struct("l_linenumber", "l_partkey"))


@query("refcount_delete", """WITH links AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem), gone AS (SELECT * FROM links WHERE supp % 10 <> 0), kept AS (SELECT * FROM links WHERE supp % 10 = 0)
SELECT DISTINCT part FROM gone WHERE part NOT IN (SELECT part FROM kept)""")
def refcount_delete(spark, sf_dir):
    """SNK-10: parts that no supplier of a key divisible by ten has, when those are unlinked."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).distinct()
    return store.unlink(links, links.filter("supp % 10 <> 0"), "part", "supp")[1]


@query("section_links", "WITH s AS (SELECT l_orderkey AS section, unnest(list(l_partkey)) AS element FROM lineitem GROUP BY l_orderkey) SELECT DISTINCT section, element FROM s JOIN part ON p_partkey = element WHERE p_size > 10")
def section_links(spark, sf_dir):
    """SNK-06."""
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("section")).agg(F.collect_list("l_partkey").alias("ids"))
    known = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("element"))
    return store.explode_links(stats, "section", "ids", known, "element")


@query("element_order", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 1000000000 ELSE l_linenumber END, l_shipdate, l_linenumber))::INT AS pos FROM lineitem")
def element_order(spark, sf_dir):
    """TOP-01, TOP-06, TOP-07: reading order with missing places last."""
    from pyspark.sql import Window

    place = F.coalesce(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")), F.lit(1000000000))
    order = Window.partitionBy("l_orderkey").orderBy(place, "l_shipdate", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.row_number().over(order).alias("pos"))


@query("first_titles", "SELECT l_partkey, arg_min(l_returnflag, (l_shipdate, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY l_partkey")
def first_titles(spark, sf_dir):
    """AGG-28."""
    return store.first_titles(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "l_shipdate")


@query("chat_window", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def chat_window(spark, sf_dir):
    """TOP-12."""
    return store.last_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("questions_capped", "SELECT conv_id, turn FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def questions_capped(spark, sf_dir):
    """TOP-11, TOP-13."""
    return store.budget(table(spark, sf_dir, "conversations").filter("role = 'user'"), "conv_id", "turn", 3).select("conv_id", "turn")


ANSWERS_SQL = """WITH q AS (SELECT trim(text, ' ') AS q, min(conv_id * 1000 + turn) AS pos FROM conversations WHERE role = 'user' AND trim(text, ' ') <> '' GROUP BY 1),
p AS (SELECT trim(text, ' ') AS q, arg_min(conv_id::VARCHAR, conv_id * 1000 + turn) AS payload FROM conversations WHERE role = 'user' AND turn = 0 GROUP BY 1),
a AS (SELECT trim(u.text, ' ') AS q, arg_min(md5(r.text), u.conv_id * 1000 + u.turn) AS answer FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 WHERE u.role = 'user' GROUP BY 1)
SELECT md5(q) AS question, pos, payload, answer FROM q LEFT JOIN p USING (q) LEFT JOIN a USING (q)"""


@query("question_answers", ANSWERS_SQL)
def question_answers(spark, sf_dir):
    """JON-15."""
    turns = table(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))
    asked = turns.filter("role = 'user'").select(F.col("text").alias("question"), "pos", "conv_id", "turn")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("text").alias("answer"))
    payloads = asked.filter("turn = 0").select("question", "pos", F.col("conv_id").cast("string").alias("payload"))
    return store.answers(asked.select("question", "pos"), payloads, asked.join(replies, ["conv_id", "turn"]).select("question", "pos", "answer")).withColumn("question", F.md5("question"))


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_fields(spark, sf_dir):
    """STR-33, STR-34."""
    v = F.try_parse_json(T.json_object(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.none", "string").alias("none"))


@query("sections_by_range", "SELECT c_nationkey, p_brand, count(*)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY ALL")
def sections_by_range(spark, sf_dir):
    """JON-02, JON-05, AGG-07: equality joins with a range beside."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    li, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    met = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")))
    return met.join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("c_nationkey", "p_brand").agg(F.count("*").alias("n"))


@query("class_aliases", "SELECT event_id, CASE upper(trim(event_type)) WHEN 'VIEW' THEN 'REVIEW' ELSE NULL END AS class, CASE WHEN value >= 75 THEN 'HIGH' WHEN value >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, least(greatest(value / 100, 0.0), 1.0) AS score FROM events")
def class_aliases(spark, sf_dir):
    """STR-34, STR-36, STR-37, STR-42."""
    kind = F.when(F.upper(F.trim("event_type")) == "VIEW", "REVIEW")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("class"), T.confidence(F.col("value") / 100).alias("confidence"), T.unit_score(F.col("value") / 100).alias("score"))


@query("extractive_answers", r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant' AND trim(text, ' ') <> ''),
s AS (SELECT *, CASE WHEN length(t) <= 320 THEN t ELSE coalesce(nullif(regexp_extract(substring(t, 1, 320), '(?s)^(.*)\s', 1), ''), substring(t, 1, 320)) END AS s FROM t WHERE n <= 2)
SELECT conv_id, string_agg(s, chr(10) || chr(10) ORDER BY n) AS answer FROM s GROUP BY conv_id""")
def extractive_answers(spark, sf_dir):
    """PRJ-12."""
    return answering.extractive_answer(table(spark, sf_dir, "conversations").filter("role = 'assistant'"), "conv_id", "turn", "text")


@query("context_precision", "SELECT user_id, CASE WHEN bool_or(event_type <> 'error' AND value IS NOT NULL) THEN (count(*) FILTER (event_type <> 'error' AND value > 50))::DOUBLE / count(*) END AS context_precision FROM events GROUP BY user_id")
def context_precision(spark, sf_dir):
    """RET-19, AGG-16: events over 50 as relevant chunks, errors as unknown ones."""
    judged = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value") > 50).alias("relevant"))
    return answering.context_precision(judged, "user_id", "relevant")


@query("definitions", "WITH b AS (SELECT lower(p_brand) AS t, min(p_name) AS d FROM part WHERE p_size > 45 GROUP BY 1), c AS (SELECT lower(p_brand) AS t, min(p_type) AS d FROM part GROUP BY 1) SELECT p_partkey, coalesce(b.d, c.d) AS definition, CASE WHEN b.d IS NOT NULL THEN 'first' WHEN c.d IS NOT NULL THEN 'second' END AS source FROM part LEFT JOIN b ON b.t = lower(p_brand) LEFT JOIN c ON c.t = lower(p_brand)")
def definitions(spark, sf_dir):
    """RET-20: a cascade of two tables."""
    part = table(spark, sf_dir, "part")
    tables = [("first", part.filter("p_size > 45").select(F.col("p_brand").alias("term"), F.col("p_name").alias("definition"))), ("second", part.select(F.col("p_brand").alias("term"), F.col("p_type").alias("definition")))]
    return answering.definitions(part.select("p_partkey", "p_brand"), "p_brand", tables).select("p_partkey", "definition", "source")


@query("enriched_hits", "SELECT event_id, e.user_id, coalesce(c.c_name, e.event_type) AS name, c_nationkey FROM events e LEFT JOIN customer c ON c_custkey = user_id")
def enriched_hits(spark, sf_dir):
    """JON-13, PRJ-02: the payload's name wins over the hit's."""
    hits = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("name"))
    return answering.enriched(hits, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "c_nationkey"), "user_id")


@query("pinned_hits", "WITH p AS (SELECT DISTINCT c_custkey AS user_id, 'click' AS event_type FROM customer), h AS (SELECT user_id, event_id, event_type FROM events WHERE event_type = 'click') SELECT p.user_id, h.event_id, h.event_id IS NOT NULL AS found FROM p LEFT JOIN h USING (user_id)")
def pinned_hits(spark, sf_dir):
    """FIL-14: customers pin the clicks; those without any keep a row."""
    pins = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type"))
    return answering.pinned(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), pins, "user_id", "event_type").select("user_id", "event_id", "found")


@query("guide_states", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing' WHEN event_id % 8 = 1 THEN 'failed' WHEN event_id % 4 = 1 THEN 'pending' WHEN event_id % 4 = 2 THEN 'ready' ELSE 'pending' END AS state FROM events")
def guide_states(spark, sf_dir):
    """PRJ-15."""
    n = F.col("event_id") % 4
    status = F.when(F.col("event_id") % 8 == 1, " Failed").when(n == 1, F.col("event_type"))
    payload = F.when(n == 2, F.col("props")).when(n == 3, "{}").when(n == 1, "{}")
    return table(spark, sf_dir, "events").select("event_id", answering.guide_status(status, payload).alias("state"))
