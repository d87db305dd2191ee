"""Secret scans with corpus-wide ownership frequency.

Three base patterns find secrets in each text. Beside them, long mixed runs of letters and digits are candidates.
The value of every span is hashed, and each hash is counted over the corpus by distinct owners and repositories:
first by (hash, owner, repository), then by hash, so that a value that a third of all rows hold is summed up before it
moves. A value in many owners' files is an example that people copy; one that a single owner holds, with the entropy
of a random string, looks live. Candidates that look live are spans of the kind ``owned``; base spans always stay.

The texts are read once; the spans are kept in a checkpoint, for the counts and for the result. All of it is
DataFrame expressions. Positions come from the lengths of the matches and of the text between them.

Cases: null text is empty and has no spans; null owners and repositories count as one owner or repository named
by the empty string; rows with equal ids are reported one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

_KEY = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
_KEY_STEMS = "(?i)(?:passw|secre|token|api)"  # of all keys; a faster test
#: Kinds in the order in which they are listed: pattern, the same for values that are long enough, group of the value,
#: its least length.
BASE = {
    "assign": (_KEY + r"([A-Za-z0-9+/_.=-]+)", _KEY + r"[A-Za-z0-9+/_.=-]{6,}", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]+", r"[0-9a-f]{24,}", 0, 24),
}
#: Runs with letters and digits that may be keys of any other make.
CANDIDATE = r"[A-Za-z0-9_-]{20,}"
KINDS = [*BASE, "owned"]


RAW = "array<struct<ord:int,i:int,gap:int,size:int,value:string>>"


def _matches(text: Column, kind: str, pattern: str, long_enough: str, group: int, least: int) -> Column:
    """The leftmost non-overlapping matches in order: characters before and in each, its value if that is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(parts, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("ord"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("size"), F.when(F.char_length(x["value"]) >= least, x["value"]).alias("value")))
    # A text without a hit, as most are, is only tested.
    worth = text.rlike(long_enough)
    if kind == "assign":
        worth = text.rlike(_KEY_STEMS) & worth
    return F.when(worth, found.cast(RAW)).otherwise(F.array().cast(RAW))


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(value, "")
    n = F.size(chars).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def found_spans(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """uid, doc_id, owner, repository, span: struct<start, ord, end, kind, value> of base spans and of candidates that
    overlap none of them; at least one row for each row of ``docs``, with a null span if it has none.

    Running sums over a document's matches give their places; a running maximum of the ends of base spans, in order
    of start, tells candidates that overlap one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.concat(*[_matches(text, kind, *how) for kind, how in BASE.items()], _matches(text, "owned", CANDIDATE, CANDIDATE, 0, 20))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        raw.alias("raw"),
    ).select("uid", "doc_id", "owner", "repository", F.explode_outer("raw").alias("x"))
    in_order = Window.partitionBy("uid", "x.ord").orderBy("x.i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("x.gap") + F.col("x.size")).over(in_order)).withColumn("start", F.col("end") - F.col("x.size"))
    owned = F.col("x.ord") == KINDS.index("owned")
    valid = F.col("x.value").isNotNull()
    base_end = F.when(valid & ~owned, F.col("end"))
    by_place = Window.partitionBy("uid").orderBy(F.when(owned, F.col("end") * 2 - 1).otherwise(F.col("start") * 2)).rangeBetween(Window.unboundedPreceding, 0)
    reached = placed.withColumn("reached", F.max(base_end).over(by_place))
    free = F.col("x.value").rlike("[0-9]") & F.col("x.value").rlike("[A-Za-z]") & (F.coalesce("reached", F.lit(-1)) <= F.col("start"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("x.ord") + 1)
    span = F.struct("start", F.col("x.ord").alias("ord"), "end", kind.alias("kind"), F.col("x.value").alias("value"))
    return reached.select("uid", "doc_id", "owner", "repository", F.when(valid & (~owned | free), span).alias("span"))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_spans, n_repositories, n_owners of every value in ``found_spans``."""
    values = found.filter("span is not null").select("owner", "repository", F.sha2("span.value", 256).alias("value_hash"))
    return values.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, example_owners: int = 3, least_entropy: float = 3.0) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, and what ``owner`` and ``repository`` name): doc_id and spans,
    array<struct<start, ord, end, kind, value, n_owners, n_repositories, status>> by start, then kind.

    status: ``example`` from ``example_owners`` owners on; ``live`` for one owner and ``least_entropy`` bits a
    character; else ``shared``. Candidates are kept, as ``owned``, if they look live.
    """
    found = checkpoint(found_spans(docs, F.col("source") if owner is None else owner, F.col("source") if repository is None else repository))
    counts = ownership(found)
    each = found.select("uid", "doc_id", F.col("span").alias("x")).withColumn("key", F.coalesce(F.sha2(F.col("x.value"), 256), F.concat(F.lit("none "), F.col("uid").cast("string"))))
    bits = F.when(F.col("n_owners") == 1, entropy(F.col("x.value")))
    status = F.when(F.col("n_owners") >= example_owners, "example").when(bits >= least_entropy, "live").otherwise("shared")
    known = each.join(counts, each["key"] == counts["value_hash"], "left").withColumn("status", status)
    span = F.struct(F.col("x.start").alias("start"), F.col("x.ord").alias("ord"), F.col("x.end").alias("end"), F.col("x.kind").alias("kind"), F.col("x.value").alias("value"), "n_owners", "n_repositories", "status")
    kept = F.col("x").isNotNull() & ((F.col("x.kind") != "owned") | (F.col("status") == "live"))
    return known.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.when(kept, span))).alias("spans")).drop("uid")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    of = lambda status: F.size(F.filter("spans", lambda x: x["status"] == status)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        of("live").alias("n_live"),
        of("example").alias("n_example"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document; the source owns it, and its languages stand for the source's repositories."""
    return digest(scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang")))


def _oracle() -> str:
    kinds = [(k, pattern, group, least) for k, (pattern, _, group, least) in BASE.items()] + [("owned", CANDIDATE, 0, 20)]
    quoted = lambda x: x.replace("'", "''")
    parts = [
        f"""SELECT u, {k} AS ord, '{kind}' AS kind, i, len(gaps[i]) AS gap, len(whole[i]) AS size, vals[i] AS value, {least} AS least FROM (
          SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
            SELECT u, regexp_split_to_array(text, '{quoted(pattern)}') AS gaps, regexp_extract_all(text, '{quoted(pattern)}', 0) AS whole, regexp_extract_all(text, '{quoted(pattern)}', {group}) AS vals FROM d))"""
        for k, (kind, pattern, group, least) in enumerate(kinds)
    ]
    return f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, (sum(gap + size) OVER (PARTITION BY u, ord ORDER BY i))::BIGINT AS stop FROM m),
s AS (SELECT u, ord, kind, (stop - size)::BIGINT AS start, stop, value FROM p WHERE len(value) >= least),
f AS (
  SELECT * FROM s WHERE kind <> 'owned'
  UNION ALL
  SELECT * FROM s WHERE kind = 'owned' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM s b WHERE b.u = s.u AND b.kind <> 'owned' AND b.start < s.stop AND s.start < b.stop)
),
o AS (SELECT value, count(DISTINCT owner) AS n_owners FROM f JOIN d USING (u) GROUP BY value),
e AS (
  SELECT value, -sum(c / n * log2(c / n)) AS bits FROM (
    SELECT value, ch, count(*)::DOUBLE AS c, any_value(len(value))::DOUBLE AS n FROM (SELECT value, unnest(string_split(value, '')) AS ch FROM o) GROUP BY value, ch) GROUP BY value
),
c AS (
  SELECT f.*, CASE WHEN n_owners >= 3 THEN 'example' WHEN n_owners = 1 AND bits >= 3.0 THEN 'live' ELSE 'shared' END AS status
  FROM f JOIN o USING (value) JOIN e USING (value)
),
g AS (
  SELECT u, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind <> 'owned') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
    count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'example') AS n_example
  FROM c WHERE kind <> 'owned' OR status = 'live' GROUP BY u
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN g USING (u)
"""


ORACLE = _oracle()
