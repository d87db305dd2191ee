"""Relational store operators: lists, joins, upserts, deletes by reference count, state by latest event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_first(rows: DataFrame, at: str, key: str, limit: int | None = None) -> DataFrame:
    """TOP-05, PRJ-04: newest first, then the larger key; with a limit only the first rows are kept in each task."""
    ordered = rows.orderBy(F.col(at).desc(), F.col(key).desc())
    return ordered.limit(limit) if limit else ordered


def linked(entities: DataFrame, links: DataFrame, owners: DataFrame, entity: str, owner: str) -> DataFrame:
    """JON-01, JON-02: owners with their entities through a bridge table."""
    return owners.join(links, owner).join(entities, entity)


def by_name(children: DataFrame, parents: DataFrame, key: str, name: str, wanted: str) -> DataFrame:
    """JON-03, SRC-18: the rows of the parent of a name, whatever its case."""
    return children.join(parents.filter(F.lower(name) == wanted.lower()).select(key), key, "left_semi")


def first_of(by_key: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """JON-04: a value by key, or else the fallback's."""
    return by_key.select(key, F.col(value).alias("__a")).join(fallback.select(key, F.col(value).alias("__b")), key, "full").select(key, F.coalesce("__a", "__b").alias(value))


def keep_last(rows: DataFrame, key: list[str], position: str | Column) -> DataFrame:
    """SNK-05, SNK-07: upserts: the last row of each key by a position that tells its rows apart; an aggregate, so a key's rows are thinned before they move."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias("__row"))
    return last.select(*[F.col(c) if c in key else F.col(f"__row.{c}") for c in rows.columns])


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """SNK-03, SNK-05: the table with its rows replaced by changes of the same key, and new ones added."""
    return table.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def insert_new(table: DataFrame, rows: DataFrame, digest: str, name: str, position: str) -> DataFrame:
    """SNK-01, SNK-02, JON-17: of ``rows`` those to insert: neither their hash nor their name, whatever its case, is
    there already, and they are the first with it."""
    fresh = rows.join(table.select(digest).distinct(), digest, "left_anti").withColumn("__name", F.lower(name))
    fresh = fresh.join(table.select(F.lower(name).alias("__name")).distinct(), "__name", "left_anti")
    by_digest = Window.partitionBy(digest).orderBy(position)
    by_name_ = Window.partitionBy("__name").orderBy(position)
    return fresh.withColumn("__a", F.row_number().over(by_digest)).filter("__a = 1").withColumn("__b", F.row_number().over(by_name_)).filter("__b = 1").drop("__a", "__b", "__name")


def duplicates(rows: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """JON-18: the rows whose hash is known."""
    return rows.join(known.select(digest).distinct(), digest, "left_semi")


def unlink(links: DataFrame, removed: DataFrame, entity: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """SNK-10: the links left after ``removed`` (entity, owner), and the entities that are no one's any more."""
    left = links.join(removed.select(entity, owner).distinct(), [entity, owner], "left_anti")
    return left, removed.select(entity).distinct().join(left.select(entity).distinct(), entity, "left_anti")


def explode_links(stats: DataFrame, section: str, ids: str, known: DataFrame, element: str) -> DataFrame:
    """SNK-06: (section, element): the ids a section lists, once each, if the element is known."""
    found = stats.select(section, F.explode(ids).alias(element)).distinct()
    return found.join(known.select(element).distinct(), element, "left_semi").select(section, element)


def latest_state(events: DataFrame, key: str, at: str, state: str, tie: str) -> DataFrame:
    """SNK-09: the state of each key after its last event, and the number of events."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias(state), F.max(at).alias("last_at"), F.count("*").alias("n_events"))


def question_states(events: DataFrame, key: str, at: str, event: str, tie: str) -> DataFrame:
    """SNK-09, STM-03: (key, state, n_rejected) after all events of each key, in order of time and ``tie``; the rules
    are those of ``streaming.state.question_states``.

    complete and fail hold whatever the state, so they cut a key's events into parts that know nothing of each other:
    within a part the first claim takes the question and the others are rejected, unless it begins as completed.
    """
    own = events.filter(F.col(event).isin("claim", "complete", "fail"))
    ends = F.col(event) != "claim"
    before = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    marked = own.withColumn("part", F.coalesce(F.count_if(ends).over(before), F.lit(0))).withColumn("begun", F.last(F.when(ends, F.col(event)), ignorenulls=True).over(before))
    parts = marked.groupBy(key, "part").agg(F.first("begun").alias("begun"), F.count_if(~ends).alias("claims"), F.max(F.when(ends, F.col(event))).alias("end"))
    open_ = F.coalesce(F.col("begun") != "complete", F.lit(True))
    state = F.when(F.col("end") == "complete", "completed").when(F.col("end") == "fail", "failed").when(~open_, "completed").when(F.col("claims") > 0, "running").otherwise("pending")
    rejected = F.when(open_, F.greatest(F.col("claims") - 1, F.lit(0))).otherwise(0)
    return parts.groupBy(key).agg(F.max_by(state, "part").alias("state"), F.sum(rejected).alias("n_rejected"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-02: (table, n) of several tables."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def audit(points: DataFrame, sections: DataFrame, key: str, title: str) -> DataFrame:
    """JON-16, JON-20, AGG-12: for each key its points, those without a title, and those whose title no section has."""
    known = sections.select(key, title).distinct().withColumn("__known", F.lit(True))
    return points.join(known, [key, title], "left").groupBy(key).agg(F.count("*").alias("n_points"), F.count_if(F.col(title).isNull()).alias("n_untitled"), F.count_if(F.col(title).isNotNull() & F.col("__known").isNull()).alias("n_unknown"))


def title_lookup(rows: DataFrame, path: Column) -> DataFrame:
    """SNK-13, SRC-12: (norm, titles): every spelling of a title, by its lower-case form with single spaces."""
    titles = rows.select(F.explode(F.array_distinct(path)).alias("title")).filter("trim(title) <> ''")
    norm = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    return titles.groupBy(norm.alias("norm")).agg(F.array_sort(F.collect_set("title")).alias("titles"))


def first_titles(rows: DataFrame, key: str, title: str, rank: str) -> DataFrame:
    """AGG-28: the title with the best rank for each key."""
    return rows.groupBy(key).agg(F.min_by(title, F.struct(rank, title)).alias(title))


def last_messages(turns: DataFrame, conversation: str, turn: str, most: int = 10) -> DataFrame:
    """TOP-12: the last ``most`` turns of each conversation."""
    order = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    return turns.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def numbered_context(hits: DataFrame, question: str, rank: str, title: str, text: str, most: int | None = None) -> DataFrame:
    """PRJ-10, PRJ-11: (question, context, n): "[i] (Section: title)", line end, text, joined by blank lines; hits in
    reference sections and blank texts take no number."""
    from paperloom.functions.text import is_reference_heading

    kept = hits.filter(~is_reference_heading(F.col(title)) & (F.trim(text) != ""))
    order = Window.partitionBy(question).orderBy(rank)
    kept = kept.withColumn("__i", F.row_number().over(order))
    if most:
        kept = kept.filter(F.col("__i") <= most)
    line = F.concat(F.lit("["), F.col("__i").cast("string"), F.lit("] (Section: "), F.coalesce(title, F.lit("")), F.lit(")\n"), F.trim(text))
    return kept.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("context"), F.count("*").alias("n"))


def answers(pairs: DataFrame, payloads: DataFrame, given: DataFrame, question: str = "question") -> DataFrame:
    """JON-15: each distinct trimmed question, the first of each, with the first payload and answer for it."""

    def first(df: DataFrame, value: str) -> DataFrame:
        order = Window.partitionBy("q").orderBy("pos")
        return df.withColumn("q", F.trim(question)).filter("q <> ''").withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("q", F.col("pos"), F.col(value))

    a, b = first(payloads, "payload").drop("pos"), first(given, "answer").drop("pos")
    return first(pairs, question).drop(question).join(a, "q", "left").join(b, "q", "left").withColumnRenamed("q", question)


def prune_repeats(steps: DataFrame, document: str, order: list[str], title: str, revisit: str) -> DataFrame:
    """SET-11, FIL-23: a section stays where it is first read, or where the step says that it is read again."""
    first = Window.partitionBy(document, F.lower(F.trim(title))).orderBy(*order)
    again = F.lower(revisit).rlike("revisit|re-read|read again|return to|after reading|cross-check|compare|deepen|synthesize")
    return steps.withColumn("__n", F.row_number().over(first)).filter((F.col("__n") == 1) | F.coalesce(again, F.lit(False))).drop("__n")


def repeated(steps: DataFrame, by: list[str], title: str) -> DataFrame:
    """SET-10: titles that a group reads more than once."""
    return steps.groupBy(*by, F.lower(F.trim(title)).alias("norm")).agg(F.count("*").alias("n")).filter("n > 1")


def budget(hits: DataFrame, question: str, rank: str, most: int) -> DataFrame:
    """TOP-11, TOP-13: the first ``most`` of each question."""
    order = Window.partitionBy(question).orderBy(rank)
    return hits.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")
