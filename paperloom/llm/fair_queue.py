"""Mixing sources to target weights by weighted fair queueing.

Each document gets a place in its source's shuffled queue, repeated for up to ``max_epochs`` passes. Its virtual
finish time is the source's tokens up to and with it, divided by the source's target. The mix is the queue of all
sources in order of finish time, cut where its tokens reach the total budget.

Running totals are made in two levels: totals of (source, slice of the shuffle) and running sums inside a slice, so
that no task holds a whole source. Only two numbers about the cut come to the driver.

Cases: null text has size 0; a null source is a source of its own, after all others; null ids are queued like an
empty id; documents of size 0 are never taken; repeated rows are queued one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, words

SLICE_DIGITS = 3  # 4096 slices of each source's shuffle
TIME_BINS = 1024  # bins of finish time between 0 and 1


def source_targets(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_rank, source_size, target) of rows (source, size).

    Sources in code point order, null last, get ``weights`` in turn and share the total of all sizes. A target over
    ``max_epochs`` times its source's size stops there; the rest is shared again, which ends at one level of target
    per weight, found from running sums over the sources ordered by the level at which each is full.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("full_level", "source_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    sized = (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(ordered))
        .withColumn("weight", weight.cast("double"))
        .withColumn("most", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("full_level", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    level = (F.col("total") - F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    return (
        sized.withColumn("level", level)
        .withColumn("at", F.row_number().over(full))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_level"), F.struct("at", "level"))).over(everything)["level"])
        .select("source", "source_rank", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"), F.col("total").cast("long").alias("budget"))
    )


def queue(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", size: str | None = None) -> DataFrame:
    """Documents (doc_id, text, source) with their place in the source's first pass.

    Returns doc_id, source, size, source_rank, source_size, target, budget, and reached: the source's tokens up to
    and with this document. ``size`` names a column with the token count; without it the words of ``text`` count.
    """
    count = F.coalesce(F.col(size), F.lit(0)).cast("long") if size else words(F.col("text"))
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = checkpoint(docs.select("doc_id", "source", count.alias("size"), shuffle.alias("shuffle")))
    rows = rows.withColumn("slice", F.substring("shuffle", 1, SLICE_DIGITS))
    targets = source_targets(rows, weights, max_epochs)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    slices = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.slice", "s.before", "t.source_rank", "t.source_size", "t.target", "t.budget")
    inside = Window.partitionBy("source", "slice").orderBy("shuffle", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("inside", F.sum("size").over(inside))
    return (
        placed.alias("p")
        .join(slices.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.slice") == F.col("s.slice")))
        .select("p.doc_id", "p.source", "p.size", "s.source_rank", "s.source_size", "s.target", "s.budget", (F.col("s.before") + F.col("p.inside")).alias("reached"))
    )


def _finish(epoch):
    return F.when(F.col("target") > 0, (epoch * F.col("source_size") + F.col("reached")) / F.col("target"))


def _bin(finish):
    return F.least(F.floor(finish * TIME_BINS), F.lit(4 * TIME_BINS)).cast("long")


def cut(queued: DataFrame, max_epochs: int = 3) -> tuple[int, tuple | None] | None:
    """Where the mix of ``queued`` ends: the bin of finish time in which the budget is reached, and the last taken
    (finish, source_rank, epoch) in that bin, or None. None if everything fits.

    A histogram of finish times finds the bin; only rows of that bin are put in one order.
    """
    passes = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")).withColumn("finish", _finish(F.col("epoch"))).filter("finish is not null and size > 0").withColumn("bin", _bin(F.col("finish")))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = passes.groupBy("bin").agg(F.sum("size").alias("tokens"), F.max("budget").alias("budget")).withColumn("upto", F.sum("tokens").over(upto))
    at = bins.filter("upto > budget").orderBy("bin").limit(1).collect()
    if not at:
        return None
    edge, before = at[0]["bin"], at[0]["upto"] - at[0]["tokens"]
    order = Window.orderBy("finish", "source_rank", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    last = passes.filter(F.col("bin") == edge).withColumn("upto", F.sum("size").over(order) + F.lit(before)).filter("upto <= budget").agg(F.max(F.struct("finish", "source_rank", "epoch")).alias("last")).collect()[0]["last"]
    return edge, tuple(last) if last else None


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", size: str | None = None) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies (times it is in the mix), taken
    (its tokens in the mix). ``docs`` needs doc_id, text (or ``size``) and source; other columns are ignored."""
    queued = queue(docs, weights, max_epochs, seed, size)
    end = cut(queued, max_epochs)
    copies = F.lit(0)
    for epoch in range(max_epochs):
        finish = _finish(F.lit(epoch))
        if end is None:
            inside = finish.isNotNull()
        else:
            inside = _bin(finish) < end[0]
            if end[1]:
                last = F.struct(F.lit(end[1][0]).cast("double"), F.lit(end[1][1]).cast("int"), F.lit(end[1][2]).cast("int"))
                inside = inside | ((_bin(finish) == end[0]) & (F.struct(finish, F.col("source_rank").cast("int"), F.lit(epoch).cast("int")) <= last))
        copies = copies + F.when(inside & (F.col("size") > 0), 1).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sequence(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", size: str | None = None) -> DataFrame:
    """The mix itself, globally range-sorted: a row (doc_id, source, epoch, finish, size) for each taken pass."""
    queued = queue(docs, weights, max_epochs, seed, size)
    end = cut(queued, max_epochs)
    passes = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")).withColumn("finish", _finish(F.col("epoch"))).filter("finish is not null and size > 0")
    if end is not None:
        inside = _bin(F.col("finish")) < end[0]
        if end[1]:
            last = F.struct(F.lit(end[1][0]).cast("double"), F.lit(end[1][1]).cast("int"), F.lit(end[1][2]).cast("int"))
            inside = inside | ((_bin(F.col("finish")) == end[0]) & (F.struct("finish", F.col("source_rank").cast("int"), F.col("epoch").cast("int")) <= last))
        passes = passes.filter(inside)
    return passes.select("doc_id", "source", "epoch", "finish", "source_rank", "size").repartitionByRange("finish", "source_rank", "epoch").sortWithinPartitions("finish", "source_rank", "epoch").drop("source_rank")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document of ``documents``."""
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffle
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source
), w AS (
  SELECT *, (((source_rank - 1) % 3) + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most, (sum(source_size) OVER ())::DOUBLE AS total FROM s
), f AS (
  SELECT *, most / weight AS full_level FROM w
), l AS (
  SELECT *, row_number() OVER (ORDER BY full_level, source_rank) AS pos,
    (total - coalesce(sum(most) OVER (ORDER BY full_level, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_level, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM f
), t AS (
  SELECT source, source_rank, source_size, total, least(most, (SELECT arg_min(lev, pos) FROM l WHERE lev <= full_level) * weight) AS target FROM l
), q AS (
  SELECT d.doc_id, d.source, d.size, d.shuffle, t.source_rank, t.source_size, t.target, t.total, row_number() OVER () AS row_key,
    sum(d.size) OVER (PARTITION BY t.source_rank ORDER BY d.shuffle, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + reached)::DOUBLE / target AS finish
  FROM q, (VALUES (0), (1), (2)) e(epoch) WHERE target > 0 AND size > 0
), c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p
), k AS (
  SELECT row_key, sum(size)::BIGINT AS taken FROM c WHERE upto <= total GROUP BY row_key
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (row_key)
"""
