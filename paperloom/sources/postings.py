"""A stored inverted index for BM25: Parquet tables that a search reads only in part.

A batch of documents falls into blocks of about ``BLOCK`` by a hash of their keys. A row of ``lists`` is a term in a
block: its documents with their counts, and in front the number of documents, the greatest count and the least length.
A document is named by its place among those of its block, which the row of the empty term lists once, with key and
length. From the latter two no document of the block can weigh more than ``saturated(max_tf, min_length)``,
whatever the corpus' statistics have become since. The empty term stands in every document. Rows lie in folders by a hash of
their term, sorted by it, so a search reads the folders of its terms, and in them little but its terms.

Search is exact. What the blocks can give at most is added up for each query from the fronts alone; the best blocks are
scored in full, the k-th score there is a threshold, and only blocks that can reach it are opened. Lists are dealt by
block, weights added up there, and of each block only what can be among a query's best goes on.

Each call of ``add`` writes a batch, and a row of ``commits`` makes it count; ``merge`` writes one batch for all there
are and commits it in their place. A call that failed leaves nothing that counts. Removed documents are noted and left
out when lists are read, until the next merge, which leaves their places empty. Texts are dealt by block, and a block's lists made at once; a merge deals
stored lists by folder, a part of the folders at a time, so little beside the index is on disk. A document is known by its key: one that the index has is not added
again; null keys never are. Repeated keys in one call are separate documents of that key, whose scores add up.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from paperloom.functions.text import tokens
from paperloom.operators import bm25
from paperloom.sources.shared import shuffles_dropped
from paperloom.sources.writers import delete, exists

BUCKETS, BLOCK = 64, 128
#: A merge takes so many turns, each for some of the folders, and writes a file of a folder for so many blocks.
TURNS, SPAN = 8, 512
#: Blocks of a query that are scored in full for its threshold.
SEEDS = 4
#: Scores are rounded to six places.
MARGIN = 1e-6
#: A block's scores are added up for so many queries at a time.
STEP = 256


def _bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _batch() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def live(spark: SparkSession, path: str) -> list[str]:
    """The batches that count; a name for each call of ``add`` since the last ``merge``."""
    if not exists(spark, f"{path}/commits"):
        return []
    rows = spark.read.parquet(f"{path}/commits").collect()
    gone = {b for r in rows for b in r.replaces}
    return sorted(r.batch for r in rows if r.batch not in gone)


def _commit(spark: SparkSession, path: str, batch: str, replaces: list[str]) -> None:
    spark.createDataFrame([(batch, replaces)], "batch string, replaces array<string>").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def lists(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """(batch, bucket, term, block, n, max_tf, min_length, words, at, tf, docs) of what counts; None if nothing does.
    ``at`` are places in the ``docs`` (key, length) of the block's empty term; other terms have none."""
    batches = live(spark, path)
    if not batches:
        return None
    every = spark.read.option("basePath", f"{path}/lists").parquet(*[f"{path}/lists/batch={b}" for b in batches])
    read = every.filter(F.col("bucket").isin(buckets)) if buckets is not None else every
    if not exists(spark, f"{path}/removed"):
        return read
    removed = spark.read.parquet(f"{path}/removed").groupBy("key").agg(F.max("batch").alias("until"))
    heads = every.filter((F.col("bucket") == _bucket(F.lit(""))) & (F.col("term") == ""))
    gone = heads.select("batch", "block", F.posexplode("docs").alias("place", "x")).withColumn("key", F.col("x.key")).join(removed, "key").filter("batch <= until")
    gone = gone.groupBy("batch", "block").agg(F.collect_set("place").alias("gone")).join(heads.select("batch", "block", F.col("docs.length").alias("lengths")), ["batch", "block"])
    kept = F.filter(F.arrays_zip("at", "tf"), lambda x: ~F.array_contains("gone", x["at"]))
    left = read.join(gone, ["batch", "block"], "left").withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    lengths = F.transform("kept.at", lambda at: F.get("lengths", at))
    docs = F.transform("docs", lambda x, at: F.when(~F.array_contains("gone", at), x))
    fresh = {"n": F.size("kept").cast("long"), "max_tf": F.array_max("kept.tf"), "min_length": F.array_min(lengths), "words": F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x), "at": F.col("kept.at"), "tf": F.col("kept.tf"), "docs": docs}
    fresh = [F.when(F.col("gone").isNull(), F.col(c)).otherwise(x).alias(c) for c, x in fresh.items()]
    return left.select("batch", "bucket", "term", "block", *fresh).filter("n > 0")


def _row(key: DataType) -> StructType:
    """What a block holds of a term."""
    doc = StructType().add("key", key).add("length", IntegerType())
    row = StructType().add("term", StringType()).add("block", IntegerType()).add("n", LongType()).add("max_tf", IntegerType())
    row = row.add("min_length", IntegerType()).add("words", LongType())
    return row.add("at", ArrayType(IntegerType())).add("tf", ArrayType(IntegerType())).add("docs", ArrayType(doc))


def _listed(docs):
    """The lists of a block from its documents, an Arrow table (block, key, words); the words are joined by spaces,
    with the empty term in front."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    docs = docs.combine_chunks()
    words = pc.split_pattern(docs["words"].combine_chunks(), " ")
    length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int32) - 1
    coded = words.flatten().dictionary_encode()
    pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(docs) + pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    pairs, tf = np.unique(pairs, return_counts=True)
    term, doc = pairs // len(docs), pairs % len(docs)
    starts = np.flatnonzero(np.diff(term, prepend=-1))  # every term has documents, so there is a start for each
    ends = np.append(starts[1:], len(pairs))
    offsets = pa.array(np.append(starts, len(pairs)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (doc, tf)]
    held = pa.StructArray.from_arrays([docs["key"].combine_chunks(), pa.array(length)], ["key", "length"])
    lists.append(pa.ListArray.from_arrays(pa.array([0] + len(starts) * [len(docs)], pa.int32()), held))  # the empty term comes first
    fronts = [ends - starts, np.maximum.reduceat(tf, starts).astype(np.int32), np.minimum.reduceat(length[doc], starts), np.add.reduceat(length[doc].astype(np.int64), starts)]
    block = np.full(len(starts), docs["block"][0].as_py(), dtype=np.int32)
    return pa.Table.from_arrays([coded.dictionary, pa.array(block), *map(pa.array, fronts), *lists], ["term", "block", "n", "max_tf", "min_length", "words", "at", "tf", "docs"])


def _store(rows: DataFrame, path: str, batch: str) -> None:
    """Lists (term, bucket and what ``_row`` has) as a batch, or more of one."""
    with shuffles_dropped(rows.sparkSession):
        rows = rows.select("term", "bucket", "block", "n", "max_tf", "min_length", "words", "at", "tf", "docs")
        rows.sortWithinPartitions("bucket", "term", "block").write.mode("append").partitionBy("bucket").parquet(f"{path}/lists/batch={batch}")


def keys(spark: SparkSession, path: str) -> DataFrame | None:
    """The documents that the index has."""
    held = lists(spark, path, [_empty_bucket(spark)])
    return None if held is None else held.filter("term = ''").select(F.explode(F.transform("at", lambda at: F.get("docs.key", at))).alias("key"))


def _empty_bucket(spark: SparkSession) -> int:
    return spark.range(1).select(_bucket(F.lit(""))).collect()[0][0]


def add(docs: DataFrame, path: str, key: str, text: str = "text", block: int = BLOCK) -> None:
    """SNK-12, RET-01: documents that the index doesn't have yet, as a batch."""
    spark = docs.sparkSession
    own = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = keys(spark, path)
    own = own if known is None else own.join(known, "key", "left_anti")
    n = own.count()
    if not n:
        return
    batch = _batch()
    at = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // block)))).cast("int")
    words = F.array_join(F.concat(F.array(F.lit("")), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))), " ")
    rows = own.select(at.alias("block"), "key", words.alias("words")).groupBy("block").applyInArrow(_listed, _row(own.schema["key"].dataType))
    _store(rows.withColumn("bucket", _bucket(F.col("term"))), path, batch)
    _commit(spark, path, batch, [])


def remove(docs: DataFrame, path: str, key: str) -> None:
    """SNK-18: the documents with the keys of ``docs`` count no more, until they are added again."""
    rows = docs.select(F.col(key).alias("key")).filter("key is not null").distinct()
    rows.withColumn("batch", F.lit(_batch())).write.mode("append").parquet(f"{path}/removed")


def merge(spark: SparkSession, path: str, block: int = BLOCK) -> None:
    """One batch in place of all, without what was removed. Blocks stay; small ones, and small batches, are joined."""
    held, batches = lists(spark, path), live(spark, path)
    if held is None:
        return
    batch = _batch()
    sizes = held.filter("term = ''").groupBy("batch").agg(F.sum("n").alias("n"), F.max("block").alias("last")).orderBy("batch").collect()  # a row for each call of add
    moved, free, room, apart = [], 0, 0, True
    for r in sizes:
        joined = max(1, block * (r.last + 1) // r.n)
        needed = r.last // joined + 1
        if needed == 1 and r.n <= room:
            first, room, apart = free - 1, room - r.n, False
        else:
            first, free, room = free, free + needed, block - r.n if needed == 1 else 0
        moved.append((r.batch, first, joined))
        apart &= joined == 1 or r.last == 0
    moved = F.broadcast(spark.createDataFrame(moved, "batch string, first int, joined int"))
    to = (F.col("first") + F.floor(F.col("block") / F.col("joined"))).cast("int")
    if not apart:  # places go on where those of the block before end
        before = Window.partitionBy("to").orderBy("batch", "block").rowsBetween(Window.unboundedPreceding, -1)
        heads = held.filter("term = ''").join(moved, "batch").select("batch", "block", to.alias("to"), F.size("docs").alias("size"))
        moved = heads.select("batch", "block", "to", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("base"))
    for turn in range(TURNS):
        rows = lists(spark, path, list(range(turn, BUCKETS, TURNS)))
        rows = rows.join(moved, "batch").withColumn("block", to) if apart else rows.join(moved, ["batch", "block"]).withColumn("block", F.col("to"))
        rows = rows.withColumn("span", F.floor(F.col("block") / SPAN)).repartition("bucket", "span")
        if not apart:
            part = F.struct("base", F.transform("at", lambda at: at + F.col("base")).alias("at"), "tf", "docs")
            fronts = [F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"), F.sum("words").alias("words")]
            rows = rows.groupBy("bucket", "span", "term", "block").agg(*fronts, F.array_sort(F.collect_list(part)).alias("parts"))
            rows = rows.select("*", *[F.flatten(f"parts.{c}").alias(c) for c in ("at", "tf", "docs")])
        _store(rows, path, batch)
    _commit(spark, path, batch, batches)


def vacuum(spark: SparkSession, path: str) -> None:
    """The files of batches that a merge has replaced go; not while a search that began before the merge runs."""
    for b in {b for r in spark.read.parquet(f"{path}/commits").collect() for b in r.replaces}:
        delete(spark, f"{path}/lists/batch={b}")


def _saturated(tf: str, length: str, avgdl: float) -> Column:
    return F.col(tf) * (bm25.K1 + 1) / (F.col(tf) + bm25.K1 * (1 - bm25.B + bm25.B * F.col(length) / F.lit(avgdl)))


def _best(k: int, avgdl: float):
    """The function that adds up a block's scores from its opened lists (at, tf, gain, asking) and its one row
    (qs, docs), and returns for each of ``qs`` what can be among its best k."""

    def best(opened, held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        opened = opened if len(held) else opened.slice(0, 0)  # a block that nobody chose
        docs, qs = (held[c].combine_chunks().flatten() for c in ("docs", "qs"))
        keys = docs.field("key").dictionary_encode()  # repeated keys are one
        of, length = keys.indices.fill_null(0).to_numpy(), docs.field("length").fill_null(0).to_numpy()
        at, tf, asking = (opened[c].combine_chunks() for c in ("at", "tf", "asking"))
        n = pc.list_value_length(at).to_numpy().astype(np.int64)
        at, tf, starts, width = at.flatten().to_numpy(), tf.flatten().to_numpy(), np.cumsum(n) - n, len(keys.dictionary)
        weight = np.repeat(opened["gain"].to_numpy(), n) * (tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * length[at] / avgdl)))
        who, row = pc.index_in(asking.flatten(), value_set=qs).fill_null(-1).to_numpy(), pc.list_parent_indices(asking).to_numpy()
        order = np.argsort(who, kind="stable")
        who, row = who[order], row[order]
        found = []
        for low in range(0, len(qs), STEP):
            part = slice(*np.searchsorted(who, [low, low + STEP]))
            counts = n[row[part]]
            place = np.repeat(starts[row[part]] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            cell = np.repeat(who[part] - low, counts).astype(np.int64) * width + of[at[place]]
            sums = np.bincount(cell, weights=weight[place], minlength=min(STEP, len(qs) - low) * width).reshape(-1, width)
            # Every weight is above zero. What the rounding could make equal to the k-th stays.
            least = np.partition(sums, width - k, axis=1)[:, [width - k]] - 2 * MARGIN if width > k else 0.0
            q, doc = np.nonzero((sums > 0) & (sums >= least))
            found.append((q + low, doc, sums[q, doc]))
        q, doc, score = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.int64, np.int64, float), zip(*found) if found else ((), (), ())))
        return pa.Table.from_arrays([qs.take(pa.array(q)), keys.dictionary.take(pa.array(doc)), pa.array(score)], ["q", "key", "score"])

    return best


class Search:
    """The steps of a search, each a table: ``asked``, ``fronts``, ``bounds``, ``chosen`` and ``hits``."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, query_key: str, k: int, text: str = "text", squared_idf: bool = False):
        self.key, self.k = query_key, k
        asked = queries.select(F.col(query_key).alias("q"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
        empty = _bucket(F.lit(""))
        buckets = [r[0] for r in asked.select(_bucket(F.col("term")).alias("b")).unionAll(spark.range(1).select(empty)).distinct().collect()]  # BUCKETS at most
        every = lists(spark, path, buckets)
        if every is None:
            raise ValueError(f"there is no index at {path}")
        self.heads = every.filter("term = ''").select("batch", "block", "docs")
        n, words = every.filter("term = ''").agg(F.sum("n"), F.sum("words")).collect()[0]
        self.avgdl = float(words or 0) / n if n else 0.0
        self.lists = every.join(bm25.broadcast_if_few(asked.select("term").distinct()), "term", "left_semi")  # else whole folders are dealt
        self.fronts = self.lists.select("batch", "block", "term", "n", "max_tf", "min_length")
        idf = bm25.idf(F.lit(n or 0), F.col("df"))
        known = self.fronts.groupBy("term").agg(F.sum("n").alias("df")).select("term", (idf * idf if squared_idf else idf).alias("gain"))
        self.asked = asked.join(known, "term")
        self.few = asked.limit(bm25.BROADCAST_TERMS // SEEDS + 1).count() <= bm25.BROADCAST_TERMS // SEEDS
        bounded = F.broadcast if self.few else (lambda df: df)
        self.asking = bounded(self.asked.groupBy("term").agg(F.first("gain").alias("gain"), F.collect_list("q").alias("asking")))
        most = F.col("gain") * _saturated("max_tf", "min_length", self.avgdl)
        self.bounds = self.fronts.join(self.asked, "term").groupBy("q", "batch", "block").agg(F.sum(most).alias("bound"))
        order = Window.partitionBy("q").orderBy(F.col("bound").desc(), "batch", "block")
        seeds = self.bounds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SEEDS).select("q", "batch", "block")
        opened = self.lists
        if self.few:  # and so are the lists that seeds need
            opened = opened.join(F.broadcast(seeds.join(asked, "q").select("batch", "block", "term").distinct()), ["batch", "block", "term"], "left_semi")
        reached = self.scored(seeds, opened).filter(F.col("rank") == k).select("q", F.col("score").alias("least"))
        self.chosen = self.bounds.join(reached, "q", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - MARGIN)).select("q", "batch", "block")
        self.hits = self.scored(self.chosen, self.lists)

    def scored(self, blocks: DataFrame, opened: DataFrame) -> DataFrame:
        """(q, key, score, rank) of the best k documents of some blocks (q, batch, block), of which ``opened`` has the lists."""
        # A document lies in one block, so what is dealt by block is added up where it lies.
        held = blocks.groupBy("batch", "block").agg(F.collect_list("q").alias("qs")).join(self.heads, ["batch", "block"])
        held = held.select(F.col("batch").alias("of_batch"), F.col("block").alias("of_block"), "qs", "docs")  # else cogroup takes both sides' for one
        opened = opened.select("batch", "block", "term", "at", "tf")
        opened = (opened.repartition("batch", "block") if self.few else opened).join(self.asking, "term").drop("term")
        key = self.heads.schema["docs"].dataType.elementType["key"].dataType
        row = StructType().add("q", self.asked.schema["q"].dataType).add("key", key).add("score", DoubleType())
        sums = opened.groupBy("batch", "block").cogroup(held.groupBy("of_batch", "of_block")).applyInArrow(_best(self.k, self.avgdl), row)
        return bm25.ranked(sums.withColumn("score", F.round("score", 6)), "q", "key", self.k)


def search(spark: SparkSession, path: str, queries: DataFrame, query_key: str, key: str, k: int, text: str = "text", squared_idf: bool = False) -> DataFrame:
    """RET-02, RET-06, TOP-02: (query_key, key, score, rank) of the best k documents for each query, as ``bm25.search``
    gives over the same documents."""
    found = Search(spark, path, queries, query_key, k, text, squared_idf).hits
    return found.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")
