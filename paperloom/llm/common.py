"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that an operator writes, which driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master, where there is one machine, may a temporary folder stand in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tables-")


#: Spark's own setting: shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's own setting: bytes of an Arrow batch that goes to Python. Spark's 64 MB are held several times over, by Arrow on
#: both sides and by Python, in each task, outside the JVM's heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that are made in it hand rows to Python in batches of some 4 MB."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that are made in it drop their shuffle files when they end; for tables that are written and reread."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; what was shuffled on the way goes at once, and
    Python gets small batches."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with shuffles_dropped(spark), small_batches(spark):
        return df.select("*").checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that an operator wrote, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*done: DataFrame) -> None:
    """Delete the files of tables from ``checkpoint``, once all that was made of them is written itself."""
    for df in done:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", salts: int = 32, most: int = 1000) -> DataFrame:
    """``left`` joined to ``right`` (one row a key, none null) on ``keys``; hot keys are spread over ``salts`` tasks.

    Column ``n`` of ``right`` tells how many rows of ``left`` have the key, ``total`` how many rows there are. A key is
    hot if it has more than one in ``most`` of them, so fewer than ``most`` keys are, and only these are broadcast.
    """
    hot = F.col(n) * most > total
    heavy = F.broadcast(right.filter(hot).select(*keys, F.lit(True).alias("__hot")))
    own = left.join(heavy, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    other = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return own.join(other, [*keys, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Number of words in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """64 bits of a text; with doc_id it names a row, so that rows that share an id stay apart."""
    return F.xxhash64(text)


def binary_values(column) -> Iterator[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes, without decoding them."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(n):
        yield bytes(view[at[k] : at[k + 1]]) if valid[k] else None


def bit_of(column: Column, bits: int) -> Column:
    """The place of a value in ``bitmap``."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def bitmap(places: DataFrame, bits: int) -> bytes:
    """2**bits bits, those set that ``places`` (one column, of ``bit_of``) holds; its size doesn't depend on the data.

    A filter by it lets through every value that is in the table, and few others while the table is small.
    """
    import numpy as np

    place = F.col(places.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))
    words = places.groupBy(F.shiftright(place, 5).alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out.tobytes()


class WordHashes(dict):
    """Words to 64-bit hashes; forgets all when it has grown large (some 12 MB)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 16:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mixed(x):
    """A bijection of uint64 arrays that spreads all bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(found: list[bytes], hashes: WordHashes, k: int):
    """A hash of each run of k words, or of all words if there are fewer, as uint64."""
    import numpy as np

    if not found:
        return np.empty(0, dtype=np.uint64)
    words = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - size + 1 + j])
    return out
