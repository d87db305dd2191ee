"""Token counts kept as rollups by deltas.

A change inserts a document's count, deletes it, or revises it; as signed rows these add up to totals by source,
language and tokenizer. A batch of changes is summed up and written to a folder of its own in the store; a marker,
written last, commits it. A batch that is committed already is passed over, so a batch may be sent any number of
times, and one that fell over on the way leaves nothing that counts. Totals are the sums over committed batches;
``compact`` replaces them by their sum.

Sums are made before rows move, so a source with a third of all documents is as good as any. Tokenizer files are
read by the workers; their folder is a parameter.

Cases: null text has no tokens; null sources and languages are groups of their own; counts that are null are 0; a
change of an unknown kind is an error; groups whose documents and tokens are all taken back stay, with 0, until
``compact``; an empty batch commits; a store without batches has no totals.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, table, text_key, words

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, n_documents long, n_tokens long"
COMMITS = "batch string, data string, replaces array<string>"
VOCABULARY = "/opt/tokenizers"
#: How texts are split before byte pairs are merged: the pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SALTS = 16
_encoders: dict = {}


def encoder(path: str):
    """A byte-level BPE encoder of the ranks in ``path``; one for each worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_counts(docs: DataFrame, path: str = f"{VOCABULARY}/byte_bpe_50k.tiktoken", column: str = "n_tokens") -> DataFrame:
    """``docs`` (text, any others) without the text, with its number of tokens."""
    place = docs.columns.index("text")
    left = [c for c in docs.columns if c != "text"]

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(count(t)) if t else 0 for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns) if k != place], pa.array(n, pa.int64())], names=[*left, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(rows, f"{schema}, `{column}` long")


def signed(changes: DataFrame) -> DataFrame:
    """Deltas of ``changes`` (kind: insert, delete or revise; source, lang, tokenizer, n_tokens; before: the count
    that a revision replaces)."""
    n, before = F.coalesce("n_tokens", F.lit(0)), F.coalesce("before", F.lit(0)) if "before" in changes.columns else F.lit(0)
    kind = F.col("kind")
    unknown = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    documents = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - before)
    rows = changes.select(*KEYS, documents.cast("long").alias("d"), tokens.cast("long").alias("t"))
    return rows.groupBy(*KEYS).agg(F.sum("d").alias("n_documents"), F.sum("t").alias("n_tokens"))


class Rollup:
    """A store of deltas in ``path``, a folder that driver and executors share.

    ``commits`` has a marker for each batch that counts on its own, ``folded`` the names of those that ``compact`` put
    into one. ``compact`` keeps the markers few; one writer at a time may call it, others may commit meanwhile.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        files, at = self._files(path)
        return files.exists(at)

    def _marker(self, batch: str) -> str:
        return f"{self.path}/commits/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _known(self, batch: str) -> bool:
        if self._exists(f"{self._marker(batch)}/_SUCCESS"):
            return True
        folded = f"{self.path}/folded"
        return self._exists(folded) and not self.spark.read.schema("batch string").parquet(folded).filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes of ``batch``, once; False if it is committed already."""
        if self._known(batch):
            return False
        data = f"{self.path}/deltas/{uuid.uuid4().hex}"
        signed(changes).write.parquet(data)
        self._mark(batch, data, [])
        return True

    def _mark(self, batch: str, data: str, replaces: list[str]) -> None:
        self.spark.createDataFrame([(batch, data, replaces)], COMMITS).coalesce(1).write.mode("overwrite").parquet(self._marker(batch))

    def batches(self) -> DataFrame:
        """The commits (batch, data, replaces); replaces names the batches that ``compact`` has summed up in one."""
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits/*")

    def _live(self) -> list:
        """The commits that count, from one listing; batches since the last ``compact``, and its own."""
        commits = self.batches().collect()
        gone = {b for c in commits for b in c["replaces"]}
        return [c for c in commits if c["batch"] not in gone]

    def _summed(self, live: list) -> DataFrame:
        paths = [c["data"] for c in live]
        rows = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("n_documents").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_documents, n_tokens over the committed batches."""
        return self._summed(self._live())

    def compact(self) -> None:
        """One table of totals in place of the batches listed now, whose names stay known; a batch that is committed
        meanwhile stays as it is. The new marker is written before the old ones go, so whatever fails, each counts once."""
        live = self._live()
        data = f"{self.path}/deltas/{uuid.uuid4().hex}"
        self._summed(live).filter("n_documents <> 0 or n_tokens <> 0").write.parquet(data)
        names = [c["batch"] for c in live]
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/folded")
        self._mark(f"compact {data}", data, names)
        for name in names:
            files, at = self._files(self._marker(name))
            files.delete(at, True)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document of ``documents`` under two tokenizers, by four batches: all are inserted; the same batch
    comes again; documents that repeat the text of one with a smaller id are deleted; the word counts are revised to
    words with a letter or digit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", text_key(F.col("text")).alias("key"), F.char_length("text").alias("n_chars"), words(F.col("text")).alias("words"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*")), F.lit(0)).cast("long").alias("real_words"))
    counted = checkpoint(with_counts(docs, column="pieces"))
    # Groups of equal texts, spread by salt: one may hold a third of all documents.
    groups = counted.groupBy("key", "n_chars").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("key", "n_chars", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(groups, ["key", "n_chars", "salt"], "left").withColumn("repeats", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    tall = marked.select("repeats", "source", "lang", F.explode(F.array(F.struct(F.lit("byte_bpe_50k@1").alias("tokenizer"), F.col("pieces").alias("n_tokens")), F.struct(F.lit("words@1").alias("tokenizer"), F.col("words").alias("n_tokens")))).alias("c")).select("repeats", "source", "lang", "c.tokenizer", "c.n_tokens")
    store = Rollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    load = tall.withColumn("kind", F.lit("insert"))
    store.commit("load", load)
    store.commit("load", load)
    store.commit("delete repeats", tall.filter("repeats").withColumn("kind", F.lit("delete")))
    store.commit("revise words", marked.filter("not repeats").select("source", "lang", F.lit("words@1").alias("tokenizer"), F.col("real_words").alias("n_tokens"), F.col("words").alias("before"), F.lit("revise").alias("kind")))
    return store.totals()
