"""Benchmark decontamination with a distributed positional inverted index.

Training documents are indexed where they lie: each batch of a partition is a shard that stores, for the terms of the
test items, the ascending positions of each term over its documents. Every window of a test item is a phrase query.
It starts from the shard's shortest posting list among its terms and intersects the offset-adjusted lists from the
rarest term on, until nothing is left or all terms agree: a phrase match. With ``slop``, all terms of a proximity match
lie within that many words of their offsets from one start. The documents
are never shuffled, and a term's list never leaves its shard, so frequent terms and passages that many documents share
do not gather anywhere.

Test items go to the workers in blocks of at most ``block_bytes`` of text (a proven bound); with more than one block
the documents are read once a block and the spans of a document are merged.

Cases: null text and text without words have no hits; null or empty items have no windows; items with equal ids count
as one; rows with equal ids are judged one by one; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, table, text_key

WINDOW = 13
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 24 << 20

#: A-Z to a-z; all but digits, letters and bytes of non-ASCII code points to a space.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

SPANS = "array<struct<start:int,end:int>>"
MATCHES = f"doc_id long, text_key long, n_words long, spans {SPANS}, items array<string>, near_items array<string>"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """The windows of a block of items, each window once, in groups of equal length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        import numpy as np

        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text or b"")]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[k : k + size]), set()).add(number[name])
        self.groups = []
        for size in sorted({len(x) for x in found}):
            own = [x for x in found if len(x) == size]
            self.groups.append((np.array(own, dtype=np.int64), [np.array(sorted(found[x])) for x in own]))

    def ids(self, text: bytes | None):
        """The terms of a text by number, -1 where no item has them."""
        import numpy as np

        found = tokens(text or b"")
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), dtype=np.int32, count=len(found))

    def search(self, docs: list, slop: int) -> list[tuple[list[tuple[int, int]], set[int], set[int]]]:
        """For each document (of ``ids``) its hit spans and the items with phrase and with proximity matches only."""
        import numpy as np

        pad = 2 * slop + 1  # no match reaches over it
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        begin = np.cumsum(sizes + pad) - sizes
        stream = np.full(int((sizes + pad).sum()) + pad, -1, dtype=np.int64)
        for d, at in zip(docs, begin, strict=True):
            stream[at : at + len(d)] = d
        at = np.flatnonzero(stream >= 0)
        order = np.argsort(stream[at], kind="stable")
        postings = at[order]
        counts = np.bincount(stream[at], minlength=len(self.vocabulary))
        first = np.concatenate([[0], np.cumsum(counts)])
        found: list[tuple[list[tuple[int, int]], set[int], set[int]]] = [([], set(), set()) for _ in docs]
        for grid, owners in self.groups:
            size = grid.shape[1]
            lengths = counts[grid]
            ranked = np.argsort(lengths, axis=1, kind="stable")
            for k in np.flatnonzero(lengths.min(axis=1) > 0):
                terms, rank = grid[k], ranked[k]
                rare = terms[rank[0]]
                starts = postings[first[rare] : first[rare + 1]] - rank[0]
                if slop:
                    starts = np.unique(starts[:, None] + np.arange(-slop, slop + 1))
                for j in rank[1:]:
                    own = postings[first[terms[j]] : first[terms[j] + 1]]
                    low = np.searchsorted(own, starts + (j - slop))
                    starts = starts[(low < len(own)) & (own[np.minimum(low, len(own) - 1)] <= starts + (j + slop))]
                    if not len(starts):
                        break
                if not len(starts):
                    continue
                exact = starts[(starts >= 0) & (starts + size <= len(stream))]
                for j in range(size):
                    exact = exact[stream[exact + j] == terms[j]]
                whole = set(exact.tolist())
                for s in starts.tolist():
                    d = int(np.searchsorted(begin, s + int(rank[0]) + slop, side="right")) - 1  # the pad keeps the next document further off
                    if s in whole:
                        found[d][0].append((s - int(begin[d]), s - int(begin[d]) + size))
                        found[d][1].update(owners[k].tolist())
                    else:
                        found[d][2].update(owners[k].tolist())
        return found


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _block_matches(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int, slop: int) -> DataFrame:
    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa

        phrases = Phrases(items, window)
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

        def searched(ids, keys, held):
            got = phrases.search(held, slop)
            named = lambda x: [phrases.names[k] for k in sorted(x)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(d) for d in held], pa.int64()), pa.array([_merged(s) for s, _, _ in got], schema.field("spans").type), pa.array([named(x) for _, x, _ in got], schema.field("items").type), pa.array([named(n - x) for _, x, n in got], schema.field("near_items").type)],
                schema=schema,
            )

        for batch in batches:
            ids, keys, held, size = [], [], [], 0
            for i, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_values(batch.column(2)), strict=True):
                ids.append(i)
                keys.append(k)
                held.append(phrases.ids(text))
                size += len(text or b"")
                if size >= SHARD_BYTES:
                    yield searched(ids, keys, held)
                    ids, keys, held, size = [], [], [], 0
            if ids:
                yield searched(ids, keys, held)

    return docs.mapInArrow(shards, MATCHES)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, text_key, n_words, spans (merged ranges of hit words), items (ids of test
    items with a phrase match, as strings), near_items (those with proximity matches alone).

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text. Phrases are ``window`` consecutive item words, or
    the whole of a shorter item. ``slop`` is how far, in words, each term of a proximity match may lie from its place.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    test = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    size = test.agg(F.sum(F.octet_length("text") + 64)).collect()[0][0] or 0
    blocks = 1 if size <= block_bytes else math.ceil(2 * size / block_bytes)
    parts = []
    for k in range(blocks):
        items = test if blocks == 1 else test.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        parts.append(_block_matches(own, [(r["item_id"], bytes(r["text"])) for r in items.collect()], window, slop))
    if blocks == 1:
        return parts[0]
    apart = [p.withColumn("block", F.lit(k)) for k, p in enumerate(parts)]
    copies = F.sum(F.when(F.col("block") == 0, 1).otherwise(0))
    gathered = reduce(DataFrame.unionAll, apart).groupBy("doc_id", "text_key", "n_words").agg(copies.alias("copies"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_set("near_items"))).alias("near"))
    joined = F.aggregate(
        "spans",
        F.array().cast(SPANS),
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))).cast(SPANS))).otherwise(F.concat(done, F.array(x).cast(SPANS))),
    )
    return gathered.select("doc_id", "text_key", "n_words", F.when(F.size("spans") == 0, F.array().cast(SPANS)).otherwise(joined).alias("spans"), "items", F.array_except("near", "items").alias("near_items"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def judged(found: DataFrame) -> DataFrame:
    """The digest of ``matches``: a document is contaminated if it has hits and they are a twentieth of its words."""
    hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")
    return found.withColumn("n_hit", hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    The verdicts of contaminated rows alone are joined, by id and text; rows with equal ids are judged apart.
    """
    bad = judged_keys(matches(docs, benchmark, window, slop))
    key = text_key(F.col("text"))
    return docs.withColumn("__key", key).join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & F.col("__key").eqNullSafe(bad["__bad_key"]), "left_anti").drop("__key")


def judged_keys(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return found.filter((F.size("spans") > 0) & (hit * 20 >= F.col("n_words"))).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__bad_key")).distinct()


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document of ``documents`` against every item of ``benchmark``."""
    return judged(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS row_key, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), bw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)
), dpos AS (
  SELECT row_key, n, p, array_to_string(w[p : p + n - 1], ' ') AS phrase
  FROM (SELECT row_key, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (
  SELECT d.row_key, d.p, d.n, win.item_id FROM dpos d JOIN win ON d.n = win.n AND d.phrase = win.phrase
), words_hit AS (
  SELECT row_key, count(DISTINCT q) AS n_hit FROM (SELECT row_key, unnest(range(p, p + n)) AS q FROM hits) GROUP BY row_key
), items AS (
  SELECT row_key, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_key, item_id FROM hits) GROUP BY row_key
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words_hit USING (row_key) LEFT JOIN items USING (row_key)
"""
