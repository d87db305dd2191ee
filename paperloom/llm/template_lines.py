"""Line dedup with a log-template tree of fixed depth.

The tree's levels are a line's number of tokens, its tokens before a run of open places, and those after it. Tokens
with digits are variable fields wherever they stand. A line stands under its exact template and, from five tokens on,
under one for each run of places that is left open: single places up to five tokens, else runs of about a third of the
line, begun at each sixth. So lines of equal length meet that differ in one field of up to a sixth of their tokens at
any place, the first and last included, or in several within a third. White space splits tokens; in scripts without it
(Han, kana, Hangul, Thai, Lao, Khmer, Burmese) each character is a token, and counts as half a word.

A template recurs if it stands in documents that have nothing else to do with each other. Copies of a document share
all of its lines, and are for near-duplicate detection, not for this. So what counts is the number of unrelated
carriers, however many rows each has. One carrier are documents that
- are near copies: of up to 32 least hashes of their shingles, digits made 0, seven tenths are the same;
- or whose own text, without the lines that have a template in common with other documents, is alike: 3 of up to 32
  least hashes. So the lines of a shared passage don't speak for each other, and copies with many edits, which differ
  in most lines, still belong together;
- or have all other lines alike; or have no own text at all.
``least_documents`` carriers are needed, for lines of ``long_words`` words two. Lines of a recurring template are
dropped from all documents. Templates with under ``least_words`` fixed words, or with an open run and under one more,
never recur: two words come together by chance.

Templates with several such rests are found first, summed up before they move. A bitmap of fixed size then picks their
documents, which alone are compared; another keeps lines away from the join with the recurring templates that can't be
among them. Texts are read in pieces of whole lines.

Cases: null and empty texts have no lines to drop; lines end at line feeds; templates are known by 64-bit hashes; rows
with equal ids and texts are one document in the counts, and all of them lose the same lines; a document of which all
lines recur is left with an empty text; a column line_dedup that ``docs`` has stays, and the new one gets another _ at
its end; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, bitmap, checkpoint, forget, mixed, remove, shared_folder, small_batches, spread_join, table, text_key
from .components import components

LEAST_OPEN = 5  # tokens of a line from which places are left open
MAP_BITS = 25
#: Sketches: words of a shingle, and ranges of hashes. Texts belong together that have so many least hashes of their own
#: text in common, or such a share of those of the whole.
SKETCH_WORDS, BINS = 4, 32
OWN_LEAST, WHOLE_LIKE = 3, (7, 10)
CHUNK_BYTES = 1 << 19  # texts that are parsed at once
PIECE_BYTES = 1 << 17  # arrays of 8 bytes for each of these stay in the cache
CHUNK_DOCS = 1 << 11  # with BINS, a sort key of 16 bits
LAST = (1 << 64) - 1
_BYTE_BASE, _TOKEN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_FIELD, _OPEN = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Digits to 0, white space but line feeds to a space.
_FOLD = bytes(0x30 if 0x30 <= b <= 0x39 else 0x20 if b in (0x09, 0x0B, 0x0C, 0x0D) else b for b in range(256))
_powers: dict = {}


def _powers_of(base: int, n: int):
    """base**0 .. base**(n - 1), modulo 2**64."""
    import numpy as np

    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _piece(text: bytes):
    """Of each token of a folded text: hash, whether it has a digit, whether it is one of an unspaced script, its line."""
    import numpy as np

    b = np.frombuffer(text, dtype=np.uint8)
    n = len(b)
    feed = b == 0x0A
    apart = feed | (b == 0x20)
    start = ~apart
    start[1:] &= apart[:-1]
    lead = None
    if n and b.max() >= 0xE0:
        after = np.append(b[1:], np.uint8(0))
        lead = ((b >= 0xE3) & (b <= 0xED)) | ((b == 0xE0) & (after >= 0xB8) & (after <= 0xBB)) | ((b == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F))) | ((b == 0xF0) & (after >= 0xA0) & (after <= 0xAF))
        at = np.flatnonzero(lead)
        past = at + np.where(b[at] == 0xF0, 4, 3)
        start |= lead
        past = past[past < n]
        start[past] |= ~apart[past]
    starts = np.flatnonzero(start)
    stop = ~apart
    stop[:-1] &= apart[1:] | start[1:]
    ends = np.flatnonzero(stop) + 1
    powers = _powers_of(_BYTE_BASE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    inverse = _powers_of(pow(_BYTE_BASE, -1, 1 << 64), n)
    hashes = mixed((total[ends] - total[starts]) * inverse[starts])
    zeros = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(b == 0x30, out=zeros[1:])
    field = zeros[ends] > zeros[starts]
    hashes[field] = np.uint64(_FIELD)
    feeds = np.cumsum(feed, dtype=np.int64)
    return hashes, field, lead[starts] if lead is not None else np.zeros(len(starts), dtype=bool), feeds[starts]


@dataclass
class Parsed:
    """Some documents: their tokens, and their lines that have any.

    ``first`` and ``size`` place a line's tokens, ``doc`` and ``number`` the line in its document and among its lines;
    ``fixed`` is twice its words without fields, ``half`` twice all its words; ``exact`` its template.
    """

    token: object
    first: object
    size: object
    doc: object
    number: object
    fixed: object
    half: object
    exact: object
    weight: object
    total: object

    def templates(self, least_words: int):
        """(line, template): line by line, the exact one first; only what has enough fixed words."""
        import numpy as np

        line = np.flatnonzero(self.fixed >= 2 * least_words)
        lines, found = [line], [self.exact[line]]
        n = self.size
        step = np.maximum((n + 3) // 6, 1)
        width = np.where(n > LEAST_OPEN, 2 * step, 1)
        runs = -((width - n) // step) + 1  # -(-(n - width) // step) + 1
        runs = np.where((n >= LEAST_OPEN) & (self.fixed >= 2 * least_words + 2), runs, 0)
        for j in range(int(runs.max(initial=0))):
            line = np.flatnonzero(runs > j)
            a = np.minimum(j * step[line], n[line] - width[line])
            lo = self.first[line] + a
            hi = lo + width[line]
            enough = self.fixed[line] - (self.weight[hi] - self.weight[lo]) >= 2 * least_words + 2
            line, a, lo, hi = line[enough], a[enough], lo[enough], hi[enough]
            whole = self.total[self.first[line] + n[line]] - self.total[self.first[line]]
            place = (n[line].astype(np.uint64) << np.uint64(20)) + a.astype(np.uint64) + np.uint64(_OPEN)
            lines.append(line)
            found.append(mixed(mixed(whole - (self.total[hi] - self.total[lo])) + mixed(place)).view(np.int64))
        line, found = np.concatenate(lines), np.concatenate(found)
        order = np.argsort(line, kind="stable")
        return line[order], found[order]

    def rests(self):
        """Of each line a hash of all other lines of its document, 0 if there are none."""
        import numpy as np

        hashes = self.exact.view(np.uint64)
        docs = int(self.doc[-1]) + 1 if len(self.doc) else 0
        whole = np.zeros(docs, dtype=np.uint64)
        np.add.at(whole, self.doc, hashes)
        order = np.lexsort((hashes, self.doc))
        d, h = self.doc[order], hashes[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])[: len(d)]
        group = np.cumsum(new) - 1
        times = np.empty(len(d), dtype=np.uint64)
        times[order] = np.bincount(group).astype(np.uint64)[group] if len(d) else group.astype(np.uint64)
        return (whole[self.doc] - times * hashes).view(np.int64)


def parsed(texts: list[bytes | None]) -> Parsed:
    import numpy as np

    bodies = [(t or b"").translate(_FOLD) for t in texts]
    lines = np.array([t.count(b"\n") + 1 for t in bodies], dtype=np.int64)
    body = b"\n".join(bodies)
    parts, at, before = [], 0, 0
    while at < len(body) or not parts:
        cut = body.find(b"\n", at + PIECE_BYTES) + 1 or len(body)
        piece = body[at:cut]
        token, field, unspaced, line = _piece(piece)
        parts.append((token, field, unspaced, line + before))
        at, before = cut, before + piece.count(b"\n")
    token, field, unspaced, line = (np.concatenate([p[k] for p in parts]) for k in range(4))
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])[: len(line)])
    size = np.diff(np.append(first, len(line)))
    begin = np.cumsum(lines) - lines
    doc = np.searchsorted(begin, line[first], side="right") - 1
    weigh = np.where(unspaced, 1, 2)
    weight = np.concatenate([[0], np.cumsum(np.where(field, 0, weigh))])
    half = np.concatenate([[0], np.cumsum(weigh)])
    place = np.arange(len(line)) - np.repeat(first, size)
    total = np.zeros(len(line) + 1, dtype=np.uint64)
    np.cumsum(token * _powers_of(_TOKEN_BASE, int(size.max(initial=0)))[place], out=total[1:])
    end = first + size
    exact = mixed(mixed(total[end] - total[first]) + size.astype(np.uint64)).view(np.int64)
    return Parsed(token, first, size, doc, line[first] - begin[doc], weight[end] - weight[first], half[end] - half[first], exact, weight, total)


def _chunks(texts: Iterator[bytes | None]) -> Iterator[list[bytes | None]]:
    held, size = [], 0
    for text in texts:
        if held and (size + len(text or b"") > CHUNK_BYTES or len(held) == CHUNK_DOCS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or b"")
    if held:
        yield held


def sketches(token, doc, kind: int):
    """(document, least hash) of the shingles in each of ``BINS`` ranges that has any; the last bit is ``kind``.

    ``token`` are hashes, ``doc`` their documents, ascending; documents with fewer tokens than a shingle have one."""
    import numpy as np

    n = len(token)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, n))
    left = np.repeat(first + size, size) - np.arange(n)
    padded = np.append(token, np.zeros(SKETCH_WORDS, dtype=np.uint64))
    gram = np.zeros(n, dtype=np.uint64)
    for j in range(SKETCH_WORDS):
        gram = mixed(gram * np.uint64(_BYTE_BASE) + np.where(left > j, padded[j : j + n], np.uint64(j)))
    keep = (left >= SKETCH_WORDS) | np.isin(np.arange(n), first)
    gram, of = gram[keep], doc[keep]
    place = ((of - of[0]) * BINS + (gram >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1]]))
    least = np.minimum.reduceat(gram[order], cut)
    return of[0] + place[order][cut].astype(np.int64) // BINS, (least & np.uint64(LAST - 1) | np.uint64(kind)).view(np.int64)


def _inside(bits, template):
    import numpy as np

    place = template & ((1 << MAP_BITS) - 1)
    return (bits[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)


def _rests(docs: DataFrame, least_words: int) -> DataFrame:
    """(template, rest) for each template of each document."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for texts in _chunks(binary_values(batch.column(0))):
                found = parsed(texts)
                line, template = found.templates(least_words)
                order = np.lexsort((template, found.doc[line]))
                line, template = line[order], template[order]
                doc = found.doc[line]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (template[1:] != template[:-1])])[: len(doc)]
                yield pa.RecordBatch.from_arrays([pa.array(template[new]), pa.array(found.rests()[line[new]])], names=["template", "rest"])

    return docs.select("text").mapInArrow(rows, "template long, rest long")


def _carriers(docs: DataFrame, some: DataFrame, least_words: int) -> DataFrame:
    """(text_key, carried, own, whole: sketches) of the documents with templates that may be among ``some``, and which."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(some.select(F.pmod("template", F.lit(1 << MAP_BITS))), MAP_BITS))  # 4 MB

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(held.value, dtype=np.uint32)

        def listed(doc, count: int, values):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=count))]).astype(np.int32)), values)

        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in _chunks(binary_values(batch.column(1))):
                found = parsed(texts)
                line, template = found.templates(least_words)
                met = _inside(bits, template)
                line, template = line[met], template[met]
                carriers, number = np.unique(found.doc[line], return_inverse=True)
                n = len(carriers)
                where = np.full(len(texts), -1)
                where[carriers] = np.arange(n)
                # Own text: lines with enough fixed words without such a template; if there are none, the other lines.
                shared = np.zeros(len(found.size), dtype=bool)
                shared[line] = True
                whole = where[found.doc] >= 0
                full = found.fixed >= 2 * least_words
                own = whole & full & ~shared
                has = np.zeros(len(texts), dtype=bool)
                has[found.doc[own]] = True
                own |= whole & ~full & ~has[found.doc]
                marked = lambda lines: np.repeat(lines, found.size)  # noqa: E731, B023
                token_doc = np.repeat(where[found.doc], found.size)
                own_doc, own_least = sketches(found.token[marked(own)], token_doc[marked(own)], 0)
                whole_doc, whole_least = sketches(found.token[marked(whole)], token_doc[marked(whole)], 1)
                some_own = np.zeros(n, dtype=bool)
                some_own[own_doc] = True
                rest = np.where(some_own[number], found.rests()[line], 0)
                carried = pa.StructArray.from_arrays([pa.array(template), pa.array(found.half[line] // 2), pa.array(rest)], names=["template", "words", "rest"])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(carriers + at)), listed(number, n, carried), listed(own_doc, n, pa.array(own_least)), listed(whole_doc, n, pa.array(whole_least))], names=["text_key", "carried", "own", "whole"])
                at += len(texts)

    return docs.select(text_key(F.col("text")).alias("text_key"), "text").mapInArrow(rows, "text_key long, carried array<struct<template: long, words: long, rest: long>>, own array<long>, whole array<long>")


def _alike(held: DataFrame) -> DataFrame:
    """(u, v), written: texts of which a sketch is enough like that of the least text with which it has a hash in common.

    A hash that more than a thousandth of the rows have is spread by salt where it meets its least text."""
    sized = held.select("text_key", F.size("own").alias("n_own"), F.size("whole").alias("n_whole"), F.concat("own", "whole").alias("both"))
    hashes = sized.select("text_key", "n_own", "n_whole", F.explode("both").alias("h")).select("text_key", F.when(F.col("h").bitwiseAND(1) == 0, F.col("n_own")).otherwise(F.col("n_whole")).alias("size"), "h")
    # Of primitive values, so that Spark sums up by hashing; rows with equal texts repeat a hash, and two texts must have it.
    heads = hashes.groupBy("h").agg(F.min("text_key").alias("v"), F.min_by("size", "text_key").alias("v_size"), F.max("text_key").alias("other"), F.count("*").alias("n_rows"))
    heads = checkpoint(heads.filter("v <> other").drop("other"))
    met = spread_join(hashes, heads, ["h"], "n_rows", held.count()).filter("text_key <> v").groupBy(F.col("text_key").alias("u"), "v", "size", "v_size", F.col("h").bitwiseAND(1).alias("whole")).agg(F.count_distinct("h").alias("n"))
    own = (F.col("whole") == 0) & (F.col("n") >= F.least(F.lit(OWN_LEAST), "size", "v_size"))
    whole = (F.col("whole") == 1) & (F.col("n") * WHOLE_LIKE[1] >= F.greatest("size", "v_size") * WHOLE_LIKE[0])
    links = checkpoint(met.filter(own | whole).select("u", "v"))
    forget(heads)
    return links


def recurring(docs: DataFrame, least_documents: int = 3, least_words: int = 3, long_words: int = 20) -> DataFrame:
    """(template), written: the templates whose lines are dropped."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/template-lines-{uuid.uuid4().hex}"
    several = checkpoint(_rests(docs, least_words).groupBy("template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")).filter("lo < hi").select("template"))
    with small_batches(spark):
        _carriers(docs, several, least_words).write.parquet(f"{folder}/carriers")
    forget(several)
    held = spark.read.parquet(f"{folder}/carriers")
    links = _alike(held)
    found = components(links)
    forget(links)
    # Templates that only the bitmap let through have one rest, and so one carrier.
    rows = held.select("text_key", F.explode("carried").alias("x")).select("text_key", "x.*").distinct()
    by_rest = rows.join(found.withColumnsRenamed({"node": "text_key", "root": "class"}), "text_key", "left").groupBy("template", "rest").agg(F.min(F.coalesce("class", "text_key")).alias("class"), F.max("words").alias("words"))
    by_class = by_rest.groupBy("template", "class").agg(F.max("words").alias("words"))
    whole = by_class.groupBy("template").agg(F.count("*").alias("n"), F.max("words").alias("words"))
    least = F.when(F.col("words") >= long_words, min(2, least_documents)).otherwise(least_documents)
    known = checkpoint(whole.filter(F.col("n") >= least).select("template"))
    remove(spark, folder)
    return known


def dropped_lines(docs: DataFrame, known: DataFrame, least_words: int = 3) -> DataFrame:
    """doc_id, text_key, dropped (line numbers from 0, ascending) of the documents with lines of ``known`` templates."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(known.select(F.pmod("template", F.lit(1 << MAP_BITS))), MAP_BITS))  # 4 MB

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(held.value, dtype=np.uint32)
        for batch in batches:
            at = 0
            for texts in _chunks(binary_values(batch.column(2))):
                found = parsed(texts)
                line, template = found.templates(least_words)
                met = _inside(bits, template)
                line, template = line[met], template[met]
                take = pa.array(found.doc[line] + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found.number[line].astype(np.int32)), pa.array(template)], names=["doc_id", "text_key", "line", "template"])
                at += len(texts)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(rows, "doc_id long, text_key long, line int, template long")
    return some.join(known, "template").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def dedup(docs: DataFrame, least_documents: int = 3, least_words: int = 3, long_words: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, any others) with the text that is left, and a last column line_dedup:
    struct<n_lines, dropped: array<int>>."""
    added = "line_dedup"
    while added in docs.columns:
        added += "_"
    known = recurring(docs, least_documents, least_words, long_words)
    drops = checkpoint(dropped_lines(docs, known, least_words)).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key"), F.col("dropped").alias("__dropped"))
    forget(known)
    met = docs.withColumn("__key", text_key(F.col("text"))).join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text_key")), "left")
    lines = F.split("text", "\n", -1)
    feeds = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    left = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__dropped", i)), "\n"))
    info = F.struct(F.coalesce(feeds + 1, F.lit(0)).alias("n_lines"), F.coalesce("__dropped", F.array().cast("array<int>")).alias("dropped"))
    return met.withColumn(added, info).withColumn("text", left).select(*[f"`{c}`" for c in docs.columns], added)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document of ``documents``."""
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("line_dedup.n_lines").cast("long").alias("n_lines"),
        F.size("line_dedup.dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("line_dedup.dropped").cast("array<string>"), ",").alias("dropped"),
        F.char_length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("left_sha256"),
    )
