"""Phrase collocations, by hashed bucket counts (PCY, DHP) and Apriori pruning.

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends, pieces into words; all counts are per
language. Phrases are counted pass by pass, a pass for each length. While pass k counts phrases of k words exactly, it
also adds up what it finds of k + 1 words in hashed buckets. A phrase of k words is counted only if the bucket of its
hash reached the least count in the pass before, and if its first and its last k - 1 words are frequent. The buckets
that did, as bits, and the hashes of the frequent phrases, as bits of another map, are all that is broadcast. Either
map lets more through when it is crowded, never less: what counts is the exact count behind them, by the phrase itself.

The maps have ``2**LEAST_BITS`` to ``2**MOST_BITS`` bits by the size of the texts and by the number of frequent phrases,
so no more than 16 MB each; a task holds a byte for each bucket. Where a corpus fills them, the passes prune less and
count more, with the same result. A task writes its pass's rows into a table in the shared folder, phrases of a chunk
of texts added up; Spark sums both kinds from there, and the table is deleted.

The score of a phrase is floor(1000 a n / (l r)), with a its count, n all words of the language, and l and r the counts
of the parts of its worst cut. Products are decimals of 38 digits: a n below 10^35 and l r below 10^38 are exact.

A phrase lies inside a longer one of nearly its count: only one word longer need be looked at, since every phrase
between the two is as frequent as the longer one.

Cases: a null text is empty; a null language is ``und``, together with a language of that name; words are what spaces
and tabs separate, so text without any is one word; repeated rows and rows with equal ids count each; ties of scores go
by count, then by phrase; other columns, whatever their names, aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_values, bitmap, checkpoint, mixed, remove, shared_folder, spread_join, table

LONGEST, LEAST, MOST = 5, 100, 2000
#: A candidate goes if a longer one has this share of its count.
INSIDE = (100, 100)
NO_LANG = "und"
#: A-Z in lower case; where pieces end, as line feeds; tabs as spaces.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
LEAST_BITS, MOST_BITS = 16, 27
BYTES_A_BUCKET = 128
SLOT = 12  # bits of the buckets of one row
CHUNK = 4 << 20  # bytes of texts that are counted at once
SALTS = 256


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, object] = {}


def powers(base: int, n: int):
    """base, base^2, ... modulo 2^64, n of them; kept, as each chunk needs about as many."""
    import numpy as np

    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.multiply.accumulate(np.full(n, base, dtype=np.uint64))
    return _POWERS[base][:n]


class Words:
    """The words of some texts (in ``PLAIN`` form) as arrays: where each begins and ends, its piece, language and hash.

    A word's hash is a polynomial over its bytes, taken from sums over all bytes, so no word becomes an object of its
    own. It decides only what is counted; ``counted`` compares the words themselves.
    """

    def __init__(self, texts: list[bytes], langs: list[str]):
        import numpy as np
        import xxhash

        self.data = b"\n".join(texts)
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        n = len(self.bytes)
        ends = self.bytes == 10
        inside = np.concatenate([[False], ~(ends | (self.bytes == 32)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(ends, dtype=np.int32)[self.start]
        names = list(dict.fromkeys(langs))
        self.langs, number = names, {x: k for k, x in enumerate(names)}
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.lang = np.array([number[x] for x in langs], dtype=np.int64)[np.searchsorted(begin, self.start, side="right") - 1]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((self.bytes + np.uint64(1)) * powers(BASE, n), dtype=np.uint64)])
        self.hash = mixed((sums[self.end] - sums[self.start]) * powers(pow(BASE, -1, 1 << 64), n)[self.start])
        self._codes = [np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], dtype=np.uint64)[self.lang]]

    def __len__(self) -> int:
        return len(self.start)

    def codes(self, k: int):
        """A hash of the language and the k words from each place on, as uint64; only some of them lie in one piece."""
        import numpy as np

        for j in range(len(self._codes) - 1, k):
            self._codes.append(mixed(self._codes[j][: max(len(self) - j, 0)] * np.uint64(BASE) + self.hash[j:]))
        return self._codes[k]

    def whole(self, k: int):
        """Whether the k words from each place on lie in one piece."""
        n = max(len(self) - k + 1, 0)
        return self.piece[:n] == self.piece[len(self) - n :]

    def numbers(self, at):
        """A number for each of the words ``at`` some places, the same for equal words alone."""
        import numpy as np

        _, first, number = np.unique(self.hash[at], return_index=True, return_inverse=True)
        own, like = at, at[first][number]
        size = self.end[own] - self.start[own]
        same = bool((size == self.end[like] - self.start[like]).all())
        for lo in range(0, len(own) if same else 0, 1 << 16):  # byte by byte against the first word of its hash
            n = size[lo : lo + (1 << 16)]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = (self.bytes[np.repeat(self.start[x[lo : lo + (1 << 16)]], n) + step] for x in (own, like))
            same = same and bool((a == b).all())
        if same:
            return number
        index: dict[bytes, int] = {}  # two words of one hash
        return np.array([index.setdefault(self.data[self.start[w] : self.end[w]], len(index)) for w in own], dtype=np.int64)

    def counted(self, at, k: int):
        """(languages, phrases, counts) of the phrases of k words that begin ``at`` some places; exact."""
        import numpy as np
        import pyarrow as pa

        inside = np.zeros(len(self), dtype=bool)
        for j in range(k):
            inside[at + j] = True
        ids = self.numbers(np.flatnonzero(inside))
        place, most = (np.cumsum(inside) - 1)[at], int(ids.max()) + 1
        number = self.lang[at]
        for j in range(k):
            number = number * most + ids[place + j]
            _, first, number, n = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        at = at[first]
        phrases = [self.data[b:e] for b, e in zip(self.start[at].tolist(), self.end[at + k - 1].tolist(), strict=True)]
        phrases = [b" ".join(p.split()) if b"  " in p else p for p in phrases]
        langs = pa.array(self.langs, pa.string()).take(pa.array(self.lang[at]))
        return langs, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n)


def chunks(batches: Iterator, most: int = CHUNK) -> Iterator[Words]:
    """The words of (lang, text) batches, about ``most`` bytes of texts at once; only pieces stay whole."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
            data, at = (text or b"").translate(PLAIN), 0
            while at < len(data):
                to = len(data)
                if to - at > most:
                    to = data.rfind(b"\n", at, at + most) + 1 or data.find(b"\n", at + most) + 1 or to
                texts.append(data[at:to])
                langs.append(lang)
                size += to - at
                at = to
                if size >= most:
                    yield Words(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


def passes(bits_of: bytes, codes):
    """Which of ``codes`` have their bit set."""
    import numpy as np

    held = np.frombuffer(bits_of, dtype=np.uint8)
    place = codes & np.uint64(len(held) * 8 - 1)
    return (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counts(texts: DataFrame, k: int, least: int, bits: int, known: bytes | None, buckets: bytes | None, more: bool) -> DataFrame:
    """Pass k over ``texts`` (lang, text): rows (lang, phrase, n), and if ``more`` also rows (slot, tally): the bytes of
    some buckets of phrases of k + 1 words, counted up to ``least``.

    ``known`` are bits of the frequent phrases of k - 1 words, ``buckets`` those of the pass before."""
    kind = "uint8" if least < 1 << 8 else "uint32"

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["lang", "phrase", "n", "slot", "tally"]
        tally = np.zeros(1 << bits if more else 0, dtype=kind)
        for some in chunks(batches):
            here = some.whole(k)
            if k > 1:
                frequent = passes(known, some.codes(k - 1))
                here &= frequent[: len(here)] & frequent[1 : len(here) + 1] & passes(buckets, some.codes(k))
            at = np.flatnonzero(here)
            if len(at):
                langs, phrases, n = some.counted(at, k)
                yield pa.RecordBatch.from_arrays([langs, phrases, n, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
            if more:
                both = some.whole(k + 1)
                both &= here[: len(both)] & here[1 : len(both) + 1]
                bucket, n = np.unique(some.codes(k + 1)[both] & np.uint64((1 << bits) - 1), return_counts=True)
                bucket = bucket.astype(np.int64)
                tally[bucket] = np.minimum(tally[bucket].astype(np.int64) + n, least)
        rows = tally.reshape(-1, 1 << SLOT)
        full = np.flatnonzero(rows.any(axis=1))
        for lo in range(0, len(full), 1024):
            some_slots = full[lo : lo + 1024]
            n = len(some_slots)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(some_slots.astype(np.int32)), pa.array([rows[s].tobytes() for s in some_slots], pa.binary())],
                names=names,
            )

    return texts.mapInArrow(found, "lang string, phrase string, n long, slot int, tally binary")


def full_buckets(tallies: DataFrame, bits: int, least: int) -> bytes:
    """The bits of the buckets that reach ``least`` over all rows (slot, tally)."""
    kind = "uint8" if least < 1 << 8 else "uint32"

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        slot, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["slot", "bits"])
        for batch in batches:
            for s, tally in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != slot:
                    if slot is not None:
                        yield out()
                    slot, total = s, np.zeros(1 << SLOT, dtype=np.int64)
                total = np.minimum(total + np.frombuffer(tally.as_buffer(), dtype=kind), least)
        if slot is not None:
            yield out()

    found = tallies.repartition("slot").sortWithinPartitions("slot").mapInArrow(summed, "slot int, bits binary")
    held = bytearray(1 << (bits - 3))
    width = 1 << (SLOT - 3)
    for row in found.collect():  # 2**(bits - SLOT) rows at most
        held[row.slot * width : (row.slot + 1) * width] = row.bits
    return bytes(held)


def known_bits(phrases: DataFrame, k: int, bits: int) -> bytes:
    """The bits of the hashes of ``phrases`` (lang, phrase), all of k words."""

    def places(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for some in chunks(batches):
            code = some.codes(k)[some.whole(k)] & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64))], names=["place"])

    return bitmap(phrases.select("lang", "phrase").mapInArrow(places, "place long"), bits)


def _bits(size: int) -> int:
    return min(max(int(size).bit_length(), LEAST_BITS), MOST_BITS)


def frequent(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, a) of the phrases of 1, 2, ... words that occur ``least`` times, up to ``longest`` words or
    the first length without any, and (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    bits = _bits((texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) // BYTES_A_BUCKET)
    out: list[DataFrame] = []
    totals = known = buckets = None
    for k in range(1, longest + 1):
        folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
        counts(texts, k, least, bits, known, buckets, k < longest).write.option("compression", "zstd").parquet(folder)
        rows = spark.read.parquet(folder)
        counted = rows.filter("slot is null").select("lang", "phrase", "n")
        if totals is None:
            totals = checkpoint(counted.groupBy("lang").agg(F.sum("n").alias("n")))
        found = checkpoint(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
        out.append(found)
        n = found.count()
        if n and k < longest:
            known = known_bits(found, k, _bits(16 * n))
            buckets = full_buckets(rows.filter("slot is not null").select("slot", "tally"), bits, least)
        remove(spark, folder)
        if not n:
            break
    return out, totals


def _looked_up(rows: DataFrame, known: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``known``, one row for each of ``keys``; a key may have any share of the rows."""
    uses = rows.groupBy(*keys).agg(F.count("*").alias("uses"))
    return spread_join(rows, known.join(uses, keys), keys, "uses", total).drop("uses")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) as a long, by exact products."""
    whole = lambda c: c.cast("decimal(20,0)")
    over, under = whole(a) * whole(n) * F.lit(1000).cast("decimal(4,0)"), whole(left) * whole(right)
    return F.call_function("div", over, under)


def collocations(phrases: list[DataFrame], totals: DataFrame, most: int = MOST, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``most`` of each language, from what ``frequent`` returns."""
    every = None
    sizes = [p.count() for p in phrases]
    for k, found in enumerate(phrases, 1):
        own = found.select("lang", "phrase", "a", F.lit(k).alias("k"))
        every = own if every is None else every.unionAll(own)
    cut = lambda a, b: F.array_join(F.slice(F.split("phrase", " "), a, b), " ")
    longer = every.filter("k > 2").select("lang", "a", F.explode(F.array(cut(F.lit(1), F.col("k") - 1), cut(F.lit(2), F.col("k") - 1))).alias("phrase"))
    outer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = every.filter("k > 1").join(outer, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (F.col("outer") * inside[0] < F.col("a") * inside[1])).drop("outer")
    kept = _looked_up(kept, totals, ["lang"], sum(sizes[1:]))
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("left", cut(F.lit(1), F.col("cut"))).withColumn("right", cut(F.col("cut") + 1, F.col("k") - F.col("cut")))
    total = sum(k * n for k, n in enumerate(sizes))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = _looked_up(cuts, every.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part], total)
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = worst.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, most: int = MOST, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """The first ``most`` collocations of each language of ``docs``."""
    return collocations(*frequent(docs, lang, text, longest, least), most, inside)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the collocations of ``documents``."""
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM words, range(1, 6) AS ks(k), unnest(range(1, len(w) + 1)) AS places(i)
  WHERE i + k - 1 <= len(w)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100
), inner_phrases AS (
  SELECT DISTINCT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, c.a AS outer_a
  FROM candidates c, range(2, 5) AS ms(m), range(1, 5) AS places(i) WHERE m < k AND i + m - 1 <= k
), kept AS (
  SELECT * FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM inner_phrases x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.outer_a >= 100 * c.a)
), halves AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first_part, array_to_string(w[cut + 1:], ' ') AS rest
  FROM kept, range(1, 5) AS cs(cut) WHERE cut < k
), cuts AS (
  SELECT h.lang, h.phrase, h.a, cut, l.a AS l, r.a AS r, n,
    (1000::HUGEINT * h.a::HUGEINT * n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM halves h JOIN totals t ON t.lang = h.lang
  JOIN f l ON l.lang = h.lang AND l.phrase = h.first_part JOIN f r ON r.lang = h.lang AND r.phrase = h.rest
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM worst
QUALIFY rank <= 2000
"""
