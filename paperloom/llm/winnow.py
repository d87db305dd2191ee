"""Document fingerprints by winnowing.

A text's words (runs of letters and digits, lower case) are hashed, each run of ``k`` words gets a hash that is
rolled from its words' (a polynomial over a prime), and every window of ``w`` such hashes gives its minimum, the
rightmost of equal ones. Hash and position of each distinct minimum are the fingerprint. Any ``w + k - 1`` words that
two texts share give a common hash. Texts with fewer than ``k`` words have one hash of all words; with fewer than
``w`` hashes, one window.

Everything is DataFrame expressions on one row. Hash and position share a long, the position counted down, so that
the least long of a window is its least hash at its rightmost place.

Cases: null text is empty; a text without words has an empty fingerprint; two empty fingerprints are alike (1), an
empty and another are not (0); rows with equal ids are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, table, text_key

K, W = 4, 4
#: Words: ideographs and kana one by one, else runs of letters and digits, long runs in pieces.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]{1,24}"
PRIME, BASE = 2147483647, 1000003
PLACES = 1 << 32


def with_minima(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out``, array<long>: hash * 2**32 + (2**32 - 1 - position) of each distinct window minimum.

    The steps are columns of their own, so that none is computed twice.
    """
    word, gram, coded = F.col(f"{out}_words"), F.col(f"{out}_grams"), F.col(f"{out}_coded")
    step = lambda a, b: F.pmod(a * BASE + b, F.lit(PRIME))

    def rolled(x, i):
        for j in range(1, k):
            x = step(x, F.get(word, i + j))
        return x

    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))
    whole = F.aggregate(word, F.lit(0).cast("long"), step)
    grams = F.when(F.size(word) >= k, F.transform(F.slice(word, F.lit(1), F.greatest(F.size(word) - (k - 1), F.lit(0))), rolled)).when(F.size(word) > 0, F.array(whole)).otherwise(word)
    minima = F.transform(F.slice(coded, F.lit(1), F.greatest(F.size(coded) - (w - 1), F.lit(1))), lambda x, i: F.least(x, *[F.get(coded, i + j) for j in range(1, max(w, 2))]))
    return (
        df.withColumn(f"{out}_words", F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME))))
        .withColumn(f"{out}_grams", grams)
        .withColumn(f"{out}_coded", F.transform(gram, lambda g, i: g * PLACES + (PLACES - 1 - i)))
        .withColumn(out, F.array_distinct(minima))
        .drop(f"{out}_words", f"{out}_grams", f"{out}_coded")
    )


def hashes(minima: Column) -> Column:
    return F.array_distinct(F.transform(minima, lambda m: F.shiftright(m, 32)))


def shown(minima: Column) -> Column:
    """hash@position, comma-joined; the hash in eight hexadecimal digits."""
    return F.array_join(F.transform(minima, lambda m: F.concat(F.lpad(F.lower(F.hex(F.shiftright(m, 32))), 8, "0"), F.lit("@"), (PLACES - 1 - F.pmod(m, F.lit(PLACES))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, minima, fingerprint of each row of ``docs`` (doc_id, text)."""
    found = with_minima(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), "text", "minima", k, w)
    return found.select("doc_id", "minima", shown(F.col("minima")).alias("fingerprint"))


def successors(rows: DataFrame, fan: int = 32) -> DataFrame:
    """``rows`` (doc_id, text_key, n_chars; distinct) with next_id and next_key: the row after each in ascending
    (doc_id, text_key), nulls first, and the first after the last.

    The order is cut at ``fan`` * ``fan`` quantiles of doc_id; rows are ordered within a slice, and the first row of
    each slice, of which there are so many at most, follows the last of the slice before.
    """
    share = [k / fan**2 for k in range(1, fan**2)]
    cuts = rows.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, 10 * fan**2).alias("cuts")).collect()[0]["cuts"] or [0] * len(share)
    coarse = F.array(*[F.lit(x).cast("long") for x in cuts[fan - 1 :: fan]])
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in cuts[k * fan : k * fan + fan - 1]]) for k in range(fan)])
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("doc_id").cast("long")))
    sliced = rows.withColumn("coarse", below(coarse)).withColumn("slice", F.col("coarse") * fan + below(F.get(fine, F.col("coarse"))))
    me = F.struct("doc_id", "text_key")
    order = Window.partitionBy("slice").orderBy(F.col("doc_id").asc_nulls_first(), "text_key")
    heads = sliced.groupBy("slice").agg(F.min(me).alias("head"))
    following = F.coalesce(F.lead("head").over(Window.orderBy("slice")), F.min("head").over(Window.partitionBy()))
    heads = F.broadcast(heads.withColumn("following", following).select("slice", "following"))
    return sliced.withColumn("next", F.lead(me).over(order)).join(heads, "slice").withColumn("next", F.coalesce("next", "following")).select("doc_id", "text_key", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.text_key").alias("next_key"))


def compare(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs``.

    Edited: the last quarter of the code points is replaced by the first as many of the next document. Exact repeats
    of a row are one document in this order. Texts are shuffled once, by id and text; what a document needs of the
    next one (its beginning and its hashes) is sent to it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    full = docs.select("doc_id", text_key(text).alias("text_key"), text.alias("text"))
    rows = checkpoint(full.groupBy("doc_id", "text_key", F.char_length("text").alias("n_chars")).agg(F.count("*").alias("copies")))
    repeated = bool(rows.filter("copies > 1").limit(1).collect())
    links = successors(rows.drop("copies"))
    needs = links.select(F.col("next_id").alias("doc_id"), F.col("next_key").alias("text_key"), F.col("doc_id").alias("to_id"), F.col("text_key").alias("to_key"), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"))
    sent = full.alias("d").join(needs.alias("n"), F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.text_key") == F.col("n.text_key"))).select("n.to_id", "n.to_key", F.col("d.text").alias("text"), "n.quarter")
    sent = with_minima(sent, "text", "minima", k, w).select("to_id", "to_key", F.expr("left(text, quarter)").alias("beginning"), hashes(F.col("minima")).cast("array<int>").alias("next_hashes"))
    if repeated:
        sent = sent.groupBy("to_id", "to_key").agg(F.first("beginning").alias("beginning"), F.first("next_hashes").alias("next_hashes"))
    met = full.join(sent, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("text_key") == F.col("to_key"))).withColumn("n_chars", F.char_length("text").cast("long"))
    met = met.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), "beginning")).select("doc_id", "n_chars", "text", "edited", "next_hashes")
    met = with_minima(with_minima(met, "text", "own", k, w), "edited", "other", k, w)
    met = met.withColumn("own_hashes", hashes(F.col("own")).cast("array<int>")).withColumn("edited_hashes", hashes(F.col("other")).cast("array<int>"))
    return met.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document of ``documents``."""
    return compare(table(spark, sf_dir, "documents"))
