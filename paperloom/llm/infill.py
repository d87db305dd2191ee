"""Fill-in-the-middle: texts cut into prefix, middle and suffix at ends of units, and put in a new order.

A text's units are the matches of a pattern, left to right; the tokenizers library's ``Split`` pre-tokenizer isolates
them and gives their places in code points. Nothing is trained. Where each unit ends is all that Python returns: the
length of that array is n, and two ends, the lesser drawn one first, give the slices. All else is column expressions.

Draws come from the first four 8-digit groups h1 to h4 of the hex sha256 of ``seed:id``: the cuts are h1 and h2 modulo
n + 1, a text stays plain if h3 modulo 100 reaches ``rate``, and h4 modulo 100 under ``spm_rate`` puts the suffix first.
A text that contains a mark stays plain too, so an output can always be put back.

The library is given a block of ``BLOCK`` code points at most, which ends at a line's end, so its memory doesn't grow
with a text: units may not reach over a line's end. A line longer than that is handed over by itself.

Cases: null and empty texts are empty and plain, with n 0; a null id is drawn for as the empty string; rows with equal
ids are cut alike by their own text; other columns are kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: A line with its end, or the rest of the text.
LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
BLOCK = 1 << 16


def unit_ends(text: str, split) -> list[int]:
    """Where each unit of ``text`` ends, in code points; ``split`` is a pre-tokenizer that isolates units."""
    ends, at = [], 0
    while at < len(text):
        to = len(text)
        if to - at > BLOCK:
            to = text.rfind("\n", at, at + BLOCK) + 1 or text.find("\n", at + BLOCK) + 1 or to
        ends += [at + end for _, (_, end) in split.pre_tokenize_str(text[at:to])]
        at = to
    return ends


def ends(text: Column, pattern: str = LINE) -> Column:
    """array<int>: where each match of ``pattern`` in ``text`` ends, in code points; all of the text must match."""

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
        for texts in batches:
            yield texts.map(lambda t: unit_ends(t, split))

    return found(text)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4 of a document, as longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("long") for j in range(4)]


def _slice(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = LINE, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with a struct ``infill``: n, form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    psm is mark P, prefix, mark S, suffix, mark M, middle; spm begins with mark S and the suffix.
    """
    p, s, m = MARKS
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    body = F.coalesce(F.col("__row")[text], F.lit(""))
    rows = docs.select(own.alias("__row")).select("__row", body.alias("__text"), ends(body, pattern).alias("__ends"))
    h1, h2, h3, h4 = draws(F.col("__row")[key], seed)
    n = F.size("__ends").cast("long")
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.contains("__text", F.lit(mark))
    plain = (n == 0) | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    place = lambda units: F.when(units == 0, 0).otherwise(F.element_at("__ends", F.greatest(units, F.lit(1)).cast("int")))
    first, last = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    rows = rows.select("__row", "__text", n.alias("n"), form.alias("form"), F.when(n > 0, place(first)).alias("__b"), F.when(n > 0, place(last)).alias("__e"))
    whole, cuts = F.col("__text"), F.col("form") != "plain"
    rows = rows.select(
        "__row", "__text", "n", "form",
        F.when(cuts, _slice(whole, F.lit(0), F.col("__b"))).alias("prefix"),
        F.when(cuts, _slice(whole, F.col("__b"), F.col("__e"))).alias("middle"),
        F.when(cuts, F.substring(whole, F.col("__e") + 1, F.char_length(whole))).alias("suffix"),
    )
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(whole)
    done = F.struct("n", "form", "prefix", "middle", "suffix", output.alias("output")).alias("infill")
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c != "infill"], done)


def restored(output: Column, form: Column) -> Column:
    """The text that ``cut`` made ``output`` of."""
    p, s, m = (F.instr(output, mark) for mark in MARKS)
    width = len(MARKS[0])
    middle = F.substring(output, m + width, F.char_length(output))
    prefix = F.when(form == "spm", F.substring(output, p + width, m - p - width)).otherwise(F.substring(output, p + width, s - p - width))
    suffix = F.when(form == "spm", F.substring(output, s + width, p - s - width)).otherwise(F.substring(output, s + width, m - s - width))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every document of ``documents``, cut at lines, and what its output is put back to."""
    done = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = lambda name: F.col(f"infill.{name}")
    return done.select(
        "doc_id", x("n").alias("n"), x("form").alias("form"),
        F.char_length(x("prefix")).cast("long").alias("prefix_chars"), F.char_length(x("middle")).cast("long").alias("middle_chars"),
        F.sha2(x("output"), 256).alias("output_sha256"), F.sha2(restored(x("output"), x("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS u1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS u2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM d
), cut AS (
  SELECT *,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain'
         WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(u1, u2)], '') AS prefix,
    array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS middle,
    array_to_string(units[greatest(u1, u2) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
