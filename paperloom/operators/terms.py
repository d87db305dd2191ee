"""Technical terms: acronyms, capitalised phrases, scores, overlaps, definitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from paperloom.functions.text import collapsed

# Java's versions disagree about letters outside ASCII at \\b, so the edges of words are spelled out.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EXPANDED = BEGIN + r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*\(([A-Z]{2,6})\)"
STANDALONE = BEGIN + r"[A-Z]{2,6}" + END
CAPITALISED = BEGIN + r"[A-Z][a-z]+" + END
PHRASE = BEGIN + r"(?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+" + END

# Words in capitals that are no acronyms.
NO_ACRONYMS = (
    "THE", "AND", "FOR", "ARE", "BUT", "NOT", "YOU", "ALL", "CAN", "HER", "WAS", "ONE", "OUR", "OUT", "DAY", "GET",
    "HAS", "HIM", "HIS", "HOW", "ITS", "MAY", "NEW", "NOW", "OLD", "SEE", "TWO", "WAY", "WHO", "BOY", "DID", "GOT",
    "LET", "PUT", "SAY", "SHE", "TOO", "USE", "YES",
)
# Phrases and words that are no terms.
GENERIC = (
    "proposed method", "previous work", "et al", "in this paper", "we show", "results show", "can be", "is used",
    "such as", "based on", "in order", "this work", "our method", "our approach", "in this work", "we propose",
    "we present", "we use", "can be seen", "it is", "there are", "there is", "as well", "note that", "we note",
    "in addition", "as shown", "we can",
)
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "this", "that", "these", "those",
)


def acronyms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """STR-25, FIL-20: (key, term, expansion): expanded pairs, then acronyms that stand alone; the first of each."""
    body = F.col(text)
    pairs = docs.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(body, F.lit(EXPANDED), F.lit(2)).alias("term"), F.regexp_extract_all(body, F.lit(EXPANDED), F.lit(1)).alias("expansion"))).alias("at", "x"))
    pairs = pairs.select(key, "x.term", "x.expansion", F.lit(0).alias("kind"), "at")
    alone = docs.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(body, F.lit(STANDALONE), F.lit(0)))).alias("at", "term"))
    alone = alone.filter(~F.col("term").isin(*NO_ACRONYMS)).select(key, "term", F.lit(None).cast("string").alias("expansion"), F.lit(1).alias("kind"), "at")
    order = Window.partitionBy(key, "term").orderBy("kind", "at")
    return pairs.unionAll(alone).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(key, "term", "expansion")


def phrases(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """STR-26: (key, term): two to four capitalised words in a row."""
    return docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PHRASE), F.lit(0)))).alias("term"))


def merged(candidates: list[DataFrame], key: str) -> DataFrame:
    """RET-15: one candidate for each lower-case term; one with an expansion is preferred, then the earlier list."""
    every = None
    for k, c in enumerate(candidates):
        own = c.select(key, "term", (F.col("expansion") if "expansion" in c.columns else F.lit(None).cast("string")).alias("expansion"), F.lit(k).alias("source"))
        every = own if every is None else every.unionAll(own)
    order = Window.partitionBy(key, F.lower("term")).orderBy(F.col("expansion").isNull().cast("int"), "source", "term")
    return every.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(key, "term", "expansion", "source")


def filtered_out(term: Column) -> Column:
    """FIL-19: too short, a stop word, a generic phrase, or a single word of at most three letters."""
    low = F.lower(term)
    return (F.length(term) < 2) | low.isin(*STOPWORDS, *GENERIC) | (~term.rlike(r"\s") & (F.length(term) <= 3))


def rarity(term: Column) -> Column:
    """Rarity by form, without a table of frequencies: phrases .8, words of six letters .7, others .5."""
    return F.when(term.rlike(r"\s"), 0.8).when(F.length(term) >= 6, 0.7).otherwise(0.5)


@F.pandas_udf(ArrayType(LongType()))
def occurrences(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """How often each of a text's terms occurs in it, left to right without overlaps; one pass for all terms."""
    import ahocorasick

    def counted(text, some):
        free = {t: 0 for t in some if t}
        n = dict.fromkeys(free, 0)
        found = ahocorasick.Automaton()
        for t in free:
            found.add_word(t, t)
        if text and free:
            found.make_automaton()
            for end, t in found.iter(text):
                if end + 1 - len(t) >= free[t]:
                    n[t] += 1
                    free[t] = end + 1
        return [n.get(t, 0) for t in some]

    return pd.Series([counted(t, list(some)) for t, some in zip(texts, terms, strict=True)])


def scores(docs: DataFrame, candidates: DataFrame, key: str, text: str = "text", least: float = 0.3) -> DataFrame:
    """RET-17: .3 of the count over the document's largest, .5 of the rarity, .2 of the words, up to three, over three;
    ``least`` is asked of the score itself, which then keeps two places, halves going up.

    Counts are of the lower-case term anywhere in the text, without overlaps. A document's candidates are one list
    beside its text, and counted in one pass over it.
    """
    low = F.lower(F.trim("term"))
    listed = candidates.groupBy(key).agg(F.collect_list(F.struct("term", low.alias("low"))).alias("__c"))
    counted = docs.select(key, F.lower(F.col(text)).alias("__t")).join(listed, key).select(key, "__c", occurrences(F.col("__t"), F.col("__c.low")).alias("__n"))
    most = F.greatest(F.array_max("__n"), F.lit(1).cast("long"))
    counted = counted.select(key, most.alias("__most"), F.explode(F.arrays_zip("__c", "__n")).alias("x")).select(key, "__most", "x.__c.term", F.col("x.__n").alias("n"))
    words = F.size(F.split(low, r"\s+"))
    # The weights.
    score = F.col("n") / F.col("__most") * 0.3 + rarity(low) * 0.5 + F.least(words, F.lit(3)) / 3 * 0.2
    marked = counted.withColumn("score", score).filter(~filtered_out(F.trim("term")) & (F.col("score") >= least))
    return marked.select(key, "term", "n", F.round("score", 2).alias("score"))


def bundle_terms(found: DataFrame, document: str, least: float = 0.65, most: int = 12) -> DataFrame:
    """RET-18: (document, term, score, scopes, definition, source, status, rank) of ``found`` (document, idx, scope,
    term, score, definition, source): terms of ``least`` and more, of each lower-case term the best, the earliest of
    equals; its scopes are that block's and those of blocks behind it. Ranked by where the definition comes from, score
    and term; a term without a definition waits for one."""
    low = F.lower(F.trim("term"))
    rows = found.filter((F.col("score") >= least) & (F.trim("term") != "")).withColumn("__low", low)
    first = Window.partitionBy(document, "__low").orderBy(F.col("score").desc(), "idx", "scope", "term")
    rows = rows.withColumn("__best", F.first("idx").over(first)).withColumn("__n", F.row_number().over(first))
    scopes = F.array_sort(F.collect_set(F.when((F.col("__n") == 1) | (F.col("idx") > F.col("__best")), F.col("scope"))))
    best = F.max(F.when(F.col("__n") == 1, F.struct(F.trim("term").alias("term"), "score", "definition", "source"))).alias("x")
    merged_terms = rows.groupBy(document, "__low").agg(best, scopes.alias("scopes")).select(document, "x.term", "x.score", "scopes", "x.definition", "x.source")
    # The order of the sources.
    place = F.when(F.col("source").isNull(), 4).when(F.col("source") == "dbpedia", 0).when(F.col("source") == "dictionary", 1).when(F.col("source") == "llm", 3).otherwise(2)
    order = Window.partitionBy(document).orderBy(place, F.col("score").desc(), "term")
    ready = F.when(F.coalesce("definition", F.lit("")) != "", "ready").otherwise("pending_llm")
    return merged_terms.withColumn("status", ready).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def top_terms(scored: DataFrame, key: str, most: int = 12) -> DataFrame:
    """TOP-09: the best score of each lower-case term, and the first ``most`` by score and term."""
    best = scored.groupBy(key, F.lower("term").alias("term")).agg(F.max("score").alias("score"))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "term")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def spans(docs: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """(key, start, end, term) of every match of a pattern."""
    body = F.col(text)
    parts = F.arrays_zip(F.split(body, pattern, -1).alias("gap"), F.concat(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.array(F.lit(None).cast("string"))).alias("term"))
    placed = docs.select(key, F.posexplode(parts).alias("at", "x"))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.sum(F.length("x.gap") + F.coalesce(F.length("x.term"), F.lit(0))).over(upto)
    return placed.withColumn("end", ended).filter("x.term is not null").select(key, (F.col("end") - F.length("x.term")).alias("start"), "end", F.col("x.term").alias("term"))


def without_overlaps(found: DataFrame, key: str) -> DataFrame:
    """RET-16: by start, longer first, a span stays if it starts at or after the end of the last that stayed."""
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") - F.col("end")).alias("less"), "end", "term"))).alias("spans"))
    kept = F.aggregate("spans", F.filter("spans", lambda x: F.lit(False)), lambda a, x: F.when((F.size(a) == 0) | (x["start"] >= F.element_at(a, -1)["end"]), F.concat(a, F.array(x))).otherwise(a))
    return listed.select(key, F.explode(kept).alias("x")).select(key, "x.start", "x.end", "x.term")


# What may stand between a term and what it means, with that, in the order in which they are tried.
DEFINED_BY = (
    r",?\s+which\s+is\s+([^.]+)\.",
    r",?\s+defined\s+as\s+([^.]+)\.",
    r"\s+\(([^)]+)\)",
    r",?\s+i\.e\.?,?\s+([^.]+)\.",
    r",?\s+also\s+known\s+as\s+([^.]+)\.",
    r",?\s+refers\s+to\s+([^.]+)\.",
    r":\s+([^.]+)\.",
)


def inline_definition(text: Column, term: Column, least: int = 11, most: int = 299) -> Column:
    """STR-27: what a text says a term is, on one line, by the first way that gives a fair length; else null."""
    quoted = F.concat(F.lit(r"(?i)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    said = F.array(*[collapsed(F.call_function("regexp_extract", text, F.concat(quoted, F.lit(way)), F.lit(1))) for way in DEFINED_BY])
    return F.get(F.filter(said, lambda t: F.length(t).between(least, most)), 0)
