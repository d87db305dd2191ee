"""Language ID by multilingual mixture inference.

For each language in the labelled rows a distribution over hashed character n-grams is learned. A document is a
mixture of such distributions: expectation-maximisation finds the proportions of a set of languages, and the set grows
from the best single language as long as the log-likelihood gains more than a penalty for one more proportion.

Letters are lower-cased and all else is one space, so only letters count. Learning sums up n-gram counts in each
partition first; the model has 2**BITS numbers a language at most, and 2**CELLS in all, whatever the number of rows.
Prediction is a map over documents and sees only their texts.

Cases: null text and text without a letter get ``und`` with score 0, as does everything if no row is labelled; rows
without a label teach nothing; ties go to the language that comes first in code point order; rows with equal ids are
judged one by one; an empty table gives no rows. More than 2**14 labels are an error: they are no languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ORDER = 3
BITS = 16
CELLS = 24
SMOOTH = 0.5
UNKNOWN = "und"
_letters = None


def _table():
    """Code point -> itself if it is a letter, else a space."""
    global _letters
    if _letters is None:
        import numpy as np

        points = np.arange(0x110000, dtype=np.uint32)
        is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _letters = np.where(is_letter, points, np.uint32(32))
    return _letters


def grams(text: str, bits: int = BITS):
    """Hashed n-grams of the letters, words with a space on each side; empty without a letter."""
    import numpy as np

    points = _table()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint64)
    if len(points) < ORDER:
        return np.empty(0, dtype=np.int64)
    out = points[: len(points) - ORDER + 1]
    for j in range(1, ORDER):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - ORDER + 1 + j]
    return ((out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """languages in code point order; likelihood[bucket, language]."""

    languages: list[str]
    likelihood: object
    bits: int

    def proportions(self, text: str | None, penalty: float = 3.0, rounds: int = 25) -> dict[str, float]:
        """The languages of the best set with their shares; empty for text without a letter."""
        import numpy as np

        ids = grams(text or "", self.bits)
        if not len(ids) or not self.languages:
            return {}
        ids, counts = np.unique(ids, return_counts=True)
        p = self.likelihood[ids]
        n = counts.sum()
        best = int(np.argmax(counts @ np.log(p)))
        chosen, share, mix = [best], np.ones(1), p[:, best]
        cost = penalty * np.log(n + 1)
        while len(chosen) < len(self.languages):
            # Log-likelihood is concave: one more language can't gain over n * (slope - 1).
            slope = (counts / mix) @ p / n - 1
            slope[chosen] = -1
            new = int(np.argmax(slope))
            if n * slope[new] <= cost:
                break
            own = p[:, [*chosen, new]]
            part = np.append(share * 0.8, 0.2)
            for _ in range(rounds):
                part = part * ((counts / (own @ part)) @ own) / n
            wider = own @ part
            if counts @ (np.log(wider) - np.log(mix)) <= cost:
                break
            chosen, share, mix = [*chosen, new], part, wider
        return {self.languages[k]: float(s) for k, s in sorted(zip(chosen, share, strict=True), key=lambda x: (-x[1], x[0]))}


def fit(rows: DataFrame) -> Model:
    """The model of labelled ``rows`` (text, lang); every row counts."""
    import numpy as np

    rows = rows.filter("lang is not null and text is not null").select("lang", "text")
    n = rows.select("lang").distinct().count()
    if n > 1 << (CELLS - 10):
        raise ValueError(f"{n} labels are no languages")
    bits = next(b for b in range(BITS, 0, -1) if n << b <= 1 << CELLS)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, object] = {}

        def out():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                if lang not in held and len(held) >= 64:
                    yield from out()
                    held.clear()
                held.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for text in some:
                    held[lang] += np.bincount(grams(text, bits), minlength=1 << bits) if len(text) > 1 << bits else 0
                short = [t for t in some if len(t) <= 1 << bits]
                for lo in range(0, len(short), 64):
                    held[lang] += np.bincount(grams("\n".join(short[lo : lo + 64]), bits), minlength=1 << bits)
        yield from out()

    found = rows.mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((1 << bits, len(languages)))
    counts[found["bucket"].to_numpy(dtype=np.int64), found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return Model(languages, (counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (1 << bits)), bits)


def predict(docs: DataFrame, model: Model, penalty: float = 3.0) -> DataFrame:
    """``docs`` (text, any others) with columns mixture (map of language to share), lang_pred and score (its share);
    columns of these names that ``docs`` has are replaced."""
    docs = docs.drop("mixture", "lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**CELLS numbers
    place = docs.columns.index("text")

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [held.value.proportions(t, penalty) for t in batch.column(place).to_pylist()]
            first = [next(iter(f.items()), (UNKNOWN, 0.0)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64())), pa.array([x for x, _ in first], pa.string()), pa.array([min(1.0, s) for _, s in first], pa.float64())],
                names=[*batch.schema.names, "mixture", "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(rows, f"{schema}, mixture map<string,double>, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The third of the rows that is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, penalty: float = 3.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture of each row of ``docs`` (doc_id, text, lang); learned from the rows
    that aren't held out."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(marked.select("doc_id", "held_out", "text"), model, penalty)
    return found.select("doc_id", "held_out", "lang_pred", "score", "mixture")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document of ``documents``."""
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("mixture").cast("long").alias("n_languages"))
