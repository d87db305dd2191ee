"""Small documents with everything that may go wrong."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    stems = ["ren", "tor", "mal", "vi", "que", "so", "lin", "dra", "pe", "ust"]
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n))


def odd_documents():
    """Null, empty, blank, very short, very long, repeated, equal ids, null ids, non-ASCII."""
    a = words(1, 120)
    rows = [
        (0, None, "en", "s1", None),
        (1, "", "en", "s1", 0),
        (2, " \t\n ", None, "s2", 4),
        (3, "one", "en", None, 3),
        (4, a, "en", "s1", len(a)),
        (5, a, "de", "s3", len(a)),
        (5, a, "de", "s3", len(a)),
        (6, a.replace("ren", "REN", 1), "de", "s3", len(a)),
        (7, words(2, 20000), "en", "s2", 0),
        (8, "ÉÀ ß 漢字かな 𝒳𝒴 naïve café " + words(3, 30), "fr", "sé", 0),
        (9, "x" * 50000, "en", "s1", 50000),
        (None, words(4, 40), "en", "s1", 1),
        (None, None, None, None, None),
        (10, "the same line of seven words here\n" + words(5, 30), "en", "s2", 1),
        (11, "!!! ??? ...", "en", "s2", 11),
    ]
    return rows


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df):
    """With extra columns that operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("key", "node", "size", "target", "slot", "spans", "items", "template", "score", "fold", "uid", "base", "n", "host", "path", "text_key", "dropped", "first", "own", "minima", "label", "mixture", "lang_pred", "line_dedup"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("extra"))
    return df
