import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import phrases

from .fixtures import clashing, frame, odd_documents


def plain_pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
        found = re.findall(r"[^\x20\x09]+", piece)
        if found:
            yield found


def brute(rows, longest=5, least=100, most=2000, inside=(100, 100)):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in plain_pieces(text):
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, a in candidates.items():
        for k in range(2, len(p) - 1):
            gone |= {q for i in range(1, len(p) - k + 1) if inside[0] * a >= inside[1] * f[q := (p[0], *p[i : i + k])]}
    out = defaultdict(list)
    for p, a in candidates.items():
        if p in gone:
            continue
        score, _, left, right = min((1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p)))
        out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((x, k, p.decode(), -a, left, right, n[x], -s) for x, some in out.items() for k, (s, a, p, left, right) in enumerate(sorted(some)[:most], 1))


def made(seed=1, n=120):
    rng = random.Random(seed)
    stems = ["ab", "Cd", "é", "EF", "漢字", "g", "h"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(stems) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r", " \x0b ", "\x1c "]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows + [("en", "ab ab ab ab ab ab ab"), ("en", None), (None, None), ("en", " \t\n")] * 3


def mined(spark, rows, **options):
    got = phrases.mine(frame(spark, rows, "lang string, text string"), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("options", [{"least": 4}, {"least": 300, "longest": 3}, {"least": 9, "most": 5, "inside": (100, 70)}], ids=str)
def test_equals_plain_python(spark, options):
    rows = made()
    want = brute(rows, **options)
    assert mined(spark, rows, **options) == want
    assert want or options["least"] == 300


def test_crowded_maps_prune_less_with_the_same_result(spark, monkeypatch):
    rows = made(2)
    monkeypatch.setattr(phrases, "LEAST_BITS", phrases.SLOT)
    monkeypatch.setattr(phrases, "MOST_BITS", phrases.SLOT)
    monkeypatch.setattr(phrases, "_bits", lambda size: phrases.SLOT)
    rows += [("en", f"w{k} x{k} y{k}") for k in range(6000)]
    assert mined(spark, rows, least=5) == brute(rows, least=5)


def test_pruned_before_counting(spark):
    texts = frame(spark, [("en", "a b c. " * 9 + "a c. b a. " + "d e. " * 2)], "lang string, text string")
    words = texts.sparkSession.createDataFrame([("en", x) for x in "abc"], "lang string, phrase string")
    known = phrases.known_bits(words, 1, 16)
    first = phrases.counts(texts, 1, 5, 16, None, None, True)
    buckets = phrases.full_buckets(first.filter("slot is not null").select("slot", "tally"), 16, 5)
    second = phrases.counts(texts, 2, 5, 16, known, buckets, True).filter("phrase is not null")
    assert sorted((r.phrase, r.n) for r in second.collect()) == [("a b", 9), ("b c", 9)]


def test_chunks_cut_between_pieces(spark):
    import pyarrow as pa

    texts = ["a b c. d e", "f", None, "g h. " * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y"]), pa.array(texts)], names=["lang", "text"])
    some = list(phrases.chunks(iter([batch, batch]), most=12))
    assert sum(map(len, some)) == 2 * (6 + 18) and len(some) >= 6 and all(len(x) <= 12 for x in some)


def test_words_of_one_hash_are_told_apart(spark):
    import numpy as np

    some = phrases.Words([b"ab cd  ab\nef ab"], ["x"])
    assert [some.data[b:e] for b, e in zip(some.start, some.end, strict=True)] == [b"ab", b"cd", b"ab", b"ef", b"ab"]
    want = some.numbers(np.arange(5)).tolist()
    assert [w == want[0] for w in want] == [True, False, True, False, True] and len(set(want)) == 3
    some.hash = np.zeros(5, dtype=np.uint64)
    assert some.numbers(np.arange(5)).tolist() == [0, 1, 0, 2, 0]
    langs, found, n = some.counted(np.array([0, 1]), 2)
    assert sorted(zip(found.to_pylist(), n.to_pylist(), strict=True)) == [("ab cd", 1), ("cd ab", 1)]


def test_products_beyond_64_bits(spark):
    a, n, left, right = 10**14 + 7, 10**16 + 3, 10**15 + 9, 10**14 + 11
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(phrases.score(*map(F.col, "anlr")).alias("s")).collect()[0]
    assert row.s == 1000 * a * n // (left * right)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_documents() * 3
    docs = clashing(frame(spark, rows)).withColumnRenamed("own", "phrase").withColumnRenamed("label", "slot")
    got = sorted(map(tuple, phrases.mine(docs, least=3).collect()))
    assert got == brute([(r[2], r[1]) for r in rows], least=3) and got


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_hot_keys_without_broadcasts(spark):
    """One word begins half of all phrases, one language has nearly all of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("en", " ".join(f"the w{k}" for k in range(j, j + 30)) + f" w{j}") for j in range(40)] * 3 + [("de", "the w1")] * 4
        assert mined(spark, rows, least=4) == brute(rows, least=4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query_equals_its_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = db.execute(phrases.ORACLE)
    columns = [c[0] for c in want.description]
    got = phrases.query(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
