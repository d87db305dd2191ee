import hashlib
import random

import pytest
from tokenizers import Regex, pre_tokenizers

from paperloom.llm import infill

from .fixtures import clashing, frame, odd_documents, words


def units(text):
    out, now = [], ""
    for c in text:
        now += c
        if c == "\n":
            out.append(now)
            now = ""
    return out + ([now] if now else [])


def brute(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * j : 8 * j + 8], 16) for j in range(4))
    parts = units(text)
    n = len(parts)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(3)
    out = [(r[0], r[1]) for r in odd_documents()]
    for k in range(60):
        lines = ["".join(rng.choices("ab \r\t𝒳é<>PSM\x0b\x85 ", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        out.append((100 + k, "\n".join(lines) + rng.choice(["", "\n"])))
    out += [(200, "a<P>b\nc"), (201, "a\n<S"), (202, "<M>"), (203, "\n"), (204, "<\n>\n<P\n>"), (205, "x\n" * 100000 + "y" * 200000 + "\n" + words(1, 50))]
    return out


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_equals_plain_python(spark, rate, spm_rate):
    rows = texts()
    done = infill.cut(frame(spark, rows, "doc_id long, text string"), rate=rate, spm_rate=spm_rate)
    done = done.withColumn("back", infill.restored(done["infill.output"], done["infill.form"]))
    got = sorted(((r.doc_id, r.text, *r.infill) for r in done.collect()), key=repr)
    assert got == sorted(((i, t, *brute(i, t, rate=rate, spm_rate=spm_rate)) for i, t in rows), key=repr)
    assert all(r.back == (r.text or "") for r in done.collect())


def test_other_units(spark):
    done = infill.cut(frame(spark, [(1, "one two  three"), (2, "one")], "doc_id long, text string"), pattern=r"\s+|\S+").collect()
    assert sorted((r.doc_id, r.infill.n) for r in done) == [(1, 5), (2, 1)]


def test_blocks_give_the_same_places():
    split = pre_tokenizers.Split(Regex(infill.LINE), behavior="isolated")
    rng = random.Random(4)
    text = "".join("é" * rng.choice([0, 1, 50, 70000]) + "\n" for _ in range(300)) + "end"
    want = [end for _, (_, end) in split.pre_tokenize_str(text)]
    assert infill.unit_ends(text, split) == want


def test_clashing_columns_stay(spark):
    docs = clashing(frame(spark, odd_documents())).withColumnRenamed("own", "infill").withColumnRenamed("base", "form")
    done = infill.cut(docs)
    assert sorted(done.columns) == sorted(docs.columns)
    for r in done.collect():
        assert r.infill.output == brute(r.doc_id, r.text)[-1] and r.form == "extra" and r.n == "extra"


def test_no_rows(spark):
    assert infill.cut(frame(spark, [], "doc_id long, text string")).count() == 0


def test_query_equals_its_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = db.execute(infill.ORACLE)
    columns = [c[0] for c in want.description]
    got = infill.query(spark, sf)
    assert got.columns == columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert got.filter("output_sha256 = restored_sha256 and form <> 'plain'").count() == 0
