"""Every registered query of the library runs on the smallest tables, and agrees with its SQL."""

import hashlib

import duckdb
import pandas
import pytest

from paperloom.plans import catalog

catalog.load()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def sql(sf):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return db


def plain(frame):
    def one(v):
        if v is None or v is pandas.NA or v != v:
            return ""
        return str(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, sql, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLES:
        want = sql.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_page_titles_equal_their_sql_with_character_references(spark, tmp_path):
    titles = ["Pour. token = &quot;a5a6b8714a&quot;", "Salt &amp; pepper for all", "Salt &amp pepper &amp;quot; all", "caf&eacute; of &#65;&#x42; town", "one &lt;b&gt; three;", " two\n  lines of it. ", "", "Unknown"]
    pages = [(k, f"<html><title>{t}</title><p>&quot;</p></html>") for k, t in enumerate(titles)] + [(98, "<p>no title</p>"), (99, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, catalog.QUERIES["page_titles"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(catalog.ORACLES["page_titles"]).fetchall())
    assert got[0] == (0, "Pour. token = &quot;a5a6b8714a&quot", True) and got[1] == (1, "Salt & pepper for all", True)


def test_noise_removed_equals_its_sql_with_character_references(spark, tmp_path):
    texts = ["token = &quot;a5&quot and &QUOT;", "&copy; &copy &middot; &middot &amp; &amp &ampx &amp;quot; &amp;copy;", "caf&eacute; &#65;&#x42; a&nbsp;b &lt;p&gt;", "![a&quot;\n](b) GLYPH<12>GLYPH<x> ![x]", " a\t\f\r\n b ", "a\x0bb\x1cc\x85d\xa0e\u2003f\u3000", "\xa0 a \x0b", "", " ", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, catalog.QUERIES["noise_removed"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(catalog.ORACLES["noise_removed"]).fetchall())
    assert got[0][1] == hashlib.md5(b'token = "a5&quot and &QUOT;').hexdigest()
