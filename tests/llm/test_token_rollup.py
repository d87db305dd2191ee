import re

import pytest

from paperloom.llm import token_rollup

from .fixtures import clashing, frame, odd_documents, words

CHANGES = "kind string, source string, lang string, tokenizer string, n_tokens long, before long"


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_deltas_and_idempotence(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path))
    assert totals(store) == {}
    one = spark.createDataFrame([("insert", "a", "en", "t", 5, None), ("insert", "a", "en", "t", 7, None), ("insert", None, None, "t", None, None)], CHANGES)
    assert store.commit("1", one) and not store.commit("1", one)
    assert totals(store) == {("a", "en", "t"): (2, 12), (None, None, "t"): (1, 0)}
    assert store.commit("2", spark.createDataFrame([("revise", "a", "en", "t", 9, 7), ("delete", "a", "en", "t", 5, None), ("insert", "b", "en", "t", 3, None)], CHANGES))
    assert totals(store) == {("a", "en", "t"): (1, 9), ("b", "en", "t"): (1, 3), (None, None, "t"): (1, 0)}
    before = totals(store)
    store.compact()
    assert totals(store) == before and not store.commit("2", one)
    assert store.commit("3", spark.createDataFrame([], CHANGES)) and totals(store) == before
    store.compact()
    assert totals(store) == before


def test_compact_with_long_names_and_a_commit_meanwhile(spark, tmp_path, monkeypatch):
    store = token_rollup.Rollup(spark, f"{tmp_path}/{'long' * 50}")
    one = spark.createDataFrame([("insert", "a", "en", "t", 5, None)], CHANGES)
    name = "b" * 1000
    assert store.commit(name, one) and store.commit("other", one)
    summed = token_rollup.Rollup._summed

    def late(self, live):
        monkeypatch.undo()
        assert store.commit("late", one)
        return summed(self, live)

    monkeypatch.setattr(token_rollup.Rollup, "_summed", late)
    store.compact()
    assert totals(store) == {("a", "en", "t"): (3, 15)} and store.batches().count() == 2
    for _ in range(3):
        assert not store.commit(name, one) and not store.commit("late", one) and not store.commit("other", one)
        store.compact()
        assert totals(store) == {("a", "en", "t"): (3, 15)} and store.batches().count() == 1
    # A compact that wrote its marker and fell over before the old ones went.
    assert store.commit("new", one)
    monkeypatch.setattr(token_rollup.Rollup, "_marker", lambda self, batch: f"{self.path}/commits/{batch[:7]}")
    store._mark("new", [c for c in store._live() if c["batch"] == "new"][0]["data"], [])
    store.compact()
    monkeypatch.undo()
    assert totals(store) == {("a", "en", "t"): (4, 20)}


def test_a_batch_that_fell_over_leaves_nothing(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path))
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("1", spark.createDataFrame([("insert", "a", "en", "t", 5, None), ("drop", "a", "en", "t", 5, None)], CHANGES))
    assert totals(store) == {}
    assert store.commit("1", spark.createDataFrame([("insert", "a", "en", "t", 5, None)], CHANGES))
    assert totals(store) == {("a", "en", "t"): (1, 5)}


def test_counts_against_the_library(spark):
    rows = odd_documents()
    count = token_rollup.encoder(f"{token_rollup.VOCABULARY}/byte_bpe_50k.tiktoken").encode_ordinary
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_rollup.with_counts(frame(spark, rows)).collect())
    assert got == sorted((r[0] or -1, len(count(r[1] or ""))) for r in rows)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(k, words(k % 30, 20) + " !!", ("en", "de")[k % 2], f"s{k % 3}" if k % 5 else None, 1) for k in range(80)] + odd_documents()
    clashing(frame(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup.query(spark, str(tmp_path)).collect()}
    count = token_rollup.encoder(f"{token_rollup.VOCABULARY}/byte_bpe_50k.tiktoken").encode_ordinary
    first = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            first[r[1]] = min(first.get(r[1], r[0]), r[0])
    want = {}
    for doc_id, text, lang, source, _ in rows:
        gone = text is not None and doc_id is not None and doc_id > first[text]
        pieces = len(count(text or ""))
        plain = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        real = sum(any(c.isalpha() or c.isnumeric() for c in w) for w in plain)
        for name, n in (("byte_bpe_50k@1", pieces), ("words@1", real)):
            x = want.setdefault((source, lang, name), [0, 0])
            if not gone:
                x[0] += 1
                x[1] += n
    assert got == {k: tuple(v) for k, v in want.items()}


def test_query_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert token_rollup.query(spark, str(tmp_path)).collect() == []
