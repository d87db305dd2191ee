"""Operators on small literal tables, against plain Python or known values."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import answering, bm25, chunking, classify, fusion, hierarchy, metadata, metrics, store, terms, vectors

HITS = "q string, c string, score double, rank int"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize(("scores", "want"), [([0.9, 0.4], 0.35), ([0.29, 0.1], 0.232), ([0.31], 0.35)])
def test_adaptive_threshold(spark, scores, want):
    hits = spark.createDataFrame([("q", f"c{k}", s, k + 1) for k, s in enumerate(scores)], HITS)
    assert round(fusion.above_threshold(hits, "q", "score", "rank").first()["threshold"], 6) == want
    assert spark.range(1).select(fusion.adaptive_threshold(F.lit(None).cast("double")).alias("x")).first()["x"] == 0.35


def test_threshold_keeps_two(spark):
    hits = spark.createDataFrame([("q", "a", 0.5, 1), ("q", "b", 0.1, 2), ("q", "c", 0.05, 3), ("p", "a", 0.9, 1), ("p", "b", 0.8, 2), ("p", "c", 0.2, 3)], HITS)
    assert rows(fusion.above_threshold(hits, "q", "score", "rank").select("q", "c"), "q", "c") == [("p", "a"), ("p", "b"), ("q", "a"), ("q", "b")]


def test_near_duplicates(spark):
    texts = [("q", "1", "a b c d e f g h i j", 1), ("q", "2", "a b c d e f g h x y", 2), ("q", "3", "p q r", 3), ("r", "1", "", 1), ("r", "2", " ", 2)]
    hits = spark.createDataFrame(texts, "q string, c string, text string, rank int")
    assert rows(fusion.thin_near_duplicates(hits, "q", "c", "text", "rank"), "q", "c") == [("q", "1", 1), ("q", "3", 3), ("r", "1", 1)]


def test_near_duplicates_by_fold(spark):
    rng = random.Random(5)
    data = [(f"q{q}", f"{k:02d}", " ".join(rng.choices("abcdef", k=rng.randint(1, 6))), k) for q in range(6) for k in range(12)]
    want = []
    for q in range(6):
        kept = []
        for key, c, text, k in (d for d in data if d[0] == f"q{q}"):
            own = set(text.split())
            if all(len(own & x) / len(own | x) <= 0.6 for x in kept):
                kept.append(own)
                want.append((key, c, k))
    hits = spark.createDataFrame(data, "q string, c string, text string, rank int")
    assert rows(fusion.thin_near_duplicates(hits, "q", "c", "text", "rank"), "q", "c") == want


def test_unlabeled(spark):
    data = [("few", "a", "Unlabeled Section"), ("few", "b", "Intro"), ("half", "a", "Unlabeled Section"), ("half", "b", "Intro"), ("most", "a", "Unlabeled Section"), ("most", "b", "Unlabeled Section"), ("most", "c", None)]
    got = fusion.without_unlabeled(spark.createDataFrame(data, "q string, c string, title string"), "q", "title")
    assert rows(got.select("q", "c"), "q", "c") == [("few", "b"), ("half", "b"), ("most", "a"), ("most", "b"), ("most", "c")]


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 9.0, 1), ("q", "y", 8.0, 2)], HITS)
    b = spark.createDataFrame([("q", "y", 1.0, 1), ("q", "z", 0.5, 2)], HITS)
    got = rows(fusion.reciprocal_rank_fusion([a, b], "q", "c", 10).select("c", "score", "rank"), "rank")
    assert got == [("y", round(1 / 62 + 1 / 61, 6), 1), ("x", round(1 / 61, 6), 2), ("z", round(1 / 62, 6), 3)]


def test_fallback_and_rerank(spark):
    scoped = spark.createDataFrame([("a", "1", 0.9, 1), ("b", "1", 0.9, 1), ("b", "2", 0.8, 2), ("b", "3", 0.7, 3)], HITS)
    wider = spark.createDataFrame([("a", "1", 0.95, 1), ("a", "4", 0.2, 2), ("b", "5", 0.9, 1), ("c", "6", 0.1, 1)], HITS)
    got = fusion.with_fallback(scoped, wider, "q", "c")
    assert rows(got.select("q", "c", "score"), "q", "c") == [("a", "1", 0.95), ("a", "4", 0.2), ("b", "1", 0.9), ("b", "2", 0.8), ("b", "3", 0.7), ("c", "6", 0.1)]
    again = fusion.rerank(scoped, "q", -F.col("score"), 20, cap=2)
    assert rows(again.filter("q = 'b'").select("c", "rank", "retrieval_rank"), "rank") == [("3", 1, 3), ("2", 2, 2)]
    changed = fusion.rank_changes(scoped, again, "q", "c").filter("q = 'b' and c = '3'").first()
    assert (changed["rank_before"], changed["rank_after"]) == (3, 1)


def test_metrics(spark):
    run = [("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "x", 1)]
    relevant = [("q", "b"), ("q", "c"), ("q", "z"), ("s", "k")]
    got = {r["q"]: r for r in metrics.per_question(spark.createDataFrame(run, "q string, c string, rank int"), spark.createDataFrame(relevant, "q string, c string"), "q", "c").collect()}
    assert got["q"]["precision_at_2"] == 0.5 and got["q"]["precision_at_5"] == 0.4
    assert got["q"]["recall_at_3"] == round(2 / 3, 6) and got["q"]["reciprocal_rank"] == 0.5
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert got["q"]["ndcg_at_10"] == round((1 / math.log2(3) + 1 / 2) / ideal, 6)
    assert [got["r"][m] for m in ("precision_at_2", "recall_at_3", "reciprocal_rank", "ndcg_at_10")] == [0, 0, 0, 0]
    assert got["s"]["recall_at_5"] == 0 and metrics.means(spark.createDataFrame([], "q string, recall_at_3 double")).first()["n"] == 0


def test_failures(spark):
    data = [(True, True, True), (True, True, False), (True, False, False), (False, False, False)]
    got = spark.createDataFrame(data, "a boolean, b boolean, c boolean").select(metrics.failure(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == ["ok", "rerank", "filter", "recall"]


def test_bm25_by_hand(spark):
    docs = [(1, "red fox red"), (2, "blue fox"), (3, ""), (4, None)]
    indexed = bm25.index(spark.createDataFrame(docs, "d long, text string"), "d")
    got = {(r["d"], r["term"]): r["weight"] for r in indexed.collect()}
    idf = math.log((4 - 1 + 0.5) / (1 + 0.5) + 1)
    assert abs(got[1, "red"] - idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.25))) < 1e-9
    asked = spark.createDataFrame([(7, "Red, red fox?"), (8, "none of these")], "i long, text string")
    found = bm25.search(indexed, "d", asked, "i", 5)
    assert rows(found.select("i", "d", "rank"), "rank") == [(7, 1, 1), (7, 2, 2)]


def test_bm25_on_asked_terms(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(12)))) for k in range(80)] + [(99, None)], "d long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "c z"), (3, "z"), (4, "h h g")], "i long, text string")
    want = [rows(bm25.search(bm25.index(docs, "d"), "d", asked, "i", 9, squared_idf=s), "i", "rank") for s in (False, True)]
    for most in (bm25.BROADCAST_TERMS, 1):
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", most)
        assert [rows(x, "i", "rank") for x in bm25.search_texts(docs, "d", asked, "i", 9, (False, True))] == want


def test_cosine_blocks(spark, monkeypatch):
    rng = random.Random(2)
    data = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    got = rows(vectors.cosine_topk(df, df.filter("vec_id % 6 = 0"), 3).select("query_id", "vec_id"), "query_id", "rank")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) if any(b) and any(a) else 0.0
    plain = [(i, [float(x) for x in r["embedding"]]) for r in df.collect() if r["embedding"] for i in [r["vec_id"]]]
    for q, v in plain:
        if q % 6 == 0:
            best = sorted(((-round(cos(v, w), 6), i) for i, w in plain if i != q))[:3]
            assert [i for a, i in got if a == q] == [i for _, i in best]


SECTIONS = "document_id long, idx long, level int, title string, numbering string, page long"


def tree(levels, document=1):
    return [(document, k, n, f"t{k}", None, k // 2) for k, n in enumerate(levels)]


def stacked(levels):
    stack, out = [], {}
    for k, n in enumerate(levels):
        while stack and levels[stack[-1]] >= n:
            stack.pop()
        out[k] = list(stack)
        stack.append(k)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=30))
def test_ancestors_against_a_stack(spark, levels):
    got = hierarchy.with_ancestors(spark.createDataFrame(tree(levels), SECTIONS)).collect()
    assert {r["idx"]: r["ancestors"] for r in got} == stacked(levels)


def test_paths_children_leaves(spark):
    df = spark.createDataFrame(tree([1, 2, 3, 2, 1, 3]) + tree([2, 1], 2), SECTIONS)
    assert rows(hierarchy.paths(df).filter("document_id = 1"), "idx") == [(1, 0, ["t0"]), (1, 1, ["t0", "t1"]), (1, 2, ["t0", "t1", "t2"]), (1, 3, ["t0", "t3"]), (1, 4, ["t4"]), (1, 5, ["t4", "t5"])]
    assert rows(hierarchy.leaves(df).select("document_id", "idx"), "document_id", "idx") == [(1, 2), (1, 3), (1, 5), (2, 0), (2, 1)]
    assert rows(hierarchy.children(df), "parent_idx") == [(1, 0, 2, 1, 3), (1, 1, 1, 2, 2), (1, 4, 1, 5, 5)]
    assert rows(hierarchy.descendants(df).filter("ancestor = 0 and document_id = 1").select("idx", "distance"), "idx") == [(1, 1), (2, 2), (3, 1)]


def test_pages(spark):
    df = spark.createDataFrame([(1, k, 1, "t", None, p) for k, p in enumerate([1, 1, 4, 4])], SECTIONS)
    assert rows(hierarchy.page_end(df).select("idx", "page_end", "next_start"), "idx") == [(0, 3, 1), (1, 3, 4), (2, 4, 4), (3, None, None)]
    pages = hierarchy.pages_of(spark.createDataFrame([(1, 5)], "document_id long, n_pages int"), df)
    assert rows(pages.select("page", "idx"), "page") == [(1, 1), (2, 1), (3, 1), (4, 3), (5, 3)]


def test_asof_in_parts(spark):
    rng = random.Random(8)
    left = [(rng.randrange(4), rng.randrange(100), k) for k in range(200)]
    right = [(rng.randrange(3), rng.randrange(100), k) for k in range(40)]
    a, b = spark.createDataFrame(left, "k int, at int, id int"), spark.createDataFrame(right, "k int, at int, v int")
    want = sorted((i, max(((t, v) for q, t, v in right if q == k and t <= at), default=(0, None))[1]) for k, at, i in left)
    for part in (None, F.floor(F.col("at") / 7)):
        assert rows(hierarchy.asof(a, b, ["k"], "at", "v", part).select("id", "v"), "id") == want


def test_carried_and_references(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None), (1, 3, "b"), (2, 0, None)], "document_id long, idx long, h string")
    assert rows(hierarchy.carried(df, "document_id", "idx", F.col("h")).select("document_id", "idx", "carried"), "document_id", "idx") == [(1, 0, None), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 0, None)]
    text = "Body.\nReferences\n[1] A long enough entry of the\nlist goes on here\n2. Another entry, long enough too\nx"
    got = metadata.reference_entries(spark.createDataFrame([(1, text), (2, "none")], "d long, text string"), "d")
    assert [r["entry"] for r in got.orderBy("n").collect()] == ["[1] A long enough entry of the list goes on here", "2. Another entry, long enough too x"]


def test_labels(spark):
    sections = spark.createDataFrame([(1, 0, 1, "Introduction", "1", 0), (1, 1, 1, "Related Work", "2", 1), (1, 2, 2, "Data sets", "2.1", 2)], SECTIONS)
    labels = spark.createDataFrame([(1, "2 related work"), (1, "introduction"), (1, "2.1"), (1, "2.1 other"), (1, "data"), (1, "none")], "document_id long, label string")
    got = {r["label"]: (r["idx"], r["how"]) for r in hierarchy.resolve_labels(labels, sections).collect()}
    assert got == {"2 related work": (1, 0), "introduction": (0, 1), "2.1": (2, 2), "2.1 other": (2, 3), "data": (2, 4)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=12), max_size=25), st.integers(4, 30), st.integers(0, 10))
def test_windows(sentences, size, overlap):
    text = " ".join(" ".join(s) + "." for s in sentences)
    got = chunking.windows(text, size, overlap)
    words_in = text.split()
    assert all(chunking.estimate(w) <= size for w in got if len(w.split()) > 1)
    at = 0
    for w in got:  # every window goes on from the one before, or repeats its end
        own = w.split()
        assert any(words_in[b : b + len(own)] == own for b in range(at + 1))
        begin = max(b for b in range(at + 1) if words_in[b : b + len(own)] == own)
        assert begin + len(own) > at or not own
        at = max(at, begin + len(own))
    assert at == len(words_in)


def test_chunks(spark):
    text = " ".join(f"Sentence number {k} has some words in it." for k in range(200))
    got = chunking.split_windows(spark.createDataFrame([(1, text), (2, "short."), (3, None)], "d long, text string"), "d").collect()
    assert {r["d"] for r in got} == {1} and [r["chunk_index"] for r in got] == list(range(len(got)))
    assert {r["chunk_level"] for r in got} == {"fine", "coarse"} and all(r["n_chars"] >= 80 for r in got)


def test_terms(spark):
    docs = spark.createDataFrame([(1, "Graph Neural Network (GNN) and NLP. THE GNN of Ada Lovelace, Ada Lovelace"), (2, "ÉTAT XY"), (3, None)], "d long, text string")
    assert rows(terms.acronyms(docs, "d"), "d", "term") == [(1, "GNN", "Graph Neural Network"), (1, "NLP", None), (2, "XY", None)]
    assert rows(terms.phrases(docs, "d"), "d", "term") == [(1, "Ada Lovelace"), (1, "Graph Neural Network")]
    both = terms.merged([terms.acronyms(docs, "d"), spark.createDataFrame([(1, "gnn"), (1, "Ada Lovelace")], "d long, term string")], "d")
    assert rows(both.filter("d = 1").select("term", "expansion"), "term") == [("Ada Lovelace", None), ("GNN", "Graph Neural Network"), ("NLP", None)]
    scored = {r["term"]: (r["n"], r["score"]) for r in terms.scores(docs, both, "d").collect()}
    assert scored["Ada Lovelace"] == (2, 0.83) and "GNN" not in scored
    spans = terms.spans(docs, "d", terms.PHRASE).collect()
    body = docs.first()["text"]
    assert all(body[r["start"] : r["end"]] == r["term"] for r in spans) and len(spans) == 3
    overlapping = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 9, "b"), (1, 8, 12, "c"), (1, 9, 10, "d")], "d long, start int, end int, term string")
    assert rows(terms.without_overlaps(overlapping, "d").select("term"), "term") == [("b",), ("d",)]
    said = [("A graph, which is a set of nodes\n and edges. More.", "Graph"), ("A graph which is big. The graph (a set of nodes)", "graph"), ("C++ (a+b) refers to a language of systems.", "C++"), ("graph: too short.", "graph"), ("a.b refers to something else.", "axb"), ("a\\Eb refers to something else.", "a\\Eb"), ("x", None)]
    got = spark.createDataFrame(said, "s string, t string").select(terms.inline_definition(F.col("s"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == ["a set of nodes and edges", "a set of nodes", None, None, None, "something else", None]


def test_store(spark):
    papers = spark.createDataFrame([("h1", "Alpha"), ("h2", "Beta")], "h string, name string")
    new = spark.createDataFrame([("h1", "Gamma", 1), ("h3", "ALPHA", 2), ("h4", "Delta", 3), ("h4", "Eta", 4), ("h5", "delta", 5)], "h string, name string, pos int")
    assert rows(store.insert_new(papers, new, "h", "name", "pos").select("h", "name")) == [("h4", "Delta")]
    links = spark.createDataFrame([("p1", "u1"), ("p1", "u2"), ("p2", "u1")], "p string, u string")
    left, orphans = store.unlink(links, spark.createDataFrame([("p1", "u1"), ("p2", "u1")], "p string, u string"), "p", "u")
    assert rows(left) == [("p1", "u2")] and rows(orphans) == [("p2",)]
    assert rows(store.upsert(papers, spark.createDataFrame([("h2", "New"), ("h9", "More")], "h string, name string"), ["h"]), "h") == [("h1", "Alpha"), ("h2", "New"), ("h9", "More")]
    hits = spark.createDataFrame([("q", 1, "Intro", "one"), ("q", 2, "References", "no"), ("q", 3, "End", " "), ("q", 4, None, "two")], "q string, rank int, title string, text string")
    assert store.numbered_context(hits, "q", "rank", "title", "text").first()["context"] == "[1] (Section: Intro)\none\n\n[2] (Section: )\ntwo"
    steps = spark.createDataFrame([(1, 1, "Intro", "read"), (1, 2, "intro ", "read"), (1, 3, "Intro", "Compare both"), (2, 1, "Intro", None)], "d int, n int, t string, o string")
    assert rows(store.prune_repeats(steps, "d", ["n"], "t", F.col("o")).select("d", "n"), "d", "n") == [(1, 1), (1, 3), (2, 1)]


def test_readability_and_fields(spark):
    pages = spark.createDataFrame([(1, "x" * 600), (1, "y" * 60), (2, ""), (2, None), (3, "z" * 500), (3, "few")], "d int, text string")
    assert rows(metadata.readability(pages, "d").select("d", "readability", "needs_ocr"), "d") == [(1, "digital", False), (2, "scanned", True), (3, "hybrid", True)]
    row = spark.createDataFrame([("t", None, " ")], "a string, b string, c string").select(metadata.missing_fields(["a", "b", "c"]).alias("x")).first()["x"]
    assert row == ["b", "c"]
    long = "We show that all of it holds for every graph there is"
    texts = [f"# T\n# Abstract\n{long}.\n# Intro\nMore", f"T\nABSTRACT: {long}. Keywords: a, b\n\nx", f"A B S T R A C T\n{long}\n1. Start", f"T\n\n## Abstract\n\n{long}\n\nIntroduction\n\nno", f"{long}\n\nSecond one.\n\n1 Introduction\n\nno", "Short one.", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(metadata.abstract(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [long, long, f"{long} 1. Start", f"{long} Introduction no", f"{long} Second one", "", "", ""]
    many = "\n\n".join(f"{k} " + "w" * 700 for k in range(9))
    assert spark.createDataFrame([(many,)], "t string").select(metadata.abstract(F.col("t")).alias("x")).first()["x"] == " ".join(f"{k} " + "w" * 700 for k in range(3))


def test_classifier(spark):
    good = [(k, "clear prose about rivers and hills " * 3, 1) for k in range(30)]
    bad = [(100 + k, "### $$$ junk %% spam click " * 3, 0) for k in range(30)]
    df = spark.createDataFrame(good + bad, "d long, text string, y int")
    got = classify.predict(classify.fit(df.filter("d % 3 <> 0"), "y"), df.filter("d % 3 = 0"), "d").collect()
    assert all(r["label"] == (r["d"] < 100) for r in got) and all(len(r["top"]) == 2 and r["probability"] >= 0.5 for r in got)


def test_terms_are_counted_in_one_pass(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choices("abA ", k=400)) for _ in range(20)] + ["", None, "aaaa"]
    words = ["a", "aa", "ab", "aba", "b", "a b", "zz", "AA"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    candidates = spark.createDataFrame([(d, w) for d in range(len(texts)) for w in words], "d long, term string")
    got = {(r.d, r.t): r.n for r in docs.join(candidates, "d").groupBy("d", "text").agg(F.collect_list(F.lower("term")).alias("c")).select("d", F.explode(F.arrays_zip("c", terms.occurrences(F.lower("text"), F.col("c")))).alias("x")).select("d", F.col("x.c").alias("t"), F.col("x.1").alias("n")).collect()}
    assert got == {(d, w.lower()): (t or "").lower().count(w.lower()) for d, t in enumerate(texts) for w in words}


def test_bundle_terms(spark):
    rows_in = [
        (1, 0, "abstract", "Graph", 0.7, None, None), (1, 1, "introduction", "graph", 0.7, None, None), (1, 2, "introduction", "GRAPH", 0.64, None, None),
        (1, 0, "abstract", "Node", 0.65, None, None), (1, 1, "introduction", "Node", 0.9, "a thing", "dbpedia"),
        (1, 1, "introduction", "Tree", 0.8, "x", "llm"), (1, 0, "abstract", "Weak", 0.6, "x", "dbpedia"), (1, 1, "introduction", "Else", 0.8, "x", "other"),
    ]
    found = spark.createDataFrame(rows_in, "document_id long, idx long, scope string, term string, score double, definition string, source string")
    got = [(r.term, r.score, r.scopes, r.status, r["rank"]) for r in terms.bundle_terms(found, "document_id").orderBy("rank").collect()]
    assert got == [("Node", 0.9, ["introduction"], "ready", 1), ("Else", 0.8, ["introduction"], "ready", 2), ("Tree", 0.8, ["introduction"], "ready", 3), ("Graph", 0.7, ["abstract", "introduction"], "pending_llm", 4)]


def test_best_title_is_no_numbered_or_usual_heading(spark):
    rows_in = [(1, 0, "1 Introduction to the Learning of Things: A Long Name", 1), (1, 1, "A Plain Study of Graphs", 1), (1, 2, "References and more things here", 1), (2, 0, "Abstract", 1), (3, 0, "Some Title of Three", None), (3, 1, "Other Title of Four", 2)]
    got = {r.d: (r.title, r.score) for r in metadata.best_title(spark.createDataFrame(rows_in, "d long, k long, title string, page long"), "d", "k").collect()}
    assert got == {1: ("A Plain Study of Graphs", 7), 2: ("", None), 3: ("Other Title of Four", 6)}


def test_context_precision_counts_all_that_was_retrieved(spark):
    judged = [("a", True), ("a", False), ("a", None), ("a", None), ("a", None), ("b", None), ("c", False), ("c", None)]
    got = {r.q: r.context_precision for r in answering.context_precision(spark.createDataFrame(judged, "q string, r boolean"), "q", "r").collect()}
    assert got == {"a": 0.2, "b": None, "c": 0.0}


def test_references_neither_raise_the_threshold_nor_stay(spark):
    hits = [("q", "r1", "refs", "References", [], 0.9, 1), ("q", "r2", "more refs", "Part", ["Bibliography", "Part"], 0.8, 2), ("q", "a", "text one", "Intro", ["Intro"], 0.2, 3), ("q", "b", "other words", "Method", None, 0.1, 4), ("q", "c", "third thing", "Method", None, 0.05, 5)]
    frame = spark.createDataFrame(hits, "q string, chunk string, text string, title string, path array<string>, score double, rank int")
    got = answering.select_context(frame, "q", "chunk", "text", "title", 6, path="path").orderBy("rank").collect()
    assert [(r.chunk, r["rank"]) for r in got] == [("a", 1), ("b", 2)]


def test_missing_core_fields(spark):
    rows_in = [("T", "short", ["k"], []), (None, "x" * 50, None, ["s"])]
    df = spark.createDataFrame(rows_in, "t string, a string, k array<string>, s array<string>")
    got = [r[0] for r in df.select(metadata.missing_core_fields(F.col("t"), F.col("a"), F.col("k"), F.col("s"))).collect()]
    assert got == [["abstract", "sections"], ["title", "keywords"]]


def test_chunks_by_a_table_function(spark, sf):
    from paperloom.plans import catalog

    catalog.load()
    by_sql, by_frames = (catalog.QUERIES[q](spark, sf) for q in ("chunk_table", "chunk_windows"))
    assert sorted(by_sql.columns) == sorted(by_frames.columns)
    assert sorted(map(tuple, by_sql.select(by_frames.columns).collect())) == sorted(map(tuple, by_frames.collect()))
    text = " ".join(f"Sentence number {k} has some words in it." for k in range(20))
    spark.createDataFrame([("a", text), ("a", text), ("b", None), (None, "x")], "k string, t string").createOrReplaceTempView("papers_to_cut")
    got = spark.sql("SELECT * FROM chunks(TABLE(papers_to_cut), key => 'k', body => 't', levels => 'all:60:0', least_chars => 1)").collect()
    assert [r.k for r in got if r.k == "a"] == ["a"] * 2 * len(chunking.windows(text, 60, 0)) and [r.content for r in got if r.k is None] == ["x"]
    with pytest.raises(Exception, match="must name columns"):
        spark.sql("SELECT * FROM chunks(TABLE(papers_to_cut), key => 'none', body => 't')")


def test_only_empty_fields_are_filled(spark):
    df = spark.createDataFrame([("", " ", None, [], ["a"])], "t string, b string, n string, k array<string>, l array<string>")
    new = {"t": F.lit("T"), "b": F.lit("B"), "n": F.lit("N"), "k": F.array(F.lit("K")), "l": F.array(F.lit("L"))}
    got = metadata.filled({c: F.col(c) for c in df.columns}, new, ("k", "l"))
    assert tuple(df.select(*[c.alias(k) for k, c in got.items()]).collect()[0]) == ("T", " ", "N", ["K"], ["a"])
    assert metadata.filled({"t": F.col("t")}, {}).keys() == {"t"}


def test_question_hits(spark):
    def asked(q, rows, pinned=False):
        return [(q, f"{q}{k}", score, scoped, leveled, pinned, title, new) for k, (score, scoped, leveled, title, new) in enumerate(rows)]

    plenty = [(float(-k), True, True, "A", float(k)) for k in range(30)]  # the best 20 in scope, then the best 12 anew
    few = [(9.0, True, True, "A", 1.0), (8.0, False, True, "References", 5.0), (7.0, False, False, "A", 9.0), *[(float(-k), False, True, "A", 0.0) for k in range(9)]]
    kept = asked("p", few, True)
    old = [(5.0, True, False, "A", 1.0), (4.0, False, False, "A", 2.0)]
    rows_in = asked("a", plenty) + asked("b", few) + kept + asked("c", old) + asked("d", old, True)
    df = spark.createDataFrame(rows_in, "q string, c string, score double, scoped boolean, leveled boolean, pinned boolean, title string, new double")
    got = {}
    for r in answering.question_hits(df, "q", "c", F.col("new"), "title").orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.c, r["rank"]))
    assert got["a"] == [(f"a{k}", 20 - k) for k in range(19, 7, -1)]
    assert got["b"] == [("b0", 2), *[(f"b{k}", k) for k in range(3, 9)]]  # b1 was first, and a reference
    assert got["p"] == [("p0", 1)] and got["c"] == [("c1", 1), ("c0", 2)] and got["d"] == [("d0", 1)]
