"""Elements, answers and index writers on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import answering, bm25, chunking, elements, hierarchy, metadata
from paperloom.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_focus_merged_nested(spark):
    blocks = spark.createDataFrame([(1, 0, "Abstract", "a"), (1, 1, "1 Introduction", "b"), (1, 2, "1 Introduction", "b"), (1, 3, "Methods", "c"), (1, 4, "abstract", " ")], "document_id long, idx long, heading string, text string")
    assert rows(elements.focus_blocks(blocks).select("scope", "text", "idx"), "scope") == [("abstract", "a", 0), ("introduction", "b", 1)]
    named = spark.createDataFrame([(1, 0, "Abstraction", "x"), (1, 1, "2. Intro:", " y. The Term here. "), (1, 2, "An abstract introduction", "z")], blocks.schema)
    focus = elements.focus_blocks(named, spark.createDataFrame([(1, " whole one "), (2, "\t")], "document_id long, abstract string"))
    assert rows(focus.select("scope", "text", "idx"), "idx") == [("abstract", "whole one", -1), ("introduction", "y. The Term here.", 1), ("abstract", "z", 2)]
    terms = spark.createDataFrame([(1, " term"), (1, "none"), (1, " "), (2, "term")], "document_id long, term string")
    assert rows(elements.term_contexts(terms, focus), "document_id", "term") == [(1, " ", ""), (1, " term", "The Term here."), (1, "none", "whole one"), (2, "term", "")]
    near = blocks.select("document_id", F.lit(0).alias("section_idx"), "idx", "text").filter("idx < 2")
    tagged = blocks.select("document_id", F.lit(0).alias("section_idx"), "idx", "text").filter("idx in (1, 3)")
    assert elements.merged_texts(near, tagged).first()["section_text"] == "a\n\nb\n\nc"
    leaf = "struct<title:string>"
    for _ in range(3):
        leaf = f"struct<title:string,sections:array<{leaf}>>"
    tree = spark.createDataFrame([("d", [("A", [("A1", [("A1a", [("deep",)])]), (" B ", [])]), ("B", []), ("", [])])], f"document_id string, sections array<{leaf}>")
    flat = elements.nested(tree)
    assert rows(flat.select("path", "title"), "path") == [([0], "A"), ([0, 0], "A1"), ([0, 0, 0], "A1a"), ([0, 0, 0, 0], "deep"), ([0, 1], " B "), ([1], "B"), ([2], "")]
    assert elements.distinct_headings(flat).first()["headings"] == ["A", "A1", "A1a", "deep", "B"]
    assert rows(elements.of_document(blocks, "idx", 3).select("text")) == [("c",)]
    assert rows(elements.first_in_order(blocks, ["document_id"], "idx").select("idx")) == [(0,)]


def test_selection(spark):
    hits = spark.createDataFrame(
        [("q", "1", 0.9, 1, "a b c d", "Intro"), ("q", "2", 0.8, 2, "a b c d", "Intro"), ("q", "3", 0.7, 3, "x y", "References"), ("q", "4", 0.6, 4, "p q r", "Unlabeled Section"), ("q", "5", 0.1, 5, "low", "End"), ("q", "1", 0.5, 6, "a b c d", "Intro")],
        "q string, c string, score double, rank int, text string, title string",
    )
    assert rows(answering.select_context(hits, "q", "c", "text", "title", 3).select("c", "rank"), "rank") == [("1", 1)]
    assert rows(answering.select_context(hits, "q", "c", "text", "title", 3, drop_unlabeled=False).select("c", "rank"), "rank") == [("1", 1), ("4", 2)]
    figure = spark.createDataFrame([("q", "f", 0.95, 1, "figure text", "Intro")], hits.schema)
    assert rows(answering.select_context(hits, "q", "c", "text", "title", 3, visuals=figure).select("c", "rank"), "rank") == [("f", 1), ("1", 2)]
    pins = spark.createDataFrame([("q", "End"), ("r", "End")], "q string, title string")
    assert rows(answering.pinned(hits, pins, "q", "title").select("q", "c", "found"), "q") == [("q", "5", True), ("r", None, False)]
    assert answering.extractive_answer(hits, "q", "rank", "text", most=3).first()["answer"] == "a\n\na"


def test_scopes_types_payloads(spark):
    chunks = spark.createDataFrame([("d", "c1", ["r", "s"], "text", 0), ("d", "c2", ["r"], "table", 1), ("e", "c3", ["r"], "table", 0)], "document_id string, chunk_id string, section_path_ids array<string>, content_type string, chunk_index int")
    asked = spark.createDataFrame([("q", "d", "r"), ("p", "d", "s")], "q string, document_id string, section_id string")
    assert rows(answering.in_scope(chunks, asked, "q").select("q", "chunk_id"), "q", "chunk_id") == [("p", "c1"), ("q", "c1"), ("q", "c2")]
    assert rows(answering.of_type(chunks, asked.select("q", "document_id"), "q", "table", 5).select("q", "chunk_id", "rank"), "q") == [("p", "c2", 1), ("q", "c2", 1)]
    hits = spark.createDataFrame([(1, "old", 0.5), (2, "kept", 0.4)], "id int, title string, score double")
    got = answering.enriched(hits, spark.createDataFrame([(1, "new", 7)], "id int, title string, page int"), "id")
    assert rows(got, "id") == [(1, "new", 0.5, 7), (2, "kept", 0.4, None)]


def test_small_answers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(T.relevance_map(F.lit('so: {"1": true, "2": false, "3": 2, "4": null, "9": true, "x": 1}'), F.lit(4))) == {1: True, 2: False, 3: True, 4: False} and value(T.relevance_map(F.lit("no"), F.lit(2))) == {}
    said = '{"1": "false", "2": "", "3": 0.0, "4": [], "5": [0], "6": {}, "7": {"a": null}, "8": "0", "9": -1}'
    assert value(T.relevance_map(F.lit(said), F.lit(9))) == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: True, 8: True, 9: True}
    assert [value(answering.guide_status(F.lit(s).cast("string"), F.lit(p).cast("string"))) for s, p in ((None, None), (" Failed", "{}"), (None, '{"a": 1}'), (None, "{ }"), ("done", '{"a": 1}'), ("done", "[1]"))] == ["missing", "failed", "ready", "pending", "ready", "pending"]
    step = lambda questions, places, objective, expected: value(answering.step_questions(F.lit(questions).cast("array<string>"), F.lit(places).cast("array<string>"), F.lit(objective).cast("string"), F.lit(expected).cast("string")))
    assert step([" a ", "", "a", "b"], ["S"], "o", None) == ["a", "a"]
    assert step([], ["S", "T"], " o ", "e") == ["What is the main takeaway from S?", "How does S help with: o?"]
    assert step(None, None, " ", "e") == ["What is the main takeaway from this section?", "What should you be able to explain after reading this section?"]
    assert step([" "], [], None, None) == ["What is the main takeaway from this section?"]
    assert value(answering.joined_references(F.array(F.lit(" r1 "), F.lit("r2"), F.lit("r1"), F.lit("")))) == "r1\nr2"
    assert value(answering.is_reference_result(F.lit("A Bibliography"))) and not value(answering.is_reference_result(F.lit(None).cast("string")))
    assert value(answering.is_rate_limit(F.lit("Error 429: Too Many Requests")))
    names = spark.createDataFrame([("pass10_a",), ("Pass2_b",), ("pass2_a",), ("intro",), ("pass3",)], "n string")
    assert rows(answering.passes_in_order(names, "n")) == [("Pass2_b",), ("pass2_a",), ("pass10_a",)]
    assert tuple(answering.listed(spark.createDataFrame([(7,)], "id int")).first()) == (7, "/api/papers/7/pdf", "/api/papers/7/bundle", "/api/cms/papers/7")
    stats = spark.createDataFrame([((["a"], ["b"], [], [], 2),)], "stats struct<text_block_ids:array<string>,table_ids:array<string>,figure_ids:array<string>,formula_ids:array<string>,n:int>")
    assert answering.without_ids(stats).first()["stats"].asDict() == {"n": 2}
    kind = "struct<formula_ids:array<string>,reference_ids:array<string>>"
    deep = spark.createDataFrame([(((["f"], ["r"])), [((["f"], ["r"]), [((["f"], ["r"]),)])])], f"stats {kind}, sections array<struct<stats:{kind},sections:array<struct<stats:{kind}>>>>")
    left = {"stats": {"reference_ids": ["r"]}}
    assert answering.without_ids(deep).first().asDict(True) == left | {"sections": [left | {"sections": [left]}]}
    assert [value(answering.is_rate_limit(F.lit(t))) for t in ("rate_limit_exceeded", "rate_limit", "quota")] == [True, False, False]


def test_pages_elements_bundles(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 one\x0ctwo words")
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/in")

    def extract(content):
        if not content.startswith(b"%PDF-"):
            raise ValueError("no PDF")
        return content.decode().split("\x0c")

    assert rows(readers.scanned_pages(raw, extract).select("page", "text", "word_count"), "page") == [(1, "%PDF-1.7 one", 2), (2, "two words", 2)]
    found = readers.scanned_elements(raw, lambda c: [{"kind": "text", "page": 1, "reading_order": 0, "text": str(len(c)), "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}])
    assert found.count() == 2 and {r["kind"] for r in found.collect()} == {"text"}
    papers = spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "paper_id int, paper_name string")
    got = readers.bundle(papers, {"tables": spark.createDataFrame([(1, "t1"), (2, "t2")], "paper_id int, id string")}, "ALPHA")
    assert rows(got["tables"]) == [(1, "t1")] and got["paper"].count() == 1
    files = spark.createDataFrame([("p", "h1"), ("q", "h2"), ("r", "h3")], "path string, sha256 string")
    cache = spark.createDataFrame([("h1", '{"a": 1}'), ("h2", "{bad")], "sha256 string, payload string")
    assert [(r[0], r[1]) for r in rows(readers.cached(files, cache).select("path", F.col("payload").isNotNull()), "path")] == [("p", True), ("q", False), ("r", False)]


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one"), ("b", "two")], "document_id string, text string")
    hits = spark.createDataFrame([("q", 2, "c2", "two"), ("q", 1, "c1", "one")], "q string, rank int, chunk_id string, content string")
    writers.dataset(spark.createDataFrame([("q", "step 1"), ("r", "step 2")], "q string, step string"), hits, "q", f"{tmp_path}/set")
    lines = [json.loads(x) for p in (tmp_path / "set").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["q"]: x.get("chunk_ids") for x in lines} == {"q": ["c1", "c2"], "r": None}
    writers.artifacts(docs, f"{tmp_path}/art")
    writers.artifacts(docs.filter("document_id = 'a'").withColumn("text", F.lit("new")), f"{tmp_path}/art")
    assert rows(spark.read.json(f"{tmp_path}/art").select("document_id", "text"), "document_id") == [("a", "new"), ("b", "two")]


def test_indexing_in_several_calls_equals_one(spark, tmp_path):
    text = lambda w, n: " ".join(f"Sentence number {k} about {w} has some words in it." for k in range(n))
    docs = spark.createDataFrame([("a", text("apples", 60)), ("b", text("pears", 9)), ("c", text("plums", 30)), (None, text("nobody", 9)), ("d", "")], "document_id string, text string")
    writers.index_documents(docs, f"{tmp_path}/once")
    for ids in ("document_id = 'a'", "document_id in ('a', 'b')", "true", "true"):
        writers.index_documents(docs.filter(ids), f"{tmp_path}/many")
    (spark.createDataFrame([("a", 0, "torn", 1, 1)], "document_id string, chunk_index long, term string, tf long, length int").write.parquet(f"{tmp_path}/many/postings/batch=99999999999999999999-torn"))

    def held(path):
        chunks, postings, stats = readers.chunk_index(spark, path)
        counts = postings.withColumn("chunk", F.concat_ws(":", "document_id", "chunk_index"))
        weights = bm25.weigh(counts, bm25.model(counts, stats), "chunk")
        return sorted(map(str, chunks.collect())), sorted((r["chunk"], r["term"], round(r["weight"], 9)) for r in weights.collect()), stats.first()

    once = held(f"{tmp_path}/once")
    assert once == held(f"{tmp_path}/many") and once[2]["n_docs"] == len(once[0]) > 4
    assert not list(tmp_path.glob("*.new-*"))
    whole = bm25.index(readers.chunk_index(spark, f"{tmp_path}/once")[0].select(F.concat_ws(":", "document_id", "chunk_index").alias("chunk"), F.col("content").alias("text")), "chunk")
    assert sorted((r["chunk"], r["term"], round(r["weight"], 9)) for r in whole.collect()) == once[1]
    writers.index_documents(spark.createDataFrame([("a", text("cherries", 9))], docs.schema), f"{tmp_path}/many", force=True)
    assert {r["content"].count("apples") for r in readers.chunk_index(spark, f"{tmp_path}/many")[0].filter("document_id = 'a'").collect()} == {0}


def test_model_is_loaded_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green grass")], "d long, text string")
    counts, stats = bm25.term_counts(docs, "d"), bm25.statistics(docs)
    writers.bm25_model(bm25.model(counts, stats), stats, f"{tmp_path}/model")
    known = readers.bm25_model(spark, f"{tmp_path}/model")
    weights = lambda df: sorted((r["d"], r["term"], round(r["weight"], 12)) for r in df.collect())
    assert weights(bm25.weigh(counts, known, "d")) == weights(bm25.index(docs, "d"))
    new = bm25.term_counts(spark.createDataFrame([(9, "red unknown")], "d long, text string"), "d")
    assert [x[:2] for x in weights(bm25.weigh(new, known, "d"))] == [(9, "red")]
    assert spark.read.parquet(f"{tmp_path}/model/stats").first().asDict() == {"n_docs": 3, "avgdl": 7 / 3, "k1": 1.5, "b": 0.75}


def test_blocks_find_their_sections(spark):
    sections = spark.createDataFrame([("d", "s1", "1. Methods", 1, 2, 5), ("d", "s2", "Methods", 4, None, 6), ("d", "s3", "Results", 3, 3, 7), ("e", "s4", "Methods", 1, 1, 0)], "document_id string, section_id string, title string, page_start int, page_end int, reading_order int")
    blocks = [("d", 1, "s3", "x", "Methods", 1), ("d", 2, "gone", "methods", None, 9), ("d", 3, None, "2) Results", "Methods", 2), ("d", 4, None, "x", "Methods", 3), ("d", 5, None, "x", "Methods", None), ("d", 6, None, "x", "Other", 1), ("d", 7, None, "Results", "none", 1)]
    got = elements.resolve_blocks(spark.createDataFrame(blocks, "document_id string, id int, section_id string, text string, section_title string, page int"), sections)
    assert {r["id"]: r["resolved_id"] for r in got.collect()} == {1: "s3", 2: "s2", 3: "s1", 4: "s1", 5: "s1", 6: None, 7: "s3"}


def test_titles_that_do_not_match_their_blocks(spark):
    long = "this block has more than twenty four characters"
    chunks = spark.createDataFrame([("d", 1, f"before {long}  after", "2.1 Data", "text"), ("d", 2, f"{long} again", "Other", "text"), ("d", 3, f"{long}", "Other", "table"), ("d", 4, "short", "Other", "text"), ("d", 5, "nothing of any block is in this chunk", "Other", "text")], "document_id string, chunk_id int, content string, section_title string, content_type string")
    blocks = spark.createDataFrame([("d", 0, "short", "Wrong"), ("d", 1, f" {long} ", "DATA"), ("d", 2, long, "Late")], "document_id string, idx int, text string, heading string")
    assert rows(elements.title_mismatches(chunks, blocks)) == [("d", 2, "Other", "DATA")]


def test_paper_properties(spark):
    cases = [(20, 10, 0), (10, 100, 0), (5, 5, 0), (5, 100, 0), (3, 10, 0), (0, 21, 0), (0, 5, 11), (0, 5, 10), (9, 0, 0), (10, 0, 0)]
    got = spark.createDataFrame(cases, "f int, p int, s int").select(metadata.paper_properties(F.col("f"), F.col("p"), F.col("s")).alias("x")).collect()
    assert [tuple(r["x"])[1:] for r in got] == [("advanced", True), ("intermediate", True), ("intermediate", True), ("intermediate", False), ("intermediate", False), ("intermediate", False), ("intermediate", False), ("beginner", False), ("intermediate", False), ("intermediate", True)]
    assert got[0]["x"]["paper_type"] == "theoretical_research" and got[1]["x"]["paper_type"] == "research_article"


def test_reference_blocks(spark):
    split = lambda t: spark.range(1).select(metadata.split_references(F.lit(t)).alias("x")).first()["x"]
    assert split("References:\n\n[1] One.\n\n[2] Two.") == ["[1] One.", "[2] Two."]
    assert split("[1] One\ngoes on\n(2) Two\n3. Three\n4) Four\n- Five\n• Six") == ["[1] One goes on", "(2) Two", "3. Three", "4) Four", "- Five", "• Six"]
    assert split("head\n[1] One") == ["head", "[1] One"]
    assert split(f"{'a' * 31}\n{'b' * 31}") == ["a" * 31, "b" * 31] and split(f"{'a' * 31}\nb") == []
    assert split("[1] One. [2] Two. (3) Three.") == ["[1] One.", "[2] Two.", "(3) Three."] and split("one") == []
    docs = spark.createDataFrame([(1, "See it. BIBLIOGRAPHY\n" + "x" * 25 + "\nshort"), (2, "no such heading"), (3, None), (4, "References")], "d long, text string")
    assert [tuple(r) for r in metadata.reference_entries(docs, "d").collect()] == [(1, 0, "x" * 25)]


def test_visual_and_paper_chunks(spark):
    tables = spark.createDataFrame([("d", "t1", 1, "plain", "|a|", "Cap"), ("d", "t2", 1, "", None, None)], "document_id string, id string, page int, text string, markdown string, caption string")
    assert rows(chunking.table_chunks(tables).select("id", "content")) == [("t1", "Cap\n|a|")]
    figures = spark.createDataFrame([("d", "f1", 1, "![x](y.png) A plot", "y.png"), ("d", "f2", 1, "![x](y.png)", None)], "document_id string, id string, page int, caption string, image_path string")
    assert rows(chunking.figure_chunks(figures).select("id", "content")) == [("f1", "A plot")]
    text = " ".join(f"Sentence number {k} has some words in it." for k in range(100))
    got = chunking.paper_chunks(spark.createDataFrame([("d", "1", text), ("d", "2", text)], "document_id string, numbering string, section_text string"), size=64, overlap=8)
    assert got.select("chunk_id").distinct().count() == got.count() > 20
    payload = spark.createDataFrame([(["A", "B"], "B"), ([], "C")], "section_path array<string>, section_title string")
    assert rows(chunking.payload(payload).select("section_path")) == [(["A", "B"],), (["C"],)]
    bare = spark.createDataFrame([(None, ""), (None, "C"), (["A"], None)], payload.schema)
    assert rows(chunking.payload(bare).select("section_path")) == [([],), (["C"],), (["A"],)]


def test_anchors(spark):
    docs = spark.createDataFrame([("d", "Intro one two Data (x) three End")], "document_id string, text string")
    sections = spark.createDataFrame([("d", 0, "Intro"), ("d", 1, "Data (x)"), ("d", 2, "End"), ("d", 3, "None")], "document_id string, idx long, title string")
    assert rows(hierarchy.anchored_texts(docs, sections).select("idx", "start", "section_text"), "idx") == [(0, 1, "Intro one two "), (1, 15, "Data (x) three "), (2, 30, "End")]
    assert rows(hierarchy.anchored_texts(docs, sections, most=5).select("section_text"), "idx") == [("one t",), ("three",), ("",)]


def test_title_mismatches_of_ten_thousand_blocks(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(10000)]
    texts[5000] = texts[17]
    blocks = [(1, k, t, f"Part {k // 50}" if k % 7 else "") for k, t in enumerate(texts)]
    chunks = [(1, f"c{j}", " ".join(texts[j : j + 10]), f"part {(j + rng.randint(0, 40)) // 50}", "text") for j in range(0, 10000, 40)]
    want = []
    for _, chunk, content, title, _ in chunks:
        first = next((h for _, k, t, h in blocks if len(t) >= 24 and t[:96] in content), "")
        if len(content) >= 24 and first and first.lower() != title.lower():
            want.append((1, chunk, title, first))
    frame = elements.title_mismatches(spark.createDataFrame(chunks, "document_id long, chunk_id string, content string, section_title string, content_type string"), spark.createDataFrame(blocks, "document_id long, idx long, text string, heading string"))
    assert "NestedLoop" not in frame._jdf.queryExecution().toString() and "Cartesian" not in frame._jdf.queryExecution().toString()
    assert sorted(map(tuple, frame.collect())) == sorted(want) and want


def shuffled(frame):
    """Bytes of the rows that a frame's shuffles deal out; one that is used again counts once."""
    frame.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = frame.select("*")  # planned anew
        plan.collect()
        nodes, total = [plan._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Exchange":
                total += node.metrics().apply("dataSize").value()
            nodes += [node.children().apply(k) for k in range(node.children().size())]
        return total
    finally:
        frame.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_title_mismatches_shuffle_no_more_than_their_texts(spark, sf):
    from paperloom.plans import catalog

    catalog.load()
    chars = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert 0 < shuffled(catalog.QUERIES["title_mismatches"](spark, sf)) < 2 * chars


@pytest.mark.parametrize(("sheet", "piece"), [(1 << 20, 4096), (100, 3), (1, 1)])
def test_title_mismatches_in_bounded_rows(spark, monkeypatch, sheet, piece):
    import random

    monkeypatch.setattr(elements, "SHEET", sheet)
    monkeypatch.setattr(elements, "PIECE", piece)
    rng = random.Random(9)
    same = "the same twenty-four characters, "
    texts = [(same + "é𝛼ab"[k % 4] * rng.randint(0, 90)) if k % 3 else "".join(rng.choices("ab ", k=rng.randint(1, 40))) for k in range(60)] + ["a" * n for n in (24, 25, 95, 96, 97, 300)]
    texts += texts[5:9]
    blocks = [(d, k, t, rng.choice(["", None, "1. One", "Two"])) for d in (1, 2) for k, t in enumerate(texts[d:])] + [(1, 999, None, "Two"), (3, 0, texts[1], "Two")]
    chunks = [(d, f"c{j}", "  ".join(rng.sample(texts, rng.randint(1, 4))), rng.choice(["one", "TWO", None]), rng.choice(["text", "text", "table"])) for d in (1, 2, 4) for j in range(40)] + [(1, "none", None, "one", "text")]
    flat = lambda t: " ".join((t or "").split())
    want = []
    for d, chunk, content, title, kind in chunks:
        c = flat(content)
        first = next((h or "" for e, _, t, h in blocks if e == d and len(flat(t)) >= 24 and flat(t)[:96] in c), "")
        if kind == "text" and len(c) >= 24 and first and first.lower().removeprefix("1. ") != (title or "").lower():
            want.append((d, chunk, title, first))
    frame = elements.title_mismatches(spark.createDataFrame(chunks, "document_id long, chunk_id string, content string, section_title string, content_type string"), spark.createDataFrame(blocks, "document_id long, idx long, text string, heading string"))
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want)) and want
