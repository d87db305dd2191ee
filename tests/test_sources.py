"""Readers, writers and streams."""

import json
import random

from pyspark.sql import functions as F

from paperloom.operators import store
from paperloom.sources import readers, writers
from paperloom.streaming import state


def test_hierarchies(spark, tmp_path):
    section = {"section_id": "d_section_0", "title": "Intro", "level": 1, "numbering": "1", "page_start": 1, "child_section_ids": [], "reading_order": 0}
    (tmp_path / "a.json").write_text(json.dumps({"hierarchy": {"document_id": "a", "sections": [section, section | {"title": "End"}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"document_id": "b", "sections": [section]}))
    got = readers.sections(spark, str(tmp_path))
    assert sorted((r["document_id"], r["idx"], r["title"], r["level"]) for r in got.collect()) == [("a", 0, "Intro", 1), ("a", 1, "End", 1), ("b", 0, "Intro", 1)]
    writers.hierarchy_json(got, f"{tmp_path}/out")
    again = spark.read.json(f"{tmp_path}/out").select("document_id", F.size("sections").alias("n")).collect()
    assert sorted(map(tuple, again)) == [("a", 2), ("b", 1)]


def test_blocks_and_questions(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"document_id": "a", "text_blocks": [{"id": "1", "page": 2, "label": "text", "text": "hello"}]}))
    (tmp_path / "y.json").write_text(json.dumps({"document_id": "b"}))
    assert [(r["document_id"], r["text"]) for r in readers.blocks(spark, f"{tmp_path}/*.json").collect()] == [("a", "hello")]
    rows = [{"question": "q1", "relevant_chunk_ids": ["a"], "reference_answer": "x"}, {"question": "FILL IN", "relevant_chunk_ids": ["a"]}, {"question": "q2", "relevant_chunk_ids": ["FILL IN 1"]}, {"question": "q3", "relevant_chunk_ids": ["b"]}, {"paper_id": "p", "relevant_chunk_ids": ["c"]}]
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "qa.json").write_text(json.dumps(rows))
    (tmp_path / "qa" / "broken.json").write_text("{not json")
    assert sorted(r["question"] or "" for r in readers.questions(spark, f"{tmp_path}/qa").collect()) == ["", "q1", "q3"]
    assert [r["question"] for r in readers.questions(spark, f"{tmp_path}/qa", with_answers=True).collect()] == ["q1", "q3", None]


def test_files(spark, tmp_path):
    page, end = b" 1 0 obj <</Type /Page>> endobj", b" startxref 9 %%EOF"
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.7 <</Type/Pages>>" + page + page + end)
    (tmp_path / "packed.pdf").write_bytes(b"%PDF-1.7 <</Type /ObjStm>>" + end)
    (tmp_path / "bare.pdf").write_bytes(b"%PDF-1.7 <</Type/Pages>>" + end)
    (tmp_path / "long.pdf").write_bytes(b"%PDF-1.7" + page * 4 + end)
    (tmp_path / "cut.pdf").write_bytes(b"%PDF-1.7" + page)
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.7 /Encrypt 5 0 R")
    (tmp_path / "note.txt").write_bytes(b"%PDF-1.7")
    found = {r["path"].rsplit("/", 1)[1]: r for r in readers.files(spark, str(tmp_path), most_pages=3).collect()}
    want = {"good.pdf": [], "packed.pdf": [], "bare.pdf": ["no_pages"], "long.pdf": ["too_many_pages"], "cut.pdf": ["damaged"], "fake.pdf": ["not_pdf"], "locked.pdf": ["encrypted"], "note.txt": ["wrong_extension", "damaged"]}
    assert {name: r["errors"] for name, r in found.items()} == want
    assert found["good.pdf"]["page_count"] == 2 and found["packed.pdf"]["page_count"] is None
    none = spark.range(1).select(readers.pdf_errors(F.lit("a.PDF"), F.lit(0), F.lit(b"")).alias("x"))  # Spark lists no empty files
    assert none.first()["x"] == ["empty"]
    assert readers.files(spark, str(tmp_path), most_bytes=10).filter("path like '%good.pdf'").first()["errors"] == ["too_large"]


def test_guides(spark):
    step = {"objective": "o", "section_to_read": ["s"], "questions_to_answer": ["q"]}
    payloads = [("list", [step, step]), ("steps", {"steps": [step]}), ("guide", {"guide": [step]}), ("passes", {"pass1": {"steps": [step]}, "pass2": {"steps": [step, step]}}), ("none", {"x": 1})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in payloads] + [("bad", "{")], "k string, p string")
    got = readers.guide_steps(df, "k", "p").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"list": 2, "steps": 1, "guide": 1, "passes": 3}


def test_parts_are_replaced(spark, tmp_path):
    schema = "document_id string, v int"
    writers.replace_parts(spark.createDataFrame([("a", 1), ("b", 1)], schema), f"{tmp_path}/t", ["document_id"])
    writers.replace_parts(spark.createDataFrame([("a", 2)], schema), f"{tmp_path}/t", ["document_id"])
    assert sorted((r["document_id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 2), ("b", 1)]


def test_streams(spark, tmp_path):
    events = "k string, at timestamp, e string"
    rows = [("a", "claim", 1), ("a", "claim", 2), ("a", "complete", 3), ("a", "claim", 4), ("b", "claim", 1), ("b", "fail", 2), ("b", "claim", 3), ("c", "fail", 1)]
    df = spark.createDataFrame([(k, n, e) for k, e, n in rows], "k string, n int, e string").select("k", F.timestamp_seconds(F.col("n") + 1_700_000_000).alias("at"), "e")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events).parquet(f"{tmp_path}/in")
    index = state.index_documents(stream.withColumnRenamed("k", "document_id"), f"{tmp_path}/index", f"{tmp_path}/c2")
    index.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/index").count() == len(rows)
    seen = state.first_seen(stream, "at", "e").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("seen").count() == 3
    counts = state.latest_by_window(stream, "at", "e").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c4").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {r["e"]: r["n"] for r in spark.table("counts").collect()} == {"claim": 5, "complete": 1, "fail": 2}


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def machine(events):
    held, rejected = "pending", 0
    for e in events:
        if e == "claim":
            rejected += held == "running"
            held = held if held in ("running", "completed") else "running"
        elif e in ("complete", "fail"):
            held = {"complete": "completed", "fail": "failed"}[e]
    return held, rejected


def run_states(spark, tmp_path, name, batches, **options):
    """The last state of each key, after a batch of each of ``batches`` (lists of (key, second, event))."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema, out = "k string, at timestamp, e string", {}

    def keep(df, _):
        out.update({r.k: (r.state, r.n_rejected) for r in df.collect()})

    try:
        for rows in batches:
            df = spark.createDataFrame(rows, "k string, n long, e string").select("k", F.timestamp_seconds(F.col("n") + 1_700_000_000).alias("at"), "e")
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
            found = state.question_states(stream, "k", "at", "e", **options)
            found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out


def test_question_states_in_batches_equal_the_fold(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("abcdef"), n, rng.choice(["claim", "claim", "claim", "complete", "fail", "view"])) for n in range(90)]
    want = {k: machine([e for x, _, e in rows if x == k]) for k in "abcdef"}
    batch = store.question_states(spark.createDataFrame([(k, n, n, e) for k, n, e in rows], "k string, at long, tie long, e string"), "k", "at", "e", "tie")
    assert {r.k: (r.state, r.n_rejected) for r in batch.collect()} == want
    assert run_states(spark, tmp_path, "fold", [rows[:30], rows[30:55], rows[55:]]) == want


def test_a_claim_that_runs_too_long_goes_back(spark, tmp_path):
    batches = [[("a", 0, "claim"), ("b", 0, "claim"), ("c", 0, "claim")], [("b", 30, "complete"), ("z", 400, "claim")], [("c", 410, "claim"), ("z", 420, "fail")]]
    got = run_states(spark, tmp_path, "late", batches, late="10 seconds", most="1 minute")
    assert got == {"a": ("pending", 0), "b": ("completed", 0), "c": ("running", 0), "z": ("failed", 0)}
