import pytest
from pyspark.sql import functions as F

from paperloom.operators import bm25
from paperloom.sources import postings


@pytest.fixture(scope="module")
def docs(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    for part in range(3):
        postings.add(docs[0].filter(F.col("doc_id") % 3 <= part), path, "doc_id", block=8)  # what is there isn't added again
    return path


def listed(df):
    return sorted(map(tuple, df.select("item_id", "doc_id", "score", "rank").collect()))


def want(docs, asked, k, squared=False):
    return listed(bm25.search_texts(docs, "doc_id", asked, "item_id", k, (squared,))[0])


def scan_files(df):
    """Files that each scan of the lists read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        found = leaves.apply(k).metrics().get("numFiles")
        if found.isDefined():
            out.append(found.get().value())
    return out


@pytest.mark.parametrize("squared", [False, True])
def test_equals_search_of_texts_before_and_after_a_merge(spark, docs, index, tmp_path, squared):
    every, asked = docs
    assert len(postings.live(spark, index)) == 3
    assert listed(postings.search(spark, index, asked, "item_id", "doc_id", 7, squared_idf=squared)) == want(every, asked, 7, squared)
    if squared:
        postings.merge(spark, index, block=8)
        assert len(postings.live(spark, index)) == 1
        assert listed(postings.search(spark, index, asked, "item_id", "doc_id", 7, squared_idf=True)) == want(every, asked, 7, True)


def test_reads_the_folders_of_its_terms_and_opens_few_blocks(spark, docs, index):
    import glob

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rare = docs[1].limit(1).select("item_id", F.lit("zzzz unheardof").alias("text"))
        found = postings.Search(spark, index, rare, "item_id", 5)
        whole = sum(len(glob.glob(f"{index}/lists/batch={b}/*/*.parquet")) for b in postings.live(spark, index))
        read = scan_files(found.fronts.groupBy().count())
        assert read and max(read) * 8 < whole
        short = docs[1].select("item_id", F.array_join(F.slice(F.split("text", " "), 4, 3), " ").alias("text"))
        for asked, share in ((docs[1], 0.8), (short, 0.6)):  # a long question can be met a little everywhere
            found = postings.Search(spark, index, asked, "item_id", 3)
            opened, every = found.chosen.count(), found.bounds.count()
            print("opened", opened, every, opened / every)
            assert 0 < opened < share * every
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_removed_documents_and_their_return(spark, docs, tmp_path):
    every, asked, path = docs[0].filter("doc_id < 300"), docs[1].limit(10), f"{tmp_path}/i"
    postings.add(every, path, "doc_id")
    gone = every.filter("doc_id % 2 = 0")
    postings.remove(gone, path, "doc_id")
    left = every.filter("doc_id % 2 = 1")
    assert listed(postings.search(spark, path, asked, "item_id", "doc_id", 5)) == want(left, asked, 5)
    postings.merge(spark, path)
    assert listed(postings.search(spark, path, asked, "item_id", "doc_id", 5)) == want(left, asked, 5)
    postings.add(gone.withColumn("text", F.upper("text")), path, "doc_id")
    assert postings.keys(spark, path).count() == every.count()
    assert listed(postings.search(spark, path, asked, "item_id", "doc_id", 5)) == want(every, asked, 5)


def test_odd_documents(spark, tmp_path):
    rows = [(1, "a b b"), (2, None), (3, ""), (None, "a"), (4, "a " * 5000), (5, "c")]
    frame, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "a b zz"), (2, None), (3, "")], "item_id long, text string")
    path = f"{tmp_path}/i"
    postings.add(frame.filter("doc_id is null"), path, "doc_id")
    assert postings.live(spark, path) == []
    with pytest.raises(ValueError):
        postings.search(spark, path, asked, "item_id", "doc_id", 3)
    postings.add(frame, path, "doc_id")
    assert listed(postings.search(spark, path, asked, "item_id", "doc_id", 3)) == want(frame.filter("doc_id is not null"), asked, 3)


def test_weights_are_added_up_where_their_block_lies(spark, docs, index):
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = postings.Search(spark, index, docs[1].limit(3), "item_id", 3).hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(batch" in plan and not re.search(r"hashpartitioning\([^)]*key#", plan)


def test_small_batches_are_merged_into_blocks(spark, tmp_path):
    path = f"{tmp_path}/i"
    texts = spark.createDataFrame([(k, f"a b{k % 3} " * (k + 1)) for k in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b1")], "item_id long, text string")
    for part in range(3):
        postings.add(texts.filter(F.col("doc_id") % 3 == part), path, "doc_id", block=4)
    before = postings.live(spark, path)
    postings.merge(spark, path, block=6)
    postings.vacuum(spark, path)
    held = postings.lists(spark, path).filter("term = ''").select("block", "n").collect()
    assert sorted(map(tuple, held)) == [(0, 6), (1, 3)]
    assert not [b for b in before if (tmp_path / "i" / "lists" / f"batch={b}").exists()]
    assert listed(postings.search(spark, path, asked, "item_id", "doc_id", 5)) == want(texts, asked, 5)


def test_no_step_makes_a_row_for_each_document_and_term_of_a_query(spark, tmp_path):
    path, texts = f"{tmp_path}/i", spark.createDataFrame([(k, f"a b{k % 3}") for k in range(9)], "doc_id long, text string")
    postings.add(texts, path, "doc_id")
    found = postings.Search(spark, path, spark.createDataFrame([(1, "a b1")], "item_id long, text string"), "item_id", 3)
    assert "explode(docs" not in found.hits._jdf.queryExecution().optimizedPlan().toString()


def test_removed_documents_of_joined_blocks(spark, tmp_path):
    path, texts = f"{tmp_path}/i", spark.createDataFrame([(k // 2, f"a b{k % 3} c{k} " * (k + 1)) for k in range(24)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b1"), (2, "c3 c12 b2"), (3, "c4")], "item_id long, text string")
    for part in range(3):
        postings.add(texts.filter(F.col("doc_id") % 3 == part), path, "doc_id", block=4)
    postings.remove(texts.filter("doc_id % 4 = 0"), path, "doc_id")
    texts = texts.filter("doc_id % 4 <> 0")
    postings.merge(spark, path, block=12)
    assert sorted(r.key for r in postings.keys(spark, path).collect()) == sorted(r.doc_id for r in texts.collect())
    assert listed(postings.search(spark, path, asked, "item_id", "doc_id", 4)) == want(texts, asked, 4)
