import random

from pyspark.sql import functions as F

from paperloom.llm import lang_mixture

from .fixtures import clashing, frame, odd_documents

ALPHABETS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}


def sample(lang, seed, n=200):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 6))) for _ in range(n))


def corpus():
    return [(k, sample(lang, k), lang, "s", 1) for k, lang in enumerate(["aa", "bb", "cc"] * 12)]


def test_held_out_accuracy(spark):
    rows = corpus()
    got = lang_mixture.identify(frame(spark, rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert held and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert {r["held_out"] for r in got if r["doc_id"] == 3} == {spark.sql("select crc32('3') % 3 = 1").first()[0]}


def test_mixtures_and_single_languages(spark):
    model = lang_mixture.fit(frame(spark, corpus()))
    assert model.languages == ["aa", "bb", "cc"]
    two = model.proportions(sample("aa", 100, 300) + " " + sample("bb", 101, 100))
    assert list(two) == ["aa", "bb"] and abs(two["aa"] - 0.75) < 0.08 and abs(sum(two.values()) - 1) < 1e-9
    assert list(model.proportions(sample("cc", 102))) == ["cc"]
    three = model.proportions(" ".join(sample(x, 103, 100) for x in ALPHABETS))
    assert set(three) == set(ALPHABETS)


def test_expectation_maximisation_raises_the_likelihood(spark):
    import numpy as np

    model = lang_mixture.fit(frame(spark, corpus()))
    text = sample("aa", 5, 50) + " " + sample("bb", 6, 50)
    ids = lang_mixture.grams(text, model.bits)
    share = model.proportions(text)
    mixed = sum(share.get(x, 0) * model.likelihood[ids, k] for k, x in enumerate(model.languages))
    alone = max(np.log(model.likelihood[ids, k]).sum() for k in range(3))
    assert np.log(mixed).sum() > alone


def test_odd_rows(spark):
    rows = odd_documents()
    got = lang_mixture.identify(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for k in (0, 1, 2, 11):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert by[3]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got)
    assert lang_mixture.identify(frame(spark, [])).collect() == []
    nothing = lang_mixture.identify(frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_labels_are_no_input(spark):
    rows = corpus()
    held = {r[0] for r in spark.createDataFrame([(r[0],) for r in rows], "doc_id long").filter(lang_mixture.held_out(F.col("doc_id"))).collect()}
    other = [(*r[:2], "zz" if r[0] in held else r[2], "t", 9) for r in rows]
    one = {(r["doc_id"], r["lang_pred"]) for r in lang_mixture.identify(frame(spark, rows)).collect()}
    two = {(r["doc_id"], r["lang_pred"]) for r in lang_mixture.identify(frame(spark, other)).collect()}
    assert one == two
