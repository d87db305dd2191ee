import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from paperloom.llm import lm_diff

from .fixtures import clashing, frame, odd_documents, words

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    good = [(k, words(k, 60), "en", "s", 1) for k in range(60)]
    bad = [(100 + k, " ".join(f"#{w}%%" for w in words(200 + k, 60).split()), "en", "s", 1) for k in range(60)]
    labels = [(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(40)]
    return good + bad, labels


class Plain:
    """An n-gram model counted with dictionaries; ``part``: what share of it is kept, in expectation."""

    def __init__(self, texts, characters, part=1.0):
        self.part, self.v = part, len(characters) + 1
        self.after = defaultdict(Counter)
        for text in texts:
            chars = [None] * 3 + list(text)
            for k in range(3, len(chars)):
                for n in range(4):
                    self.after[tuple(chars[k - n : k])][chars[k]] += 1

    def p(self, context, char):
        seen = self.after.get(context, {})
        total = sum(seen.values()) * self.part
        if not context:
            return (seen.get(char, 0) * self.part + 0.5) / (total + 0.5 * self.v)
        shorter = self.p(context[1:], char)
        if not seen:
            return shorter
        kinds = sum(1 - (1 - self.part) ** n for n in seen.values())
        return (seen.get(char, 0) * self.part + kinds * shorter) / (total + kinds)

    def loss(self, text):
        chars = [None] * 3 + list(text)
        return sum(-math.log2(self.p(tuple(chars[k - 3 : k]), chars[k])) for k in range(3, len(chars))) / len(text)


def folds(spark, rows):
    return {r["doc_id"]: r["f"] for r in frame(spark, rows).select("doc_id", lm_diff.fold_of(F.col("doc_id")).alias("f")).collect()}


def test_against_brute_force(spark):
    rows, labels = corpus()
    rows += [(300, "漢字かな 𝒳é\0\n" * 3, "ja", "s", 1), (301, "x", "en", "s", 1)]
    fold, wanted = folds(spark, rows), {k for k, q, _ in labels if q}
    characters = {c for r in rows for c in r[1]}
    models = []
    for f in (0, 1):
        every = [r[1] for r in rows if fold[r[0]] == f]
        good = [r[1] for r in rows if fold[r[0]] == f and r[0] in wanted]
        models.append((Plain(good, characters), Plain(every, characters, sum(map(len, good)) / sum(map(len, every)))))
    for block_bytes in (1 << 20, 4096):
        got = lm_diff.score(frame(spark, rows), spark.createDataFrame(labels, LABELS), block_bytes=block_bytes).collect()
        texts = {r[0]: r[1] for r in rows}
        assert sorted(r["doc_id"] for r in got) == sorted(texts)
        for r in got:
            target, background = models[1 - fold[r["doc_id"]]]
            a, b = target.loss(texts[r["doc_id"]]), background.loss(texts[r["doc_id"]])
            assert r["n_tokens"] == len(texts[r["doc_id"]])
            assert abs(r["loss_target"] - a) < 1e-9 and abs(r["loss_background"] - b) < 1e-9 and abs(r["score"] - (a - b)) < 1e-9


def test_probabilities_sum_to_one(spark):
    """Over all characters and one unknown, in a seen, a once seen, an unseen and the first context."""
    texts = ["abcabcabd abc", "bcd abca", "zzabc"]
    pack = lambda s: sum((ord(c) + 1 if c != "^" else 0) << (21 * (len(s) - 1 - k)) for k, c in enumerate(s))
    counted = Counter()
    for f, text in ((0, texts[0]), (0, texts[1]), (1, texts[2])):
        chars = "^^^" + text
        for k in range(3, len(chars)):
            counted[(pack(chars[k - 3 : k]), ord(chars[k]) + 1, f)] += 1
    every = {c for _, c, _ in counted} | {0x10FFFF}
    contexts = [pack(c) for c in ("abc", "zza", "qqq", "xab", "^^^", "^^a")]
    asked = {(c, x) for c in contexts for x in every} | {(c, x) for c, x, _ in counted}
    rows = [(c, x, counted[(c, x, 0)], counted[(c, x, 0)] // 2, counted[(c, x, 1)], counted[(c, x, 1)]) for c, x in asked]
    found = lm_diff.losses(spark.createDataFrame(rows, "context long, char int, all0 long, target0 long, all1 long, target1 long")).collect()
    for m in lm_diff.MODELS:
        assert min(r[m] for r in found) >= 0
        for c in contexts:
            assert abs(sum(2 ** -r[m] for r in found if r["context"] == c) - 1) < 1e-9


def test_many_different_characters(spark):
    """More characters at once than fit a packed key: contexts are numbered first."""
    text = "".join(chr(c) for c in range(0x4E00, 0x9FFF)) + "".join(chr(c) for c in range(0xAC00, 0xD7A3)) + "".join(chr(c) for c in range(0x20000, 0x22000))
    context, char, number = lm_diff.grams([text, "ab"])
    points = [0, 0, 0] + [ord(c) + 1 for c in text]
    for k in (0, 1, 2, 3, 500, 32000, len(text) - 1):
        assert char[number[k]] == points[k + 3] and context[number[k]] == (points[k] << 42) + (points[k + 1] << 21) + points[k + 2]
    assert context[number[len(text)]] == 0 and char[number[len(text)]] == ord("a") + 1 and len(number) == len(text) + 2


def test_unseen_documents_are_told_apart(spark):
    rows, labels = corpus()
    score = {r["doc_id"]: r["score"] for r in lm_diff.score(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert max(score[k] for k in range(40, 60)) < min(score[100 + k] for k in range(40, 60))


def test_odd_rows(spark):
    rows = odd_documents()
    labels = [(4, 1, None), (4, None, 0), (5, 0, 0), (None, 1, 1), (999, 1, 0), (7, 1, 0)]
    got = lm_diff.score(clashing(frame(spark, rows)), clashing(spark.createDataFrame(labels, LABELS))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["score"] is None and by[1]["n_tokens"] == 0 and by[7]["score"] is not None
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert min(r["loss_background"] for r in got if r["score"] is not None) >= 0
    assert lm_diff.score(frame(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []
    assert len(lm_diff.score(frame(spark, rows), spark.createDataFrame([], LABELS)).collect()) == len(rows)


def test_without_broadcasts_and_one_hot_text(spark):
    """Half of all rows hold one text; every row is scored, copies alike within a fold."""
    rows = [(k, words(7, 50) if k % 2 else words(k, 50), "en", "s", 1) for k in range(200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lm_diff.score(frame(spark, rows), spark.createDataFrame([(k, k % 3 // 2, 0) for k in range(200)], LABELS), block_bytes=4096).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    fold = folds(spark, rows)
    assert len(got) == 200 and len({(fold[r["doc_id"]], round(r["score"], 9)) for r in got if r["doc_id"] % 2}) == 2
