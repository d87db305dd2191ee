import random
from collections import defaultdict
from itertools import pairwise

from paperloom.llm import template_lines

from .fixtures import clashing, frame, odd_documents, words


def unspaced(c):
    p = ord(c)
    return 0x3000 <= p < 0xD800 and p < 0xE000 or 0xE00 <= p < 0xF00 or 0x1000 <= p < 0x10C0 or 0x1780 <= p < 0x1800 or 0x20000 <= p < 0x30000


def tokens(line):
    """(token, twice its words): digits are a field of no words."""
    out = []
    for word in line.replace("\t", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" "):
        part = ""
        for c in word:
            if unspaced(c):
                out += [(part, 2)] * bool(part) + [(c, 1)]
                part = ""
            else:
                part += c
        out += [(part, 2)] * bool(part)
    return [("\0", 0) if any(c in "0123456789" for c in t) else (t, w) for t, w in out]


def templates(line, least=3):
    """The exact template and those with an open run, each a tuple."""
    own = tokens(line)
    n, fixed = len(own), sum(w for _, w in own)
    out = [(n, tuple(t for t, _ in own))] if fixed >= 2 * least else []
    step = max((n + 3) // 6, 1)
    width = 2 * step if n > 5 else 1
    a = 0
    while n >= 5:
        if fixed - sum(w for _, w in own[a : a + width]) >= 2 * least + 2:
            out.append((n, a, tuple(t for k, (t, _) in enumerate(own) if not a <= k < a + width)))
        if a == n - width:
            break
        a = min(a + step, n - width)
    return out


def grams(lines):
    own = [t for line in lines for t, _ in tokens(line)]
    return {tuple(own[k : k + 4]) for k in range(max(len(own) - 3, 1))} if own else set()


def brute(rows):
    """Dropped line numbers of each row; documents are compared in pairs, by whole sets of shingles."""
    docs = sorted({(r[1] or "") for r in rows})
    split = {d: [x for x in d.split("\n") if tokens(x)] for d in docs}
    rests = defaultdict(set)
    for d in docs:
        for x in split[d]:
            for t in templates(x):
                rests[t].add(tuple(sorted(tuple(tokens(y)) for y in split[d] if tokens(y) != tokens(x))))
    shared = {t for t, found in rests.items() if len(found) > 1}
    own = {}
    for d in docs:
        full = [x for x in split[d] if sum(w for _, w in tokens(x)) >= 6]
        own[d] = grams([x for x in full if not shared & set(templates(x))] or [x for x in split[d] if x not in full])
    root = {d: d for d in docs}
    whole = {d: grams(split[d]) for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, a in enumerate(docs):
        for b in docs[:k]:
            near = whole[a] and whole[b] and 10 * len(whole[a] & whole[b]) >= 7 * len(whole[a] | whole[b])
            if near or len(own[a] & own[b]) * 4 > min(len(own[a]), len(own[b])) > 0:
                root[find(a)] = find(b)
    carriers, long = defaultdict(set), defaultdict(int)
    for d in docs:
        for x in split[d]:
            for t in shared & set(templates(x)):
                carriers[t].add(find(d) if own[d] else "none")
                long[t] = max(long[t], sum(w or 2 for _, w in tokens(x)) // 2)
    known = {t for t, found in carriers.items() if len(found) >= (2 if long[t] >= 20 else 3)}
    return [[k for k, x in enumerate((r[1] or "").split("\n")) if known & set(templates(x))] for r in rows]


NOTICES = (
    "All rights reserved worldwide",
    "版权所有未经许可不得转载",
    "สงวนลิขสิทธิ์ตามกฎหมาย",
    "one two three four five six seven",
)
FIELDS = (
    "user {} logged in from host",
    "please note that user {} logged in today",
    "{} wrote this line from the old house yesterday",
    "the {} wrote this line from the old house",
    "we had a word with our friend about some {}",
    "this is a line of twenty words and two more in which the name of {} stands near its very end today",
)
NAMES = ("alice", "bob", "carol", "dave", "erin", "frank")


def corpus():
    note = "All content of this site is for members only"
    passage = words(500, 60)
    rows = [(k, f"{words(k, 20)}\n{note}\n{words(1000 + k, 15)}", "en", "s", 1) for k in range(12)]
    rows += [(100 + k, f"{words(2000 + k, 25)}\n{passage}", "en", "s", 1) for k in range(2)]
    rows += [(200 + k, f"Report {k} of {k * 7} for the year {1990 + k}\n{words(3000 + k, 25)}", "en", "s", 1) for k in range(5)]
    rows += [(300 + k, f"This text was kindly sent in to us by {name}\n{words(4000 + k, 25)}", "en", "s", 1) for k, name in enumerate(["Ann Lee", "Bob Ray", "Cy Dow", "Di Fox"])]
    copy = "\n".join(words(5000 + k, 12) for k in range(5))
    rows += [(400 + k, copy, "en", "s", 1) for k in range(6)]
    rows += [(500 + k, f"too short\n{words(6000 + k, 25)}", "en", "s", 1) for k in range(6)]
    return rows


def dropped(df):
    return sorted(((r["doc_id"], list(r[-1]["dropped"]), r["text"]) for r in template_lines.dedup(df).collect()), key=str)


def want(rows):
    out = []
    for r, gone in zip(rows, brute(rows), strict=True):
        left = r[1] if not gone else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone)
        out.append((r[0], gone, left))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    for rows in (corpus(), corpus() + odd_documents()):
        assert dropped(frame(spark, rows)) == want(rows)
        assert dropped(clashing(frame(spark, rows))) == want(rows)


def test_what_goes_and_what_stays(spark):
    by = {k: gone for k, gone, _ in dropped(frame(spark, corpus()))}
    assert all(by[k] == [1] for k in range(12))  # a line in many documents
    assert by[100] == by[101] == [1]  # a long passage in two
    assert all(by[200 + k] == [0] for k in range(5))  # digits are variable
    assert all(by[300 + k] == [0] for k in range(4))  # and so is a field of words
    assert all(by[400 + k] == [] for k in range(6))  # copies are left to near-duplicate detection
    assert all(by[500 + k] == [] for k in range(6))  # two words come together by chance


def test_short_unspaced_and_open_lines(spark):
    """Each in six otherwise different documents: all six lose it, wherever its field stands."""
    rows = [(100 * n + k, f"{words(100 * n + k, 30)}\n{line.format(name)}", "en", "s", 1) for n, line in enumerate(NOTICES + FIELDS) for k, name in enumerate(NAMES)]
    rows += [(5000 + k, f"{words(7000 + k, 30)}\nof the", "en", "s", 1) for k in range(6)]
    got = dropped(frame(spark, rows))
    assert got == want(rows)
    by = {k: gone for k, gone, _ in got}
    assert all(by[100 * n + k] == [1] for n in range(len(NOTICES + FIELDS)) for k in range(6))
    assert all(by[5000 + k] == [] for k in range(6))


def test_parse():
    lines = ["a b 1 d", "", "a b x27 d", "漢字 kana かな", "one  two\tthree\r"]
    found = template_lines.parsed(["\n".join(lines).encode(), None, b"a b 99 d"])
    assert found.size.tolist() == [4, 4, 5, 3, 4] and found.number.tolist() == [0, 2, 3, 4, 0] and found.doc.tolist() == [0, 0, 0, 0, 2]
    assert found.exact[0] == found.exact[1] == found.exact[4] and len(set(found.exact.tolist())) == 3
    assert found.fixed.tolist() == [6, 6, 6, 6, 6] and found.half.tolist() == [8, 8, 6, 6, 8]
    assert found.rests()[4] == 0 and found.rests()[0] == found.rests()[1] != 0
    for size in range(1, 40):
        for texts in ([words(size, size)], [words(size, size), words(99, 7), words(size, size)]):
            found = template_lines.parsed([t.encode() for t in texts])
            line, template = found.templates(3)
            assert len(template) == sum(len(templates(t)) for t in texts)
            assert len(set(template.tolist())) == len({t for x in texts for t in templates(x)})
    assert template_lines.parsed([]).size.tolist() == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "\n".join(words(k, 9) for k in range(50)).encode()
    whole = template_lines.parsed([b"x", text, text])
    monkeypatch.setattr(template_lines, "PIECE_BYTES", 100)
    parts = template_lines.parsed([b"x", text, text])
    assert whole.exact.tolist() == parts.exact.tolist() and whole.number.tolist() == parts.number.tolist() and whole.doc.tolist() == parts.doc.tolist()
    assert all(a <= b for a, b in pairwise(parts.doc.tolist()))


def test_empty_tables(spark):
    assert dropped(frame(spark, [])) == []
    assert dropped(frame(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)])) == [(1, [], None), (2, [], "")]


def test_a_column_of_the_same_name_stays(spark):
    docs = frame(spark, corpus()).withColumnRenamed("lang", "line_dedup")
    got = template_lines.dedup(docs)
    assert got.columns == [*docs.columns, "line_dedup_"] and {r["line_dedup"] for r in got.collect()} == {"en"}


def test_copies_of_one_carrier_count_once(spark):
    passage = words(500, 60)
    rows = [(k, f"{words(7000 + k, 100)}\n{passage}", "en", "s", 1) for k in range(10)]
    near = [(100 + k, rows[0][1].replace(" ", f" extra{chr(97 + k % 26)} ", 1), "en", "s", 1) for k in range(30)]
    by = {k: gone for k, gone, _ in dropped(frame(spark, rows + near + [(200 + k, rows[1][1], "en", "s", 1) for k in range(60)]))}
    assert all(gone == [1] for gone in by.values()) and len(by) == 100
    alone = [r for r in rows[:1]] + near  # one text and its near copies only
    assert all(gone == [] for _, gone, _ in dropped(frame(spark, alone)))


def test_lines_of_a_passage_do_not_sign_each_other(spark):
    halves = "\n".join(words(510 + k, 30) for k in range(2))
    notice = "\n".join(words(520 + k, 20) for k in range(3))
    rows = [(2 * p + k, f"{words(8000 + 2 * p + k, 100)}\n{halves.replace(' ', f' p{chr(97 + p)} ')}", "en", "s", 1) for p in range(12) for k in range(2)]
    rows += [(100 + k, f"{words(9000 + k, 30)}\n{notice}", "en", "s", 1) for k in range(100)]
    by = {k: gone for k, gone, _ in dropped(frame(spark, rows))}
    assert all(by[k] == [1, 2] for k in range(24)) and all(by[100 + k] == [1, 2, 3] for k in range(100))


def test_edited_copies_keep_their_lines(spark):
    def edited(seed):
        rng = random.Random(seed)
        return "\n".join(" ".join(f"{w}{seed}x" if seed and rng.random() < 0.07 else w for w in words(9500 + k, 30).split()) for k in range(20))

    by = dropped(frame(spark, [(k, edited(k), "en", "s", 1) for k in range(5)]))
    assert all(gone == [] for _, gone, _ in by)


def test_copies_with_a_word_changed_in_each_line_keep_them(spark):
    def edited(name):
        return "\n".join(" ".join(name if k == j % 7 else w for k, w in enumerate(words(9600 + j, 25).split())) for j in range(15))

    by = dropped(frame(spark, [(k, edited(name), "en", "s", 1) for k, name in enumerate(NAMES)]))
    assert all(gone == [] for _, gone, _ in by)


def test_sketches_meet_by_hash_aggregates(spark, monkeypatch):
    """Hashes are counted without sorting them, and once however many rows have the text."""
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(template_lines, "checkpoint", planned)
    monkeypatch.setattr(template_lines, "forget", lambda *done: None)
    texts = {1: ([2, 4, 6], []), 2: ([2, 4, 6, 8], []), 3: ([2, 10, 12], [1, 3]), 4: ([14], [1, 3]), 5: ([16], [18]), 6: ([20, 22, 24], []), 7: ([20, 26, 28], [])}
    rows = [(k, [], own, whole) for k, (own, whole) in texts.items()] + [(7, [], *texts[7])] * 5
    held = spark.createDataFrame(rows, "text_key long, carried array<long>, own array<long>, whole array<long>")
    got = planned(template_lines._alike(held))
    assert {(r["u"], r["v"]) for r in got.collect()} == {(2, 1), (4, 3)} and got.count() == 2
    assert plans and not any("SortAggregate" in x for x in plans)
