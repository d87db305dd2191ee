import hashlib
import random

from paperloom.llm import decontam

from .fixtures import clashing, frame, odd_documents, words

ITEMS = "item_id long, text string"


def split(text):
    out, held = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z":
            c = c.lower()
        if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127:
            held += c
        elif held:
            out.append(held)
            held = ""
    return out


def windows(item):
    w = split(item)
    n = min(13, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def brute(rows, items):
    out = []
    for doc_id, text, *_ in rows:
        w = split(text)
        hit, met = set(), set()
        for item_id, item in items:
            for win in windows(item):
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        met.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    items = [(1, words(50, 40)), (2, "Short, ITEM here!"), (3, None), (4, "  "), (10, words(51, 13)), (11, words(51, 13)), (None, "é été ça"), (12, "a a a a"), (13, words(50, 20) + " tail of its own kind")]
    base = words(50, 40).split()
    rows = odd_documents() + [
        (20, words(60, 30) + " " + " ".join(base[5:30]).upper() + ". " + words(61, 30), "en", "s", 1),
        (21, "x short-item, HERE y", "en", "s", 1),
        (22, words(51, 13), "en", "s", 1),
        (23, " ".join(base[:12]) + " other " + " ".join(base[13:]), "en", "s", 1),
        (24, "a a a a a a a b", "en", "s", 1),
        (25, words(62, 600) + " " + " ".join(base[:13]), "en", "s", 1),
        (26, "É été ça; é été ça", "en", "s", 1),
    ]
    return rows, items


def judged(spark, rows, items, **how):
    got = decontam.judged(decontam.matches(frame(spark, rows), spark.createDataFrame(items, ITEMS), **how)).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_against_brute_force(spark):
    rows, items = data()
    want = brute(rows, items)
    assert judged(spark, rows, items) == want
    assert judged(spark, rows, items, slop=2) == want
    assert judged(spark, rows, items, block_bytes=150) == want  # several blocks of items
    got = decontam.judged(decontam.matches(clashing(frame(spark, rows)), clashing(spark.createDataFrame(items, ITEMS)))).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_empty_tables(spark):
    rows, items = data()
    assert judged(spark, [], items) == []
    assert judged(spark, rows, []) == brute(rows, [])


def near(words_, window, slop):
    """A start from which each term lies within slop of its place."""
    for s in range(-slop, len(words_) + slop):
        if all(any(0 <= s + k + d < len(words_) and words_[s + k + d] == t for d in range(-slop, slop + 1)) for k, t in enumerate(window)):
            return True
    return False


def test_proximity_against_brute_force(spark):
    rng = random.Random(3)
    items = [(1, words(70, 13)), (2, words(71, 13)), (3, "p q r")]
    rows = []
    for k in range(30):
        w = words(70 + k % 2, 13).split()
        for _ in range(k % 5):
            i = rng.randrange(len(w) - 1)
            w[i], w[i + 1] = w[i + 1], w[i]
        if k % 3 == 0:
            w.insert(rng.randrange(len(w)), "new")
        rows.append((k, words(k, 5) + " " + " ".join(w) + (" p x r q" if k % 4 == 0 else ""), "en", "s", 1))
    for slop in (1, 2):
        got = decontam.matches(frame(spark, rows), spark.createDataFrame(items, ITEMS), slop=slop).collect()
        texts = {r[0]: split(r[1]) for r in rows}
        for r in got:
            want = {str(i) for i, t in items for win in windows(t) if near(texts[r["doc_id"]], win, slop)}
            assert set(r["items"]) | set(r["near_items"]) == want


def test_clean_keeps_the_rest(spark):
    rows, items = data()
    want = sorted((r[0] for r in brute(rows, items) if not r[5]), key=str)
    left = decontam.clean(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"] for r in left), key=str) == want
    assert set(left[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
