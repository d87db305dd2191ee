import hashlib

import regex
import xxhash

from paperloom.llm import winnow

from .fixtures import clashing, frame, odd_documents, words

TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]{1,24}", regex.V1)
P = winnow.PRIME


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def minima(text):
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) % P for w in TOKEN.findall(text.lower())]
    if not h:
        return []

    def roll(xs):
        a = 0
        for x in xs:
            a = (a * winnow.BASE + x) % P
        return a

    grams = [roll(h[i : i + 4]) for i in range(len(h) - 3)] if len(h) >= 4 else [roll(h)]
    out = []
    for i in range(max(len(grams) - 3, 1)):
        g, p = min((x, -(i + j)) for j, x in enumerate(grams[i : i + 4]))
        if (g, -p) not in out:
            out.append((g, -p))
    return out


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return round(len(a & b) / len(a | b), 9) if a | b else 1.0


def brute(rows):
    distinct = sorted({(r[0], signed(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()), r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    after = {d: distinct[(k + 1) % len(distinct)][2] for k, d in enumerate(distinct)}
    out = []
    for r in rows:
        text = r[1] or ""
        nxt = after[(r[0], signed(xxhash.xxh64(text.encode(), seed=42).intdigest()), text)]
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        a, b = minima(text), minima(edited)
        show = lambda m: ",".join(f"{h:08x}@{p}" for h, p in m)
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), like(a, b), like(a, minima(nxt))))
    return sorted(out, key=str)


def compared(df):
    return sorted(((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in winnow.compare(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = [r for r in odd_documents() if len(r[1] or "") < 20000] + [(100 + k, words(k, 3 + k * 2), "en", "s", 1) for k in range(40)]
    assert compared(frame(spark, rows)) == brute(rows)
    assert compared(clashing(frame(spark, rows))) == brute(rows)


def test_order_over_many_slices(spark):
    rows = [(k * 37 % 5000, words(k, 6), "en", "s", 1) for k in range(1500)]
    assert compared(frame(spark, rows)) == brute(rows)


def test_long_text_empty_table_single_row(spark):
    long = [(1, words(9, 60000), "en", "s", 1)]
    got = winnow.compare(frame(spark, long)).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1.0
    assert compared(frame(spark, [])) == []
    assert compared(frame(spark, [(1, None, "en", "s", 1)])) == brute([(1, None, "en", "s", 1)])


def test_match_guarantee(spark):
    shared = words(77, winnow.K + winnow.W - 1)
    rows = [(1, words(1, 50) + " " + shared + " " + words(2, 50), "en", "s", 1), (2, words(3, 33) + " " + shared + " " + words(4, 20), "en", "s", 1)]
    a, b = (winnow.fingerprints(frame(spark, [r])).select(winnow.hashes(winnow.F.col("minima"))).first()[0] for r in rows)
    assert set(a) & set(b)
