import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import components, jaccard_join

from .fixtures import clashing, frame, odd_documents, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    found = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j])])
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[found[k]] = min(least.get(found[k], r[0]), r[0])
    return sorted(((r[0], len(sets[k]), least.get(found[k]) if sets[k] else r[0]) for k, r in enumerate(rows)), key=str)


def joined(df, **how):
    return sorted((tuple(r) for r in jaccard_join.join(df, **how).collect()), key=str)


def edited(text, seed, n):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.random())
    return " ".join(w)


def families():
    """Chains and stars of near copies on both sides of the threshold, a shared passage, a large group."""
    rows = []
    for f in range(6):
        base = words(1000 + f, 80 + 40 * f)
        for k in range(8):
            rows.append((f * 100 + k, edited(base, f * 10 + k, k % 5), "en", "s", 1))
    chain = words(2000, 300).split()
    for k in range(12):
        rows.append((1000 + k, " ".join(chain[k * 10 : k * 10 + 150]), "en", "s", 1))
    passage = words(2001, 60)
    rows += [(2000 + k, words(3000 + k, 90) + " " + passage, "en", "s", 1) for k in range(30)]
    big = words(2002, 100)
    rows += [(3000 + k, edited(big, 4000 + k, 1 + k % 3), "en", "s", 1) for k in range(60)]
    return rows + [(5000 + k, r[1], "en", "s", 1) for k, r in enumerate(rows[:20])]


def test_against_brute_force(spark):
    rows = families() + odd_documents()
    want = brute(rows)
    assert joined(frame(spark, rows)) == want
    assert joined(clashing(frame(spark, rows)), chunk=7) == want  # groups dealt out in chunks


def test_empty_table(spark):
    assert joined(frame(spark, [])) == []
    assert joined(frame(spark, [(1, None, "en", "s", 1), (2, " ", "en", "s", 1)])) == [(1, 0, 1), (2, 0, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=24), min_size=2, max_size=14), st.sampled_from([(85, 100), (6, 10), (1, 2)]))
def test_search_joins_what_is_connected(sets, like):
    import numpy as np

    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    got = jaccard_join.search(list(range(len(sets))), arrays, like)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if like[1] * len(sets[i] & sets[j]) >= like[0] * len(sets[i] | sets[j])]
    assert all(tuple(sorted(p, reverse=True)) in pairs for p in got)
    same = lambda r: [r.index(x) for x in r]
    assert same(roots(len(sets), got)) == same(roots(len(sets), pairs))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(200) if k % 50] + [(300, k) for k in range(301, 360)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    found = roots(600, pairs)
    least = {}
    for k in range(600):
        least[found[k]] = min(least.get(found[k], k), k)
    assert all(root == least[found[node]] for node, root in got.items())
    assert set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
