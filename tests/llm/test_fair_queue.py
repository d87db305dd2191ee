import hashlib
import re

from paperloom.llm import fair_queue

from .fixtures import clashing, frame, odd_documents, words


def targets(sizes: dict) -> dict:
    """Resharing step by step."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]} if total else set()
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over


def brute(rows):
    docs = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target = targets(sizes)
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    order = lambda d: (hashlib.md5(f"mix:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0, d[2])
    passes = []
    for rank, s in enumerate(names):
        at = 0
        for epoch in range(3):
            for k in sorted((k for k, d in enumerate(docs) if d[1] == s), key=lambda k: order(docs[k])):
                at += docs[k][2]
                if docs[k][2] and target[s] > 0:
                    passes.append((at / target[s], rank, epoch, k))
    taken, total, budget = {}, 0, sum(sizes.values())
    for _, _, _, k in sorted(passes):
        total += docs[k][2]
        if total > budget:
            break
        taken[k] = taken.get(k, 0) + docs[k][2]
    return sorted(((d[0], d[2], sizes[d[1]], round(target[d[1]], 6), taken.get(k, 0)) for k, d in enumerate(docs)), key=str)


def mixed(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in fair_queue.mix(df).collect()), key=str)


def many():
    return [(k, words(k, 5 + k % 90), "en", f"s{k % 7 if k % 3 else 0}", 1) for k in range(400)]


def test_against_brute_force(spark):
    for rows in (many(), odd_documents(), [(1, "a b c", "en", "s", 1)], [(k, "w " * 10, "en", "s", 1) for k in range(5)] * 2):
        got = mixed(frame(spark, rows))
        assert got == brute(rows)
        assert all(r[4] <= 3 * r[1] for r in got)


def test_sources_come_near_their_targets(spark):
    by = {}
    rows = {r[0]: r for r in many()}
    for r in fair_queue.mix(frame(spark, many())).collect():
        x = by.setdefault(rows[r["doc_id"]][3], [0, r["target"]])
        x[0] += r["taken"]
    assert all(abs(n - t) <= 100 for n, t in by.values())


def test_sequence_is_the_mix_in_order(spark):
    rows = fair_queue.sequence(frame(spark, many())).collect()
    finish = [r["finish"] for r in rows]
    assert finish == sorted(finish)
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["size"]
    assert taken == {r["doc_id"]: r["taken"] for r in fair_queue.mix(frame(spark, many())).collect() if r["taken"]}


def test_clashing_columns_and_empty_table(spark):
    assert mixed(clashing(frame(spark, many()))) == brute(many())
    assert mixed(frame(spark, [])) == []
    assert mixed(frame(spark, [(1, None, "en", "s", 0), (2, "", "en", None, 0)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_reruns_agree(spark):
    assert mixed(frame(spark, many(), parts=1)) == mixed(frame(spark, many(), parts=9))
