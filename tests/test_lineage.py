import random

from pyspark.sql import functions as F

from paperloom.operators import lineage

NODES = "document_id long, section_id string, parent_id string, title string, idx long"


def walk(rows):
    """The reference's rule by a loop: up until there is no parent, no such node, or a node met before."""
    by = {}
    for d, i, p, _, k in sorted(rows, key=lambda r: (r[4], r[2] is not None, r[2] or "")):
        if i is not None:
            by[d, i] = p
    out = {}
    for d, start in by:
        path, at, circular = [], start, False
        while at:
            if at in path:
                circular = True
                break
            if (d, at) not in by:
                break
            path.insert(0, at)
            at = by[d, at]
        out[d, start] = (path, len(path), circular)
    return out


def got(spark, rows):
    found = lineage.paths(spark.createDataFrame(rows, NODES).repartition(3), order="idx")
    return {(r.document_id, r.section_id): (r.path, r.depth, r.circular) for r in found.collect()}


def test_chain_of_a_thousand_and_circles(spark):
    rows = [(1, f"s{k}", f"s{k - 1}" if k else None, "", k) for k in range(1000)]
    rows += [(2, f"c{k}", f"c{(k + 1) % 7}", "", k) for k in range(7)] + [(2, f"t{k}", f"t{k - 1}" if k else "c3", "", k) for k in range(20)]
    rows += [(2, "self", "self", "", 0), (2, "below", "self", "", 0), (3, "s5", "s4", "", 0), (3, "x", "", "", 0), (3, "y", "x", "", 0), (3, None, "x", "", 0)]
    assert got(spark, rows) == walk(rows)
    assert walk(rows)[1, "s999"][1] == 1000 and walk(rows)[2, "t19"][0][:7] == ["c2", "c1", "c0", "c6", "c5", "c4", "c3"]


def test_random_parents(spark):
    rng = random.Random(5)
    rows = [(d, f"n{k}", rng.choice([None, "gone", *[f"n{j}" for j in range(40)]]), "", k) for d in range(12) for k in range(40)]
    rows += [(0, "n3", "n4", "", 99), (0, "n3", "n5", "", 99)]  # the later row counts, of ties the greater parent
    assert got(spark, rows) == walk(rows)


def test_titles_and_descendants(spark):
    rows = [(1, "a", None, "A", 0), (1, "b", "a", "B", 1), (1, "c", "b", None, 2), (1, "d", "a", "D", 3)]
    nodes = spark.createDataFrame(rows, NODES)
    found = lineage.paths(nodes)
    titles = {r.section_id: r.labels for r in lineage.along(found, nodes, F.col("title")).collect()}
    assert titles == {"a": ["A"], "b": ["A", "B"], "c": ["A", "B", ""], "d": ["A", "D"]}
    below = sorted((r.ancestor, r.section_id, r.distance) for r in lineage.descendants(found).collect())
    assert below == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]


def test_no_nodes(spark):
    assert got(spark, []) == {} and got(spark, [(1, None, None, "", 0)]) == {}
