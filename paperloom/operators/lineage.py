"""Trees by parent ids, of any depth: paths to the root, ancestors and descendants.

A node is a row (document, id, parent). Its path leads from the root down to it; a parent that is null, empty or not in
the document ends it. Paths grow by pointer doubling: in each round a path is put behind that of its first node's
parent, so a tree of depth d takes log2(d) joins, each on equality within a document.

Parents may run in a circle. A walk up from a node then ends before the first node it would meet again, so for a node on
a circle its path is the whole circle, and for one below a circle the path of the circle's node and what hangs on it.

Cases: of rows with one id in a document the one with the greatest ``order`` counts; a node that is its own parent is a
circle of one; null ids are no nodes; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.shared import checkpoint


def links(nodes: DataFrame, document: str, key: str, parent: str, order: str | None = None) -> DataFrame:
    """(d, id, up): each node once, with its parent if that is a node of the document too."""
    last = F.max_by(F.col(parent), F.struct(order, parent) if order else F.struct(parent))
    own = nodes.filter(F.col(key).isNotNull()).groupBy(F.col(document).alias("d"), F.col(key).alias("id")).agg(last.alias("up"))
    known = own.select("d", F.col("id").alias("up"), F.lit(True).alias("there"))
    return own.join(known, ["d", "up"], "left").select("d", "id", F.when(F.col("there"), F.col("up")).alias("up"))


def on_circles(own: DataFrame) -> DataFrame:
    """(d, id) of the nodes of ``own`` (d, id, up) that are their own ancestors.

    Only nodes with 2^r ancestors and more are left after round r; with more than the document has nodes, a walk has
    come to a circle, and its end lies on it.
    """
    alive = checkpoint(own.filter("up is not null"))
    most = alive.groupBy("d").count().agg(F.max("count")).collect()[0][0] or 0
    steps = 1
    while steps <= most:
        after = alive.select("d", F.col("id").alias("up"), F.col("up").alias("next"))
        alive, steps = checkpoint(alive.join(after, ["d", "up"]).select("d", "id", F.col("next").alias("up"))), steps * 2
        if alive.isEmpty():
            break
    return alive.select("d", F.col("up").alias("id")).distinct()


def _doubled(own: DataFrame) -> DataFrame:
    """(d, id, path) of ``own`` (d, id, up), which has no circles."""
    grown = checkpoint(own.select("d", "id", "up", F.array("id").alias("path")))
    while not grown.filter("up is not null").isEmpty():
        above = grown.select("d", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        joined = grown.join(above, ["d", "up"], "left")
        grown = checkpoint(joined.select("d", "id", F.col("next").alias("up"), F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path")))
    return grown.select("d", "id", "path")


def _around(circles: DataFrame) -> DataFrame:
    """(d, id, path) of nodes on circles (d, id, up): the circle, turned so that the node comes last."""
    low = checkpoint(circles.withColumn("low", F.col("id")))
    count = None
    while True:  # the least id goes around; a round doubles how far it has been heard
        after = low.select("d", F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("far"))
        low = checkpoint(low.join(after, ["d", "up"]).select("d", "id", F.col("next").alias("up"), F.least("low", "far").alias("low")))
        before, count = count, low.select("d", "low").distinct().count()
        if count == before:
            break
    cut = circles.join(low.select("d", "id", "low"), ["d", "id"])
    opened = _doubled(cut.select("d", "id", F.when(F.col("id") != F.col("low"), F.col("up")).alias("up"))).join(low.select("d", "id", "low"), ["d", "id"])
    whole = opened.groupBy("d", "low").agg(F.max_by("path", F.size("path")).alias("whole"))
    at = F.size("path")
    turned = F.concat(F.slice("whole", at + 1, F.size("whole")), "path")
    return opened.join(whole, ["d", "low"]).select("d", "id", turned.alias("path"))


def paths(nodes: DataFrame, document: str = "document_id", key: str = "section_id", parent: str = "parent_id", order: str | None = None) -> DataFrame:
    """ARR-01, ARR-02, ARR-03, ARR-06, WIN-09: (document, id, path, depth, circular): ids from the root to each node."""
    own = checkpoint(links(nodes, document, key, parent, order))
    circles = checkpoint(own.join(on_circles(own), ["d", "id"], "left_semi"))
    if circles.isEmpty():
        found = _doubled(own).withColumn("circular", F.lit(False))
    else:
        ends = circles.select("d", "id", F.lit(True).alias("end"))
        tails = _doubled(own.join(ends, ["d", "id"], "left").select("d", "id", F.when(F.col("end").isNull(), F.col("up")).alias("up")))
        around = _around(circles).select("d", F.col("id").alias("first"), F.col("path").alias("circle"))
        met = tails.withColumn("first", F.col("path")[0]).join(around, ["d", "first"], "left")
        joined = F.concat("circle", F.slice("path", F.lit(2), F.size("path")))
        found = met.select("d", "id", F.when(F.col("circle").isNull(), F.col("path")).otherwise(joined).alias("path"), F.col("circle").isNotNull().alias("circular"))
    return found.select(F.col("d").alias(document), F.col("id").alias(key), "path", F.size("path").alias("depth"), "circular")


def along(found: DataFrame, nodes: DataFrame, label: Column, document: str = "document_id", key: str = "section_id") -> DataFrame:
    """ARR-01, ARR-06: (document, id, labels): what each node on a path of ``found`` is called; nodes once each."""
    steps = found.select(document, key, F.posexplode("path").alias("at", "__step"))
    names = nodes.select(F.col(document), F.col(key).alias("__step"), label.alias("__label"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.coalesce("__label", F.lit("")).alias("label"))))
    return steps.join(names, [document, "__step"]).groupBy(document, key).agg(F.transform(listed, lambda x: x["label"]).alias("labels"))


def descendants(found: DataFrame, document: str = "document_id", key: str = "section_id") -> DataFrame:
    """ARR-04, ARR-09: (document, ancestor, id, distance) for each node above another on its path."""
    steps = found.select(document, key, "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.select(document, "ancestor", key, (F.col("depth") - 1 - F.col("at")).alias("distance")).filter("distance > 0")
