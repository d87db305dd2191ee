"""URL filters: host and path rules, and per host a tree of path templates.

Rules decide the pages that they fit. The others are judged by where they lie in their host's path-template tree:

1. Segments lose what varies by form: runs of digits, and long hexadecimal runs, become placeholders.
2. Level by level, the segments under a node that has more than ``max_branch`` of them are wildcards, but for those
   that hold a tenth of its pages.
3. Sibling branches that are statistically alike are merged: of the clusters next to each other by their share of good
   pages the closest two join, again and again, as long as their pooled shares differ by at most ``z`` standard errors.
   Branches without a labelled page have nothing to say; they are one cluster of their own.
4. A template is rejected if its share of good labels is under ``least_purity``. The share is smoothed towards that of
   the node above it, and so on up to the host's and the corpus's, so a template without labels has its parent's.

The tree is built over distinct (host, masked path) with their counts, which are summed up before they move; what a
level decides about a node's branches is joined to them by host, parent and segment; a node's branches (not its paths)
meet its sums in a sort-merge join, which adaptive execution splits if one node has most of them. Clusters are made of the branches
that are left after step 2, of which a node has no more than ``max_branch`` or eleven. Keys with more than a thousandth
of the rows, such as a host with a third of all pages, are spread by salt (``common.spread_join``).

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the template of
the empty path; paths with more than ``depth`` segments keep the rest as one segment; rows with equal ids or urls are
judged one by one, all alike; without any label every page is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, spread_join, table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def masked(path: Column) -> Column:
    """The path with what varies by form replaced."""
    path = F.regexp_replace(path, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{u}")
    path = F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{12,}(?![0-9a-z])", "{x}")
    return F.regexp_replace(path, "[0-9]+", "{n}")


def _clusters(branches: Column, z: float) -> Column:
    """array<struct<groups, good, labelled>> of branches struct<share, group, good, labelled> in order of their shares."""
    one = F.transform(branches, lambda x: F.struct(F.array(x["group"]).alias("groups"), x["good"].alias("good"), x["labelled"].alias("labelled")))

    def apart(x, y):
        both = (x["good"] + y["good"]) / (x["labelled"] + y["labelled"])
        error = F.sqrt(both * (1 - both) * (1 / x["labelled"] + 1 / y["labelled"]))
        return F.when(error > 0, F.abs(x["good"] / x["labelled"] - y["good"] / y["labelled"]) / error).otherwise(0.0)

    def joined(a, best):
        x, y = F.get(a, best["at"]), F.get(a, best["at"] + 1)
        pair = F.struct(F.concat(x["groups"], y["groups"]).alias("groups"), (x["good"] + y["good"]).alias("good"), (x["labelled"] + y["labelled"]).alias("labelled"))
        return F.when(best["apart"] > z, a).otherwise(F.concat(F.slice(a, F.lit(1), best["at"]), F.array(pair), F.slice(a, best["at"] + 3, F.size(a))))

    def step(a, _):
        pairs = F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.struct(apart(F.get(a, i), F.get(a, i + 1)).alias("apart"), i.alias("at")))
        return F.when(F.size(a) < 2, a).otherwise(F.get(F.transform(F.array(F.array_min(pairs)), lambda best: joined(a, best)), 0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(branches), F.lit(1))), one, step)


def _level(paths: DataFrame, level: int, max_branch: int, z: float, total: int) -> DataFrame:
    """``paths`` (``total`` rows) with segment ``level`` of ``template`` generalised."""
    parent = F.array_join(F.slice("template", 1, level), "/")
    here = paths.withColumn("parent", parent).withColumn("segment", F.get("template", F.lit(level)))
    branches = here.filter("segment is not null").groupBy("host", "parent", "segment").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled"), F.count("*").alias("n_paths"))
    branches = checkpoint(branches)
    nodes = branches.groupBy("host", "parent").agg(F.count("*").alias("n_branches"), F.sum("n").alias("n_node"))
    kinds = branches.join(nodes, ["host", "parent"]).withColumn("group", F.when((F.col("n_branches") > max_branch) & (F.col("n") * 10 < F.col("n_node")), "*").otherwise(F.col("segment")))
    left = kinds.groupBy("host", "parent", "group").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    known = F.struct((F.col("good") / F.nullif("labelled", F.lit(0))).alias("share"), "group", "good", "labelled")
    node = left.groupBy("host", "parent").agg(F.array_sort(F.collect_list(known)).alias("all"))
    silent = F.filter("all", lambda x: x["labelled"] == 0)
    clusters = F.concat(F.transform(_clusters(F.filter("all", lambda x: x["labelled"] > 0), z), lambda c: c["groups"]), F.when(F.size(silent) > 0, F.array(F.transform(silent, lambda x: x["group"]))).otherwise(F.array().cast("array<array<string>>")))
    named = node.select("host", "parent", F.explode(clusters).alias("groups")).withColumn("groups", F.sort_array("groups"))
    name = F.when(F.size("groups") == 1, F.get("groups", 0)).when(F.array_contains("groups", "*"), "*").otherwise(F.concat(F.lit("("), F.array_join("groups", "|"), F.lit(")")))
    named = named.select("host", "parent", name.alias("merged"), F.explode("groups").alias("group"))
    decided = checkpoint(kinds.join(named, ["host", "parent", "group"]).select("host", "parent", "segment", "merged", "n_paths"))
    done = spread_join(here, decided, ["host", "parent", "segment"], "n_paths", total, "left")
    template = F.when(F.col("merged").isNull(), F.col("template")).otherwise(F.concat(F.slice("template", 1, level), F.array("merged"), F.slice("template", level + 2, F.greatest(F.size("template"), F.lit(1)))))
    return done.select("host", "masked", "n", "good", "labelled", template.alias("template"))


def purities(leaves: DataFrame, prior: float, weight: float) -> DataFrame:
    """(host, template, purity) of ``leaves`` (host, template: its segments, good, labelled): the share of good labels
    of each node, smoothed by ``weight`` labels towards that of the node above; ``prior`` stands above the hosts."""
    steps = leaves.select("*", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level")).withColumn("node", F.slice("template", F.lit(1), F.col("level")))
    nodes = steps.groupBy("host", "node").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    line = F.array_sort(F.collect_list(F.struct("level", "g", "l")))
    purity = F.aggregate(line, F.lit(float(prior)), lambda a, x: (x["g"] + a * weight) / (x["l"] + weight))
    return steps.select("host", "template", "node", "level").join(nodes, ["host", "node"]).groupBy("host", "template").agg(purity.alias("purity"))


def template_tree(paths: DataFrame, depth: int = 6, max_branch: int = 16, z: float = 2.0, weight: float = 2.0) -> DataFrame:
    """(host, masked, n, template, purity) of ``paths`` (host, masked, n, good, labelled: counts of its pages)."""
    whole = paths.agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"), F.count("*").alias("n")).collect()[0]
    prior = ((whole["good"] or 0) + 1) / ((whole["labelled"] or 0) + 2) if whole["labelled"] else 1.0
    parts = F.split(F.regexp_replace("masked", "^/", ""), "/", -1)
    rest = F.array_join(F.slice(parts, depth, F.size(parts)), "/")
    paths = paths.withColumn("template", F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(rest))).otherwise(parts))
    for level in range(depth):
        if level and not paths.filter(F.size("template") > level).limit(1).collect():
            break
        paths = checkpoint(_level(paths, level, max_branch, z, whole["n"]))
    leaves = checkpoint(paths.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"), F.count("*").alias("n_paths")))
    judged = purities(leaves, prior, weight).join(leaves.select("host", "template", "n_paths"), ["host", "template"])
    return spread_join(paths.select("host", "masked", "n", "template"), judged, ["host", "template"], "n_paths", whole["n"]).select("host", "masked", "n", F.array_join("template", "/").alias("template"), "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, label: str | None = None, least_purity: float = 0.5, depth: int = 6, max_branch: int = 16, z: float = 2.0, weight: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages`` (page_id, url).

    ``label`` names a boolean column of good pages, null where unknown; without it the rules' verdicts are the labels.
    """
    host, path = host_and_path(F.col("url"))
    good = F.col(label).cast("boolean") if label else F.col("fits.verdict") == "allow"
    rows = pages.select("page_id", "url", *([label] if label else [])).select("*", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fits", masked(F.col("path")).alias("masked"), good.alias("good"))
    paths = rows.groupBy("host", "masked").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count("good").alias("labelled"))
    paths = checkpoint(paths)
    tree = checkpoint(template_tree(paths, depth, max_branch, z, weight))
    total = paths.agg(F.sum("n")).collect()[0][0] or 0
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("purity") >= least_purity, "allow").otherwise("block"))
    return spread_join(rows, tree, ["host", "masked"], "n", total).select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every url of ``pages``, with the rules above."""
    return judge(table(spark, sf_dir, "pages"))
