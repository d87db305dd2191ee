"""N-gram Jaccard join by T-occurrence search.

Two documents link if the Jaccard likeness of their sets of word shingles reaches the threshold; the join gives each
document its component. Documents with equal sets are one node from the start.

Two sets that link share so many of the shingles that come first in any common order that a count decides early:

1. Each node lists its first shingles in the order of their hashes: as many as may be missing from a partner, and a
   tenth of the set beside (``first``). A partner has at least ``need`` of them in its own list.
2. Inverted lists: a shingle that a single node lists is dropped. Nodes with under ``need`` shingles left have no
   partner; most nodes end here.
3. A node sets aside its ``need - 1`` longest lists; a partner must be met in one of the others. Every list that is
   left sends its nodes to a group that is named after the list's least node, so a node goes to few groups.
4. In a group, whole sets meet: an inverted index of the group answers a T-occurrence search for each node. The long
   lists are set aside, the short ones are merged, and candidates that can still reach the required overlap are
   probed in the long lists by binary search. Candidates already in the node's component are skipped.
5. The links found, at most one for each node but one of a group, are joined to components.

A large group is dealt out in chunks, twice. First each chunk is searched together with a few leaders of the group,
which joins nearly all of a group of near copies at a cost in proportion to its size. Then only nodes outside the
group's main component can have links that are still missing: these stragglers are searched against every chunk. So no
task holds more than two chunks, and nothing is capped: every list takes part in step 2, every group in step 4, and a
pair that isn't searched is connected already.

Nodes and shingles are known by 64-bit hashes.

Cases: null text and text without words have an empty set, are linked with nothing and are their own component; texts
with fewer words than a shingle have one shingle of all words; rows with equal texts are one node; a null doc_id takes
part, but names a component only if no row of it has an id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary_values, bit_of, bitmap, checkpoint, forget, shingle_hashes, table, text_key
from .components import components

SHINGLE = 4
LIKE = (85, 100)
SPARE = 10  # one in so many shingles is listed beside those that may be missing
CHUNK = 512
LEADERS = 16
SALTS = 16
MAP_BITS = 23


def shingles(text: bytes | None, hashes: WordHashes, k: int = SHINGLE):
    """The set of hashed word shingles, in ascending order, as uint64."""
    import numpy as np

    return np.unique(shingle_hashes((text or b"").lower().split(), hashes, k))  # bytes: only A-Z are lowered, only ASCII white space splits


def _least(n: int, like: tuple[int, int]) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-n * like[0] // like[1])


def _key(values) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(values.tobytes()) - (1 << 63)


def _listed(docs: DataFrame, k: int, like: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, node, n, need, first of each row; first is null where the partition has listed the node before."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes, seen = WordHashes(), set()
        for batch in batches:
            nodes, sizes, needs, firsts = [], [], [], []
            for text in binary_values(batch.column(2)):
                own = shingles(text, hashes, k)
                n = len(own)
                node = _key(own)
                nodes.append(node)
                sizes.append(n)
                needs.append(max(1, _least(n, like) // SPARE))
                if n and node not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    firsts.append(own[: n - _least(n, like) + max(1, n // SPARE)].view(np.int64))
                else:
                    firsts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(needs, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=["doc_id", "text_key", "node", "n", "need", "first"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(rows, "doc_id long, text_key long, node long, n long, need int, first array<long>")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, own (its set, as bytes) of the rows whose doc_id may be among ``ids``."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(bit_of(F.col("doc_id"), MAP_BITS)), MAP_BITS))  # 1 MB

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes, bits = WordHashes(), np.frombuffer(held.value, dtype=np.uint32)
        for batch in batches:
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            found = [shingles(text, hashes, k) for text in binary_values(batch.column(1))]
            for lo in range(0, len(found), 256):
                some = found[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in some], pa.int64()), pa.array([x.tobytes() for x in some], pa.binary())], names=["node", "own"])

    return docs.select(bit_of(F.col("doc_id").cast("long"), MAP_BITS).alias("bit"), "text").mapInArrow(rows, "node long, own binary")


def search(nodes: list[int], sets: list, like: tuple[int, int] = LIKE, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between ``nodes`` with the given ascending ``sets`` that join all that are connected in this group.

    ``roots``: the component that each node is known to be in; without it each is its own.
    """
    import numpy as np

    order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
    known = [(roots or nodes)[i] for i in order]
    nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
    m = len(nodes)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    terms, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    posting = np.sort(place * m + np.repeat(np.arange(m), sizes))  # list after list, documents ascending
    docs = posting % m
    start = np.concatenate([[0], np.cumsum(df)])
    label = np.unique(np.array(known, dtype=np.int64), return_inverse=True)[1]
    links = []
    for x in range(1, m):
        own = place[begin[x] : begin[x + 1]]
        own = own[df[own] > 1]
        least = _least(int(sizes[x]), like)
        if len(own) < least:
            continue
        own = own[np.argsort(df[own], kind="stable")]
        aside = least - 1  # a partner is met in the short lists at least once
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        met = np.zeros(m, dtype=np.int64)
        for t in short:
            met[docs[start[t] : start[t + 1]]] += 1
        candidates = np.flatnonzero(met[:x])
        # Overlap needed with each candidate, and whether the lists that are left can still give it.
        needed = -(-like[0] * (sizes[candidates] + sizes[x]) // (like[0] + like[1]))
        keep = met[candidates] + len(long) >= needed
        candidates, needed = candidates[keep], needed[keep]
        best = np.argsort(-met[candidates], kind="stable")
        candidates, needed = candidates[best], needed[best]
        block = 1
        while len(candidates):
            apart = label[candidates] != label[x]
            candidates, needed = candidates[apart], needed[apart]
            some, want = candidates[:block], needed[:block]
            candidates, needed = candidates[block:], needed[block:]
            if not len(some):
                break
            probes = (long[:, None] * m + some[None, :]).ravel()
            at = np.minimum(np.searchsorted(posting, probes), len(posting) - 1)
            overlap = met[some] + (posting[at] == probes).reshape(len(long), len(some)).sum(axis=0)
            for y in some[overlap >= want]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    links.append((nodes[x], nodes[y]))
            block = min(block * 4, 256)
    return links


def _linked(jobs: DataFrame, like: tuple[int, int]) -> DataFrame:
    """Links (u, v) of the searches in ``jobs`` (job, node, root, own), of which each lies in one partition, in a row."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(group):
            if len(group) < 2:
                return []
            return search(list(group), [np.frombuffer(x, dtype=np.uint64) for _, x in group.values()], like, [r for r, _ in group.values()])

        job, group, found = None, {}, []
        for batch in batches:
            for j, node, root, own in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if j != job:
                    found += out(group)
                    job, group = j, {}
                group.setdefault(node, (root, own.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])
            found = []
        found = out(group)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    return jobs.repartition("job").sortWithinPartitions("job").mapInArrow(rows, "u long, v long")


def groups(listed: DataFrame) -> DataFrame:
    """(pivot, node): the groups in which a node can meet its partners; steps 2 and 3 above."""
    rows = listed.filter("first is not null").select("node", "need", F.explode("first").alias("term"))
    lists = rows.groupBy("term").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot <> other")
    left = rows.join(lists, "term").groupBy("node", "need").agg(F.sort_array(F.collect_set(F.struct("n", "term", "pivot")), asc=False).alias("lists"))
    short = F.array_distinct(F.transform(F.slice("lists", F.col("need"), F.size("lists")), lambda x: x["pivot"]))
    return left.filter(F.size("lists") >= F.col("need")).select(F.explode(short).alias("pivot"), "node")


def _salted(members: DataFrame, of_pivot: DataFrame) -> DataFrame:
    """Members with what is known of their group; a large group is spread over tasks by salt."""
    known = of_pivot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(known, ["pivot", "salt"]).drop("salt")


def _chunk(n: str, chunk: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", "pivot", F.lit(seed)), F.greatest(F.ceil(F.col(n) / chunk), F.lit(1)))


def _upto(n: str, chunk: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(n) / chunk), F.lit(1)) - 1)


def first_jobs(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(job, node, root): each group, or each chunk of a large one with the group's leaders."""
    sizes = members.groupBy("pivot").agg(F.count("*").alias("m")).filter("m > 1")
    leader = (F.col("m") > chunk) & (_chunk("m", LEADERS, 1) == 0)
    where = F.when(leader, _upto("m", chunk)).otherwise(F.array(_chunk("m", chunk, 0)))
    return _salted(members, sizes).select("pivot", "node", F.explode(where).alias("at")).select(F.xxhash64("pivot", "at").alias("job"), "node", F.col("node").alias("root"))


def second_jobs(members: DataFrame, found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(job, node, root): in large groups, chunks of the nodes outside the main component with every chunk."""
    sizes = members.groupBy("pivot").agg(F.count("*").alias("m")).filter(F.col("m") > chunk)
    large = _salted(members, sizes).join(found, "node", "left").select("pivot", "node", "m", F.coalesce("root", "node").alias("root"))
    main = large.groupBy("pivot", "m", "root").agg(F.count("*").alias("n")).groupBy("pivot", "m").agg(F.max(F.struct("n", "root")).alias("main")).select("pivot", F.col("main.root").alias("main"), (F.col("m") - F.col("main.n")).alias("apart")).filter("apart > 0")
    rows = _salted(large, main)
    cells = F.transform(_upto("apart", chunk), lambda j: F.struct(_chunk("m", chunk, 2).alias("i"), j.alias("j")))
    own = F.transform(_upto("m", chunk), lambda i: F.struct(i.alias("i"), _chunk("apart", chunk, 3).alias("j")))
    cells = F.when(F.col("root") == F.col("main"), cells).otherwise(F.concat(cells, own))
    return rows.select("pivot", "node", "root", F.explode(F.array_distinct(cells)).alias("at")).select(F.xxhash64("pivot", "at.i", "at.j").alias("job"), "node", "root")


def join(docs: DataFrame, k: int = SHINGLE, like: tuple[int, int] = LIKE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of each row of ``docs`` (doc_id, text)."""
    return linked(docs, k, like, chunk).drop("text_key", "root")


def linked(docs: DataFrame, k: int = SHINGLE, like: tuple[int, int] = LIKE, chunk: int = CHUNK) -> DataFrame:
    """``join`` with text_key (``common.text_key``), which tells rows apart that share an id, and root, which names a
    row's component whatever the ids in it; it is null for rows without words."""
    with_lists = checkpoint(_listed(docs, k, like))
    members = checkpoint(groups(with_lists))
    listed = checkpoint(with_lists.drop("need", "first"))
    forget(with_lists)
    heads = listed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("head"))

    def links(jobs: DataFrame) -> DataFrame:
        chosen = heads.join(jobs.select("node").distinct(), "node", "left_semi").select(F.col("head").alias("doc_id"))
        return _linked(jobs.join(_sets(docs, chosen, k), "node").select("job", "node", "root", "own"), like)

    first = checkpoint(links(first_jobs(members, chunk)))
    found = components(first)
    second = checkpoint(second_jobs(members, found, chunk))
    if second.limit(1).collect():
        found = components(first.unionAll(links(second)))
    forget(members, first, second)
    rooted = heads.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "head")
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id", "root")
    out = listed.filter("n > 0").select("doc_id", "text_key", "node", "n").join(named, "node").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "root")
    return out.unionAll(listed.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document of ``documents``."""
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS u, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT u, array_to_string(w[p : p + least(4, len(w)) - 1], ' ') AS gram
  FROM (SELECT u, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT u, count(*) AS n FROM s GROUP BY u
), met AS (
  SELECT a.u AS x, b.u AS y, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.u <> b.u GROUP BY a.u, b.u
), links AS (
  SELECT x, y FROM met JOIN n p ON p.u = x JOIN n q ON q.u = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reach AS (
  SELECT u AS x, u AS y FROM d
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach r ON r.x = d.u JOIN d e ON e.u = r.y LEFT JOIN n ON n.u = d.u GROUP BY d.u, d.doc_id
"""
