"""LM scoring by cross-entropy difference.

Two character n-gram models, one of target documents and one of all documents, share one vocabulary. Both are exact:
a table with a row for every n-gram of the corpus, (context of ``ORDER - 1`` characters, character), each packed
without loss, and its counts. Texts begin with ``ORDER - 1`` paddings, which are counted as context, so the first
character has a distribution as well.

Probabilities are interpolated (Witten-Bell): with N the count of a context, T the number of different characters that
follow it and p' the probability in the context that is one character shorter,

    p(c | context) = (count(context c) + T p'(c)) / (N + T),      p = p' where N = 0.

The shortest context is empty, and there p(c) = (count(c) + ALPHA) / (N + ALPHA V) with V the characters that occur in
the corpus (least count 1) and one for any other. So the probabilities of a context, seen or not, sum to 1 over the
vocabulary. The models are matched: the background is as large as the target. Its counts are scaled by the ratio s of
the sizes, and T becomes the number that a random part of that size is expected to keep, the sum of 1 - (1 - s)^count.

A document's score is the mean over its characters of its loss (-log2 p) under the target model less that under the
background model; the lower, the more it is like the target. So that no document is scored by a model that has seen
it, documents fall into two folds by a hash of their id, and each is scored by the models of the other fold.

The table grows with the corpus and never leaves the executors. Texts are dealt by hash to blocks of about
``BLOCK_BYTES``. A block sums up its n-grams before they move; these rows are its counts, and its questions: each block
gets back the losses of its own n-grams alone. Where a block's rows meet its labels or losses, they come first in one
sorted stream, so a task holds the n-grams of one block and one batch of texts. In the joins on the way a key stands
once a block, or once a character.

Cases: null and empty texts have no characters, and null losses and score; without a target document in a fold the
target model is the smoothing alone, and the background is not scaled; labels without a document, null or repeated
labels count as the greatest label of their id; rows with equal ids are scored one by one (those with equal texts too
in one task); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table

ORDER = 4
POINT_BITS = 21  # a code point and 1; 0 is padding
ALPHA = 0.5
FOLDS = 2
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20  # characters that are sorted at once
MODELS = [f"{kind}{fold}" for fold in range(FOLDS) for kind in ("all", "target")]


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(FOLDS)).cast("int")


def _chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each; a longer text is alone."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def grams(texts: list[str]):
    """(context, character) of each different n-gram of ``texts``, and for each character of them, one text after
    another, the number of its n-gram."""
    import numpy as np

    pad = ORDER - 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.zeros(int((sizes + pad).sum()), dtype=np.int64)
    inside = np.ones(len(points), dtype=bool)
    begin = np.cumsum(sizes + pad) - sizes - pad
    for j in range(pad):
        inside[begin + j] = False
    points[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points[inside] += 1
    at = np.flatnonzero(inside)
    seen, small = np.unique(points, return_inverse=True)
    bits = max(len(seen) - 1, 1).bit_length()
    key = np.zeros(len(at), dtype=np.int64)
    if bits * ORDER < 64:
        for j in range(pad, -1, -1):
            key = (key << bits) | small[at - j]
        found, number = np.unique(key, return_inverse=True)
        mask = (1 << bits) - 1
        parts = [seen[(found >> (bits * j)) & mask] for j in range(pad, -1, -1)]
    else:  # more than 2**15 different characters at once: contexts get numbers first
        for j in range(pad, 0, -1):
            key = (key << POINT_BITS) | points[at - j]
        contexts, place = np.unique(key, return_inverse=True)
        found, number = np.unique((place << POINT_BITS) | points[at], return_inverse=True)
        return contexts[found >> POINT_BITS], (found & ((1 << POINT_BITS) - 1)).astype(np.int32), number
    context = np.zeros(len(found), dtype=np.int64)
    for part in parts[:-1]:
        context = (context << POINT_BITS) | part
    return context, parts[-1].astype(np.int32), number


def _summed(context, char, *counts):
    """Rows with equal (context, char) in one, ordered by them, the counts added up."""
    import numpy as np

    order = np.lexsort((char, context))
    context, char = context[order], char[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (char[1:] != char[:-1])]))
    return context[first], char[first], *[np.add.reduceat(n[order], first) for n in counts]


def _by_block(batches: Iterator) -> Iterator[tuple[int, bool, object]]:
    """(block, begins, rows) of a stream that is sorted by its first column, as pieces of batches."""
    import numpy as np

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield int(block[lo]), block[lo] != last, batch.slice(lo, hi - lo)
            last = block[lo]


def _streamed(first: DataFrame, docs: DataFrame) -> DataFrame:
    """``first`` and ``docs`` (block, ...) as one table, blocks in a row, what is from ``first`` ahead."""
    both = first.withColumn("kind", F.lit(0)).unionByName(docs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind")


def counts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(block, context, char, n, n_target) of the n-grams of ``docs`` (block, doc_id, text); ``good`` (block, doc_id)
    are the target."""

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        target: set = set()
        held: list = []

        def merged():
            held[:] = [_summed(*[np.concatenate([x[j] for x in held]) for j in range(4)])]

        def out(block):
            merged()
            context, char, n, n_target = held[0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block, dtype=np.int64)), pa.array(context), pa.array(char), pa.array(n), pa.array(n_target)], names=["block", "context", "char", "n", "n_target"])

        now = None
        for block, begins, rows in _by_block(batches):
            if begins:
                if held:
                    yield out(now)
                now, target, held = block, set(), []
            kind, ids, texts = rows.column(1).to_numpy(), rows.column(2).to_pylist(), rows.column(3).to_pylist()
            target.update(i for i, k in zip(ids, kind, strict=True) if k == 0)
            some = [(t, i in target) for t, i, k in zip(texts, ids, kind, strict=True) if k == 1 and t]
            for lo, hi in _chunks([t for t, _ in some]):
                own = [t for t, _ in some[lo:hi]]
                context, char, number = grams(own)
                marked = np.repeat(np.array([x for _, x in some[lo:hi]], dtype=bool), [len(t) for t in own])
                held.append((context, char, np.bincount(number, minlength=len(char)), np.bincount(number[marked], minlength=len(char))))
                if len(held) > 16:
                    merged()
        if held:
            yield out(now)

    rows = _streamed(good.select("block", "doc_id"), docs).select("block", "kind", "doc_id", "text")
    return rows.mapInArrow(counted, "block long, context long, char int, n long, n_target long")


def losses(table_of_grams: DataFrame) -> DataFrame:
    """(context, char, and -log2 p under each of ``MODELS``) of n-grams with their counts in each of ``MODELS``.

    Rows with all counts 0 are n-grams that didn't occur; they get the probability that the models leave to them.
    """
    held = table_of_grams
    whole = held.groupBy("char").agg(*[F.sum(m).alias(m) for m in MODELS])
    sums = whole.agg(*[F.sum(m).alias(m) for m in MODELS], F.count_if(F.greatest(*MODELS) > 0).alias("chars")).collect()[0]  # one row
    vocabulary = sums["chars"] + 1
    size = {m: sums[m] or 0 for m in MODELS}
    scale = {m: 1.0 for m in MODELS}
    for fold in range(FOLDS):
        if size[f"target{fold}"]:
            scale[f"all{fold}"] = size[f"target{fold}"] / size[f"all{fold}"]
    found = whole.select(F.lit(0).cast("long").alias("context"), "char", *[((F.col(m) * scale[m] + ALPHA) / (size[m] * scale[m] + ALPHA * vocabulary)).alias(f"p_{m}") for m in MODELS])
    for k in range(1, ORDER):
        here = held
        if k < ORDER - 1:
            here = held.groupBy(F.col("context").bitwiseAND((1 << (POINT_BITS * k)) - 1).alias("context"), "char").agg(*[F.sum(m).alias(m) for m in MODELS])
        kinds = [F.sum(1 - F.pow(F.lit(1 - scale[m]), F.col(m))).alias(f"kinds_{m}") for m in MODELS]
        of = here.groupBy("context").agg(*[F.sum(m).alias(f"n_{m}") for m in MODELS], *kinds)
        shorter = found.select(F.col("context").alias("shorter"), "char", *[F.col(f"p_{m}").alias(f"q_{m}") for m in MODELS])
        met = here.withColumn("shorter", F.col("context").bitwiseAND((1 << (POINT_BITS * (k - 1))) - 1)).join(of, "context").join(shorter, ["shorter", "char"])
        p = lambda m: F.when(F.col(f"n_{m}") > 0, (F.col(m) * scale[m] + F.col(f"kinds_{m}") * F.col(f"q_{m}")) / (F.col(f"n_{m}") * scale[m] + F.col(f"kinds_{m}"))).otherwise(F.col(f"q_{m}"))
        found = met.select("context", "char", *[p(m).alias(f"p_{m}") for m in MODELS])
    return found.select("context", "char", *[(-F.log2(f"p_{m}")).alias(m) for m in MODELS])


def apply(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of ``docs`` (block, doc_id, text); ``answers`` (block,
    context, char, loss_target, loss_background) has all n-grams of each block."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []
        known = None

        def ready():
            parts = [np.concatenate([x[j] for x in held]) if held else np.empty(0) for j in range(4)]
            contexts, place = np.unique(parts[0].astype(np.int64), return_inverse=True)
            key = (place << POINT_BITS) | parts[1].astype(np.int64)
            order = np.argsort(key)
            return contexts, key[order], parts[2][order], parts[3][order]

        for _, begins, part in _by_block(batches):
            if begins:
                held, known = [], None
            kind = part.column(1).to_numpy()
            split = int(np.searchsorted(kind, 1))
            if split:
                held.append([part.column(j).slice(0, split).to_numpy(zero_copy_only=False) for j in (4, 5, 6, 7)])
            if split == len(kind):
                continue
            known = known or ready()
            contexts, keys, target, background = known
            ids, texts = part.column(2).slice(split), [t or "" for t in part.column(3).slice(split).to_pylist()]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            out = np.zeros((2, len(texts)))
            full = np.flatnonzero(sizes).tolist()
            for lo, hi in _chunks([texts[k] for k in full]):
                some = full[lo:hi]
                context, char, number = grams([texts[k] for k in some])
                at = np.searchsorted(keys, (np.searchsorted(contexts, context) << POINT_BITS) | char)
                begin = np.cumsum(sizes[some]) - sizes[some]
                for t, loss in enumerate((target, background)):
                    out[t, some] = np.add.reduceat(loss[at][number], begin)
            mean = out / np.maximum(sizes, 1)
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(mean[0], mask=none), pa.array(mean[1], mask=none), pa.array(mean[0] - mean[1], mask=none)],
                names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"],
            )

    both = _streamed(answers, docs).select("block", "kind", "doc_id", "text", "context", "char", "loss_target", "loss_background")
    return both.mapInArrow(rows, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of each row of ``docs`` (doc_id, text); the target are
    those whose ``label`` in ``labels`` (doc_id, ``label``) is over 0."""
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = -(-size // (FOLDS * block_bytes)) or 1
    fold = fold_of(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) * FOLDS + fold).alias("block"))
    named = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).alias("good")).filter("good")
    # Labels grow with the documents, so they are never broadcast, whatever their size.
    good = rows.filter("text <> ''").select("block", "doc_id").distinct().join(named.select("doc_id").hint("merge"), "doc_id")
    asked = checkpoint(counts(rows, good))
    of = {"all": "n", "target": "n_target"}
    found = asked.groupBy("context", "char").agg(*[F.sum(F.when(F.pmod("block", F.lit(FOLDS)) == fold, F.col(of[kind])).otherwise(0)).alias(f"{kind}{fold}") for fold in range(FOLDS) for kind in of])
    known = losses(checkpoint(found)).hint("merge")
    other = lambda kind: F.when(F.pmod("block", F.lit(FOLDS)) == 0, F.col(f"{kind}1")).otherwise(F.col(f"{kind}0"))
    answers = asked.select("block", "context", "char").join(known, ["context", "char"]).select("block", "context", "char", other("target").alias("loss_target"), other("all").alias("loss_background"))
    return apply(rows, answers)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document of ``documents``, against those that ``labels`` call good."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
