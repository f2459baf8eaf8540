"""Language-model scores by context-tree weighting over bytes.

A text is modelled as its words, lower-cased (A-Z), one space apart, and an end.
Each context of 0 to DEPTH bytes codes the next byte as eight binary decisions,
one for each node on the byte's path in the binary tree of bytes. Every pair of
context and node has a Krichevsky-Trofimov estimator, and a weighted probability
that is half its own estimate and half the product of those of the same node in
the longer contexts. With the counts of the training texts frozen, each pair so
gets a weight, and a bit's probability is the weighted mix of the estimates at all
depths of its context, up to the last one that training texts have.

The tree is never in one place: grams are counted in the tasks and added up by a
shuffle, dealt out by the last bytes of their contexts, and weighted from long
contexts to short and mixed from short to long. Grams of documents that aren't for training take part
with count 0, so that the table that results holds the code length of every gram
of every document; it grows with the corpus, and nothing is left out of it. The
HEAD_GRAMS most frequent grams are sent to the tasks, and every other gram of a
document is looked up by a join. Tokens are counted and looked up the same way,
with the HEAD_TOKENS most frequent sent to the tasks.

Defined cases: null texts are empty, that is, one end; a null id counts as an
empty text in the split; rows that repeat are scored each; without training
documents every token is unknown and bytes are equally likely; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from math import log, log2, log10, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.bytegrams import GramTable, arrays, body, count_grams, mask, pieces, sums, threshold
from quaestor.llm.common import binary_values, id_remainder, map_arrow, materialise, opened, read, share

DEPTH = 5
HEAD_GRAMS = 1 << 20
HEAD_TOKENS = 200_000
#: The documents with this remainder of crc32(id) are held out.
FOLDS, HELD_OUT = 7, 2
#: Tokens a task holds before it sends their counts.
_HELD = 400_000


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n) from rows (text); ends of texts aren't among them."""

    def run(batches):
        held: Counter = Counter()

        def out():
            tokens = list(held)
            for at in range(0, len(tokens), 100_000):
                part = tokens[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[t] for t in part], pa.int64())], ["token", "n"])
            held.clear()

        for batch in batches:
            for text in binary_values(batch.column(0)):
                held.update((text or b"").lower().split())
                if len(held) > _HELD:
                    yield from out()
        yield from out()

    return map_arrow(texts, run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _log_gamma(x, ln):
    """Of x > 0, a column or an array, to about 12 digits: Stirling's series at x + 8."""
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * ln(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - ln(product)


def _log_kt(x, y, ln):
    """Natural log of the KT probability of a sequence with ``x`` zeros and ``y`` ones (doubles)."""
    return _log_gamma(x + 0.5, ln) + _log_gamma(y + 0.5, ln) - log(pi) - _log_gamma(x + y + 1, ln)


class _Level:
    """Nodes of one depth: context, the bits that are known, a 1 and zeros, in one number."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        self.known = zeros + ones > 0
        own = np.where(self.known, _log_kt(zeros, ones, np.log), 0.0)
        self.weighted = own if below is None else np.where(self.known, np.logaddexp(own, below) - log(2), 0.0)
        # The part of a pair's own estimate in its weighted one.
        self.share = np.ones(len(own)) if below is None else np.exp(np.minimum(0.0, own - log(2) - self.weighted))


def subtrees(codes: np.ndarray, n: np.ndarray, depth: int, top: int):
    """The levels from ``depth`` to ``top`` of whole subtrees, with each node's place in the next level, and each gram's eight nodes and bits."""
    nodes = np.concatenate([codes >> np.uint64(8 - k) << np.uint64(8 - k) | np.uint64(1 << (7 - k)) for k in range(8)])
    bits = np.concatenate([(codes >> np.uint64(7 - k) & np.uint64(1)).astype(bool) for k in range(8)])
    times = np.tile(n.astype(float), 8)
    unique, place = np.unique(nodes, return_inverse=True)
    size = len(unique)
    levels = [_Level(unique, np.bincount(place[~bits], times[~bits], size), np.bincount(place[bits], times[bits], size), None)]
    ups = []
    for d in range(depth - 1, top - 1, -1):
        last = levels[-1]
        unique, up = np.unique(last.nodes & np.uint64(mask(d)), return_inverse=True)
        levels.append(_Level(unique, *(np.bincount(up, x, len(unique)) for x in (last.zeros, last.ones, last.weighted))))
        ups.append(up)
    return levels, ups, place, bits


def _by_subtree(rows: DataFrame, top: int, made, schema: str) -> DataFrame:
    """``made`` on whole subtrees of ``top`` bytes of context, from rows whose first column is a gram or a node."""
    context = F.shiftrightunsigned(rows.columns[0], 8).bitwiseAND(F.lit((1 << 8 * top) - 1).cast("long"))
    dealt = rows.withColumn("subtree", context).repartition("subtree").sortWithinPartitions("subtree")

    def run(batches):
        held, size = [], 0

        def joined():
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            done = int((new[-1] != new[-1][-1]).sum())  # the last subtree may go on in the next batch
            if size and (done or new[-1][0] != held[-1][-1][-1]) and size + done >= 50_000:
                held.append([x[:done] for x in new])
                yield made(joined())
                held, size, new = [], 0, [x[done:] for x in new]
            held.append(new)
            size += len(new[0])
        if size:
            yield made(joined())

    return map_arrow(dealt, run, schema)


#: Bytes of context of the subtrees that are weighted and mixed in one place each.
SUBTREE = 3


def code_lengths(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, bits), written: -log2 of the probability of each gram's byte after its context, from training counts (code, n).

    Subtrees of SUBTREE bytes of context are weighted first, each by itself; the levels
    above them are weighted and mixed by joins; then the subtrees are mixed.
    """
    top = min(SUBTREE, depth)

    def above(d: int) -> Column:
        return F.col("node").bitwiseAND(F.lit(mask(d)).cast("long"))

    def weigh(columns):
        codes, n = columns[0].view(np.uint64), columns[1]
        order = np.argsort(codes)
        level = subtrees(codes[order], n[order], depth, top)[0][-1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (level.nodes.view(np.int64), level.zeros, level.ones, level.weighted, level.share)], ["node", "zeros", "ones", "weighted", "share"])

    def mixed(columns):
        codes, n, before, left, p, _ = columns
        gram = np.isnan(p)
        nodes, own = codes[~gram].view(np.uint64), codes[gram].view(np.uint64)
        order = np.argsort(own)
        own = own[order]
        levels, ups, place, bits = subtrees(own, n[gram][order], depth, top)
        order = np.argsort(nodes)  # the same nodes as those of the top level
        before, left, p = (x[~gram][order] for x in (before, left, p))
        for level, up in zip(levels[-2::-1], ups[::-1], strict=True):
            one = (level.ones + 0.5) / (level.zeros + level.ones + 1)
            before, left, p = before[up], left[up], p[up]
            p = np.where(level.known, before + left * one, p)
            before, left = before + left * level.share * one, left * (1 - level.share)
        found = np.where(bits, p[place], 1 - p[place])
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(-np.log2(found).reshape(8, -1).sum(axis=0))], ["code", "bits"])

    levels = [materialise(_by_subtree(grams.select("code", "n"), top, weigh, "node long, zeros double, ones double, weighted double, share double"))]
    seen = F.col("zeros") + F.col("ones") > 0
    for d in range(top - 1, -1, -1):
        rows = levels[-1].groupBy(above(d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        rows = rows.withColumn("own", F.when(seen, _log_kt(F.col("zeros"), F.col("ones"), F.log)).otherwise(0.0))
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - log(2)
        rows = rows.withColumn("weighted", F.when(seen, both).otherwise(0.0))
        levels.append(materialise(rows.select("node", "zeros", "ones", "weighted", F.exp(F.least(F.lit(0.0), F.col("own") - log(2) - F.col("weighted"))).alias("share"))))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    last = None
    for d, level in enumerate(reversed(levels)):
        if last is None:
            rows = level.withColumns({"before": F.lit(0.0), "reach": F.lit(1.0), "p0": F.lit(0.5)})
        else:
            parent = last.select(F.col("node").alias("parent"), F.col("mixed").alias("before"), F.col("left").alias("reach"), F.col("p").alias("p0"))
            rows = level.withColumn("parent", above(d - 1)).join(parent, "parent")
        # p: the probability of a 1 if the context goes no further; it doesn't where no training text has the pair.
        last = rows.select(
            "node",
            (F.col("before") + F.col("reach") * F.col("share") * one).alias("mixed"),
            (F.col("reach") * (1 - F.col("share"))).alias("left"),
            F.when(seen, F.col("before") + F.col("reach") * one).otherwise(F.col("p0")).alias("p"),
        )
    none = F.lit(float("nan"))
    rows = grams.select("code", "n", none.alias("mixed"), none.alias("left"), none.alias("p")).unionByName(last.select(F.col("node").alias("code"), F.lit(0).cast("long").alias("n"), "mixed", "left", "p"))
    return materialise(_by_subtree(rows, top, mixed, "code long, bits double"))


def gram_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, n, uses), written, from rows (learn: 0 or 1, text): counts in training texts and in all texts."""
    counts = count_grams(rows, depth, keys=2)
    return materialise(counts.groupBy("code").agg(F.sum(F.col("n") * F.col("key")).alias("n"), F.sum("n").alias("uses")))


class Head:
    """Code lengths of the most frequent grams, in one model or, a column each, in several."""

    def __init__(self, codes: np.ndarray, bits: np.ndarray, depth: int):
        self.codes, self.bits, self.depth, self.table = codes, bits, depth, None

    def score(self, bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each text: the bits of its grams that are here, and the other grams with how often they occur."""
        if self.table is None:  # once in each worker
            self.table = GramTable(self.codes)
        total, rest = np.zeros((len(bodies), *self.bits.shape[1:])), [[] for _ in bodies]
        for grams, first, end, owner in pieces(bodies, self.depth):
            at = self.table.find(grams)
            bits = self.bits[np.maximum(at, 0)] if len(self.bits) else np.zeros((len(grams), *self.bits.shape[1:]))
            bits[at < 0] = 0
            sums(bits, first, end, owner, total)
            left = np.flatnonzero(at < 0)
            run = np.searchsorted(end, left, "right")
            inside = left >= first[run]  # not among the bytes before a run
            left, run = left[inside], run[inside]
            edge = np.flatnonzero(np.diff(run)) + 1
            for part, r in zip(np.split(grams[left], edge), run[np.r_[0, edge]] if len(run) else (), strict=False):
                rest[owner[r]].append(part)
        found = [np.unique(np.concatenate(r), return_counts=True) if r else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for r in rest]
        return total, [f[0] for f in found], [f[1] for f in found]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, head_grams: int = HEAD_GRAMS, head_tokens: int = HEAD_TOKENS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (id_remainder(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    training = rows.filter(~F.col("held_out"))
    tokens = materialise(count_tokens(training.select("text")))
    n_train = training.select("held_out").count()
    words, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = words + n_train, kinds + (n_train > 0)
    bottom = log10(total + distinct + 1)
    head = tokens.filter(F.col("n") >= threshold(tokens, "n", head_tokens)).toArrow()
    known = {t: n for t, n in zip(head.column("token").to_pylist(), head.column("n").to_pylist(), strict=True)}
    grams = gram_counts(rows.select((~F.col("held_out")).cast("int").alias("learn"), "text"), depth)
    lengths = code_lengths(grams, depth)
    least = threshold(grams, "uses", head_grams)
    frequent = grams.filter(F.col("uses") >= least).select("code").join(lengths, "code").select("code", "bits")
    shared = share(spark, (known, Head(*arrays(frequent), depth)))

    def run(batches):
        from pyspark import TaskContext

        known, model = opened(shared)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = binary_values(batch.column(2))
            n_tokens, n_known, base, rest, rest_n = [], [], [], [], []
            for text in texts:
                held = Counter((text or b"").lower().split())
                sure, value, other, other_n = n_train > 0, log10(n_train + 1) - bottom, [], []
                for token, n in held.items():
                    if count := known.get(token):
                        sure += n
                        value += n * (log10(count + 1) - bottom)
                    else:
                        other.append(token)
                        other_n.append(n)
                n_tokens.append(held.total() + 1)
                n_known.append(int(sure))
                base.append(value)
                rest.append(other)
                rest_n.append(other_n)
            bits, codes, times = model.score([body(t) for t in texts])
            numbers = pa.array(np.arange(number, number + len(texts)))
            number += len(texts)
            columns = [numbers, batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(bits), pa.array(rest, pa.list_(pa.binary())), pa.array(rest_n, pa.list_(pa.int32())), pa.array([c.view(np.int64) for c in codes], pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "held_out", "n_tokens", "n_known", "base", "bits", "rest", "rest_n", "codes", "codes_n"])

    # Written, so that row numbers stay as they are.
    scored = materialise(map_arrow(rows, run, "row long, id long, held_out boolean, n_tokens long, n_known long, base double, bits double, rest array<binary>, rest_n array<int>, codes array<long>, codes_n array<long>"))
    each = scored.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.rest_n").alias("times"))
    count = F.coalesce("n", F.lit(0))
    found = each.join(tokens, "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(count + 1) - F.lit(bottom))).alias("more"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("also"),
    )
    rare = scored.select("row", F.explode(F.arrays_zip("codes", "codes_n")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.codes_n").alias("times"))
    rare = rare.join(lengths, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("bits")).alias("more_bits"))
    return scored.drop("rest", "rest_n", "codes", "codes_n").join(found, "row", "left").join(rare, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (-(F.col("bits") + F.coalesce("more_bits", F.lit(0.0))) / log2(10)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
