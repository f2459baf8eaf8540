"""Near-dedup by SimHash with bit-sliced comparison.

A fingerprint has a bit set if more than half of the hashes of a text's word
shingles have it. Two fingerprints link if they differ in at most RADIUS bits.

Candidates: with 64 bits in 6 blocks, fingerprints that differ in 4 bits agree
in 2 whole blocks at least, so each distinct fingerprint goes to the 15 buckets
of its block pairs, and no link is missed. In a bucket the fingerprints are
stored as bit planes, so one word operation works on 64 of them; a carry-save
counter adds up the differing bits of many pairs, and a block is left as soon as
all its pairs are beyond the radius. Only a spanning forest of a bucket's links
leaves the task. A bucket of more than SPLIT fingerprints is dealt out as pairs
of parts, so that neither memory nor time of a task follows it.

Defined cases: a null or wordless text has fingerprint zero, which links like
any other; fewer words than a shingle give one shingle; equal fingerprints,
repeated rows and repeated ids are one node; null ids take part and never become
a component's id unless it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.common import binary_values, free_name, map_arrow, materialise, read, sized, with_arrow_column
from quaestor.llm.components import beside, components

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one bucket that one task compares with each other.
SPLIT = 16_384
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the bytes of a text, as an unsigned number."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and the six ASCII white spaces
    if not words:
        return 0
    if len(words) > shingle:
        parts = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
    else:
        parts = [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(parts)
    for at in range(0, n, 8192):
        h = np.array([digest(x, SEED) for x in parts[at : at + 8192]], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in binary_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return map_arrow(rows, run, "id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """A row for each bit; 64 fingerprints in each word. Fingerprints of several words: one in each row of ``fps``."""
    words = fps.reshape(len(fps), -1)
    wide = -(-len(fps) // 64) * 64
    padded = np.zeros((wide, words.shape[1]), np.uint64)
    padded[: len(fps)] = words
    bits = np.unpackbits(padded.view(np.uint8).reshape(wide, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def counters(radius: int, shape) -> list[np.ndarray]:
    """Counter bits that hold ``radius``, and one that stays set once they run over."""
    return [np.zeros(shape, np.uint64) for _ in range(radius.bit_length() + 1)]


def _add(state: list[np.ndarray], plane: np.ndarray) -> None:
    """Carry-save: adds one differing bit of many pairs."""
    for k in range(len(state) - 1):
        carry = state[k] & plane
        state[k] ^= plane
        plane = carry
    state[-1] |= plane


def _beyond(state: list[np.ndarray], radius: int) -> np.ndarray:
    """Pairs with a count over ``radius``."""
    over, same = np.zeros_like(state[0]), np.full_like(state[0], ALL)
    for k in range(len(state) - 2, -1, -1):
        if radius >> k & 1:
            same &= state[k]
        else:
            over |= same & state[k]
            same &= ~state[k]
    return over | state[-1]


#: Planes between two looks at what is still within the radius, and fingerprints that are compared with a block at once.
LOOK, TILE = 8, 32
#: Words of counters that were updated, and those that all planes would take.
work = {"done": 0, "whole": 0}


def hits(queries: np.ndarray, block: np.ndarray, radius: int, upper: bool = False):
    """(at, columns, bits): for TILE queries from ``at`` on, the words of the block, 64 fingerprints each, that have pairs within the radius, and those pairs.

    Words are abandoned as soon as all their pairs are beyond the radius. upper:
    the block is the queries, and only pairs (i, j) with i < j count.
    """
    if not len(queries) or not len(block):
        return
    vertical, own = planes(block), planes(queries)
    n_bits, n_words = vertical.shape
    inside = np.packbits(np.arange(n_words * 64) < len(block), bitorder="little").view(np.uint64)
    for at in range(0, len(queries), TILE):
        n = min(TILE, len(queries) - at)
        allowed = np.broadcast_to(inside, (n, n_words))
        columns = np.arange(at // 64 if upper else 0, n_words)
        if upper:
            later = np.arange(n_words * 64) > np.arange(at, at + n)[:, None]
            allowed = allowed & np.packbits(later, axis=1, bitorder="little").view(np.uint64)
        allowed = allowed[:, columns]
        flips = (own[:, at // 64] >> np.uint64(at % 64))[:, None] >> np.arange(n, dtype=np.uint64) & np.uint64(1)
        flips = np.where(flips, ALL, np.uint64(0))[:, :, None]
        state = counters(radius, allowed.shape)
        work["whole"] += n * n_words * n_bits
        for bit in range(n_bits):
            _add(state, vertical[bit, columns] ^ flips[bit])
            work["done"] += state[0].size
            if bit % LOOK == LOOK - 1 or bit == n_bits - 1:
                alive = ~_beyond(state, radius) & allowed
                on = alive.any(axis=0)
                if not on.all():
                    columns, allowed, state = columns[on], allowed[:, on], [x[:, on] for x in state]
                if not len(columns):
                    break
        else:
            yield at, columns, ~_beyond(state, radius) & allowed


def within(queries: np.ndarray, block: np.ndarray, radius: int = RADIUS, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in queries, j in block) of all pairs that differ in at most ``radius`` bits; upper: as in ``hits``."""
    found = []
    for at, columns, bits in hits(queries, block, radius, upper):
        i, j = np.nonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little"))
        found.append((i + at, columns[j // 64] * 64 + j % 64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Mask of the pairs (a[k], b[k]) that differ in at most ``radius`` bits, by vertical counters over all pairs."""
    good = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        vertical = planes(a[at : at + (1 << 16)] ^ b[at : at + (1 << 16)])
        n_bits, n_words = vertical.shape
        columns, state = np.arange(n_words), counters(radius, n_words)
        out = np.zeros(n_words, np.uint64)
        for bit in range(n_bits):
            _add(state, vertical[bit, columns])
            work["done"] += len(columns)
            if bit % LOOK == LOOK - 1:
                on = _beyond(state, radius) != ALL
                if not on.all():
                    columns, state = columns[on], [x[on] for x in state]
                if not len(columns):
                    break
        work["whole"] += n_words * n_bits
        out[columns] = ~_beyond(state, radius)
        n = min(1 << 16, len(a) - at)
        good[at : at + n] = np.unpackbits(out.view(np.uint8), bitorder="little")[:n]
    return good


def forest(a, b) -> dict[int, int]:
    """Union-find over pairs: each node but the roots -> its root, the smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


#: Buckets up to this size are compared by shifts of all rows at once.
_SHIFTS = 64


def _bucket_links(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> dict[int, int]:
    """Forest of the links in whole buckets; rows are sorted by key. side: 0 all with all; 1 and 2: 1 with 2 alone."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    row_size = np.repeat(sizes, sizes)
    small = np.flatnonzero((row_size > 1) & (row_size <= _SHIFTS))
    a, b = [], []
    for lag in range(1, _SHIFTS):
        at = small[(small + lag < len(keys))]
        at = at[keys[at] == keys[np.minimum(at + lag, len(keys) - 1)]]
        if not len(at):
            break
        at = at[(side[at] == 0) | (side[at] != side[at + lag])]
        hit = at[pairs_within(fps[at], fps[at + lag], radius)]
        a.append(fps[hit])
        b.append(fps[hit + lag])
    for s, n in zip(starts, sizes, strict=True):
        if n > _SHIFTS:
            own, kind = fps[s : s + n], side[s : s + n]
            same = not kind.any()
            one, two = (own, own) if same else (own[kind == 1], own[kind == 2])
            for at in range(0, len(one), 4096):
                part, rest = one[at : at + 4096], two[at:] if same else two
                for x, y, upper in [(part, part, True), (part, rest[len(part) :], False)] if same else [(part, rest, False)]:
                    i, j = within(x, y, radius, upper)
                    a.append(x[i])
                    b.append(y[j])
                if sum(map(len, a)) > 1_000_000:
                    tree = forest(np.concatenate(a).view(np.int64).tolist(), np.concatenate(b).view(np.int64).tolist())
                    a = [np.array(list(tree.keys()), np.int64).view(np.uint64)]
                    b = [np.array(list(tree.values()), np.int64).view(np.uint64)]
    if not a:
        return {}
    return forest(np.concatenate(a).view(np.int64).tolist(), np.concatenate(b).view(np.int64).tolist())


def dealt_parts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, p, q, side, fp) from rows (bucket, fp); buckets of the written table ``hot`` (bucket, parts) are dealt out as pairs of parts.

    Each row of a large bucket goes to the pairs of parts that its own part is in. side: 0 all with all; 1 and 2: 1 with 2 alone.
    """
    n_hot = hot.count()
    if not n_hot:
        return rows.select(F.col("bucket").alias("key"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "fp")
    marked = rows.join(sized(hot.withColumnRenamed("bucket", "hot"), n_hot), F.col("bucket") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    plain = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side")))
    shared = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, own).alias("p"), F.greatest(k, own).alias("q"), F.when(k == own, 0).when(own < k, 1).otherwise(2).alias("side")),
    )
    each = marked.select("bucket", "fp", F.explode(F.when(F.col("parts").isNull(), plain).otherwise(shared)).alias("to"))
    return each.select(F.col("bucket").alias("key"), "to.p", "to.q", "to.side", "fp")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all that differ in at most ``radius`` bits."""
    edges, at = [], 0
    for width in BLOCKS:
        edges.append((at, width))
        at += width
    tables = []
    for number, ((s1, w1), (s2, w2)) in enumerate(combinations(edges, 2)):
        x = F.shiftrightunsigned("fp", s1).bitwiseAND(F.lit((1 << w1) - 1)).cast("long")
        y = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << w2) - 1)).cast("long")
        tables.append(F.lit(number << 32).cast("long") + x * F.lit(1 << w2) + y)
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("bucket"))
    hot = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT).select("bucket", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))
    dealt = dealt_parts(rows, hot)
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches):
        held = None

        def compare(part):
            key, p, q, side, fp = part
            change = np.r_[False, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            tree = _bucket_links(np.cumsum(change), side, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(list(tree.keys()), pa.int64()), "b": pa.array(list(tree.values()), pa.int64())})

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            last = (held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])
            done = int(last.sum())  # the last bucket may go on in the next batch
            if done >= 50_000:
                yield compare([x[:done] for x in held])
                held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            yield compare(held)

    return map_arrow(dealt, run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """The rows (id, fp), and for each distinct fp: root, the fp that stands for its component, and the smallest and largest ids there."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    found = beside(rooted, "root", "fp", component_id=(F.min, "low"), keep_id=(F.max, "high"))
    return rows, materialise(found.select("fp", "root", "component_id", "keep_id"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, fp, component_id, keep_id."""
    rows, found = classes(docs, id_col, text_col, **options)
    return rows.join(sized(found), "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that with the largest id. Rows that share an id are told apart by their texts."""
    rows, found = classes(docs, id_col, text_col, shingle, radius)

    def signed(text: bytes | None) -> int:
        value = fingerprint(text, shingle)
        return value - (1 << 64) if value >> 63 else value

    return keep_one(docs, rows, found, signed, id_col, text_col)


def keep_one(docs: DataFrame, rows: DataFrame, found: DataFrame, node_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component. rows: (id, fp) of the documents; found: (fp, root, keep_id); node_of: the fp of a text's bytes."""
    shared = materialise(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    member = rows.join(sized(found), "fp").filter(~F.col("id").eqNullSafe(F.col("keep_id")))
    n_shared = shared.count()
    mark = free_name(docs, "id")

    def listed(df: DataFrame, side: DataFrame, how: str, limit: int) -> DataFrame:
        return df.join(sized(side.withColumnRenamed("id", mark), limit=limit), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(mark)), how)

    single = listed(docs, materialise(member.select("id").distinct()), "left_anti", 2_000_000)
    if not n_shared:
        return single
    single = listed(single, shared, "left_anti", 2_000_000)
    at, fp, keep, part = docs.columns.index(text_col), *(free_name(docs, x) for x in ("fp", "keep", "part"))

    def values(batch):
        return pa.array([node_of(t) for t in binary_values(batch.column(at))], pa.int64())

    rest = with_arrow_column(listed(docs, shared, "left_semi", 2_000_000), fp, T.LongType(), values)
    rest = rest.join(sized(found.select(F.col("fp").alias(fp), F.col("keep_id").alias(keep), F.col("root").alias(part))), fp)
    rest = rest.filter(F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(keep))).dropDuplicates([part])
    return single.unionByName(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
