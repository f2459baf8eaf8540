"""SimHash near-dedup at a similarity of word shingles, for texts that differ in more than a few bits.

Two texts link if the sets of their SHINGLE-word shingles, after lower-casing A-Z,
have a Jaccard similarity of at least SIMILARITY. One document of each connected
component stays, that with the largest id.

* Groups: texts that agree in all ROWS minima of one of BANDS bands of MinHash,
  and all that are connected so. A pair at similarity s is missed with probability
  (1 - s^ROWS)^BANDS, 5e-8 at 0.8. Blocks of SimHash can't find candidates here:
  at 0.8 pairs differ in about 10 of 64 bits and up to 16 or more.
* Comparison: a group's texts, each sent once, meet in a task, which compares
  SimHash fingerprints of BITS bits by bit planes, as ``simhash`` does, and leaves
  blocks beyond RADIUS; a pair at similarity 0.8 differs in 16 to 19 bits on the average,
  with a deviation of 4, so RADIUS is 5 deviations away. That doesn't hold for a handful of
  shingles (24 bits for 4 of 5), so sets below SMALL are compared whatever their fingerprints.
  They and texts with a fingerprint within the radius are compared by their whole sets, over an index of the shingles.
  Only a spanning forest of the links leaves the task.
* A group beyond SPLIT texts or SPLIT_CHARS characters is dealt out in parts. HUBS of its
  texts go to every part first, to be compared with all texts there. What they connect needs no
  comparison within itself, so after that only the texts outside the largest such component are
  compared, with each other and with that component, part by part. Work follows the
  group's size where a group is copies of one text. Where more than WIDE parts are outside, the group's
  buckets are compared instead, and those that are too large as pairs of parts.

Defined cases: texts with equal sets are one node, so are all null and wordless
texts; fewer words than a shingle give one shingle; null and repeated ids as in
``simhash``; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import binary_values, map_arrow, materialise, sized
from quaestor.llm.components import beside, components
from quaestor.llm.simhash import dealt_parts, forest, hits, keep_one

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
SEED = 42
_draw = np.random.default_rng(SEED)
FLIPS = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
ODD = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
BITS, RADIUS = 128, 40
#: Sets with fewer shingles skip the fingerprints.
SMALL = 16
#: Texts, and characters of them, that make a part.
SPLIT, SPLIT_CHARS = 512, 1 << 22
#: Texts of a large group that are compared with all of it, and parts outside its main component up to which they are dealt as such.
HUBS, WIDE = 16, 32


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and the six ASCII white spaces
    if len(words) > shingle:
        parts = {b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)}
    else:
        parts = {b" ".join(words)} if words else ()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in parts], np.uint64))


def node(found: np.ndarray) -> int:
    """What stands for a set of shingles, as a signed number."""
    value = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def buckets(found: np.ndarray) -> np.ndarray:
    """The buckets of a set, one for each band; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(found), 1024):
        low = np.minimum(low, ((found[at : at + 1024, None] ^ FLIPS) * ODD).min(axis=0))
    made = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(made, np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, BITS bits in words of 64."""
    out = []
    for word in range(BITS // 64):
        total = np.zeros(64, np.int64)
        for at in range(0, len(found), 8192):
            h = (found[at : at + 8192] ^ FLIPS[word]) * ODD[word]
            h = (h ^ h >> np.uint64(32)) * ODD[-1 - word]
            h ^= h >> np.uint64(29)
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * total > len(found), bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def signed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, hash, chars, fp, buckets) of every row; hash and chars tell its text."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("chars"), text.alias("text"))

    def run(batches):
        for batch in batches:
            found = [shingles(t, shingle) for t in binary_values(batch.column(3))]
            near = [buckets(x) for x in found]
            ends = np.cumsum([0, *map(len, near)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(near) if near else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([node(x) for x in found], pa.int64()), lists], ["id", "hash", "chars", "fp", "buckets"])

    return map_arrow(rows, run, "id long, hash long, chars int, fp long, buckets array<long>")


def compare(fps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> dict[int, int]:
    """Forest of the links between sets of which fps are the names; sides: 0 all with all, else 1 with 2 alone."""
    share, n = Fraction(str(similarity)), len(sets)
    sizes = np.array([len(x) for x in sets])
    prints = np.array([fingerprint(x) for x in sets]).reshape(n, -1)
    same = not sides.any()
    one = np.arange(n) if same else np.flatnonzero(sides == 1)
    two = np.arange(n) if same else np.flatnonzero(sides == 2)
    wanted = sizes[one] < SMALL
    for at, _, bits in hits(prints[one], prints[two], RADIUS, upper=same):
        wanted[at : at + len(bits)] |= bits.any(axis=1)
    if not wanted.any():
        return {}
    # An index of the sets: for each shingle, those that have it.
    owner = np.repeat(np.arange(n), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    ends = np.cumsum(np.bincount(column))
    starts, listed, rows = np.r_[0, ends[:-1]], owner[order], np.r_[0, np.cumsum(sizes)]
    shared = ends - starts > 1
    a, b, part = [], [], np.arange(n)
    for i in one[wanted].tolist():
        others = two[two > i] if same else two
        others = others[part[others] != part[i]]  # what is connected already needs no other link
        if not len(others):
            continue
        own = column[rows[i] : rows[i + 1]]
        own = own[shared[own]]
        if not len(own):
            continue
        common = np.bincount(np.concatenate([listed[x:y] for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]), minlength=n)
        near = others[common[others] * share.denominator >= (sizes[i] + sizes[others] - common[others]) * share.numerator]
        if not len(near):
            continue
        part[np.isin(part, part[near])] = part[i]
        a.append(np.full(len(near), fps[i]))
        b.append(fps[near])
        if sum(map(len, a)) > 1_000_000:
            tree = forest(np.concatenate(a).tolist(), np.concatenate(b).tolist())
            a, b = [np.array(list(tree.keys()), np.int64)], [np.array(list(tree.values()), np.int64)]
    return forest(np.concatenate(a).tolist(), np.concatenate(b).tolist()) if a else {}


def places(rows: DataFrame) -> DataFrame:
    """(bucket, hub, fp) of the buckets that hold several nodes; hub is the smallest of them."""
    each = rows.select("fp", F.explode("buckets").alias("bucket"))
    shared = materialise(each.groupBy("bucket").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).filter("hub < last").select(F.col("bucket").alias("of"), "hub"))
    return materialise(each.join(sized(shared), F.col("bucket") == F.col("of")).select("bucket", "hub", "fp").distinct())


def n_parts(n, size):
    return F.ceil(F.greatest(n / SPLIT, size / SPLIT_CHARS)).cast("int")


def own_part(parts):
    return F.pmod(F.xxhash64("fp"), parts).cast("int")


def to_hubs(large: DataFrame) -> DataFrame:
    """(key, p, q, side, fp) that bring HUBS texts of each group to all its parts; large: (group, fp, parts)."""
    slot = F.pmod(F.xxhash64(F.lit("hub"), "fp"), F.lit(HUBS)).alias("slot")
    hubs = large.groupBy("group", "parts", slot).agg(F.min("fp").alias("fp"))
    each = hubs.select(F.col("group").alias("key"), F.lit(0).alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"), F.lit(1).alias("side"), "fp")
    return each.unionByName(large.select(F.col("group").alias("key"), F.lit(0).alias("p"), own_part(F.col("parts")).alias("q"), F.lit(2).alias("side"), "fp"))


def outside(inside: DataFrame, linked: DataFrame, members: DataFrame) -> DataFrame:
    """(key, p, q, side, fp) of what is still to be compared in large groups; inside: (group, fp, chars), linked: the edges that are known."""
    roots = materialise(components(linked))
    labelled = inside.join(sized(roots), F.col("fp") == F.col("node"), "left").select("group", "fp", "chars", F.coalesce("root", "fp").alias("label"))
    labelled = materialise(labelled)
    main = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    marked = materialise(labelled.join(sized(materialise(main)), "group").select("group", "fp", "chars", (F.col("label") != F.col("main")).alias("rest")))
    count = lambda on: n_parts(F.count_if(on), F.coalesce(F.sum(F.when(on, F.col("chars"))), F.lit(0)))
    parts = materialise(marked.groupBy("group").agg(count(F.col("rest")).alias("rests"), count(~F.col("rest")).alias("mains")).filter("rests > 0"))
    few = parts.filter(F.col("rests") <= WIDE)
    rows = marked.join(sized(parts).filter(F.col("rests") <= WIDE), "group")
    rest, kept = rows.filter("rest"), rows.filter("NOT rest")
    among = dealt_parts(rest.select(F.col("group").alias("bucket"), "fp"), materialise(few.filter("rests > 1").select(F.col("group").alias("bucket"), F.col("rests").alias("parts"))))
    key, upto = F.col("group").alias("key"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("k")
    one = rest.select(key, own_part(F.col("rests")).alias("p"), "rests", upto("mains"), F.lit(1).alias("side"), "fp").withColumn("q", F.col("rests") + F.col("k"))
    two = kept.select(key, upto("rests"), (F.col("rests") + own_part(F.col("mains"))).alias("q"), F.lit(2).alias("side"), "fp").withColumnRenamed("k", "p")
    dealt = among.unionByName(one.select(*among.columns)).unionByName(two.select(*among.columns))
    wide = materialise(parts.filter(F.col("rests") > WIDE).select("group"))
    if wide.isEmpty():
        return dealt
    inner = materialise(members.select("bucket", "fp").join(sized(materialise(marked.join(sized(wide), "group", "left_semi").select("fp", "chars"))), "fp"))
    hot = materialise(inner.groupBy("bucket").agg(n_parts(F.count(F.lit(1)), F.sum("chars")).alias("parts")).filter("parts > 1"))
    # A number of its own for p, lest a bucket and a group of the same name meet.
    return dealt.unionByName(dealt_parts(inner.select("bucket", "fp"), hot).withColumn("p", F.col("p") + (1 << 20)))


def compared(dealt: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Edges (a, b) that connect the similar sets of each (key, p, q); dealt: (key, p, q, side, fp), texts: (fp, text)."""
    met = dealt.join(texts, "fp").select("key", "p", "q", "side", "fp", "text")
    met = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches):
        at, held = None, []

        def told():
            tree = compare(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held]), [x[2] for x in held], similarity) if len(held) > 1 else {}
            return pa.RecordBatch.from_pydict({"a": pa.array(list(tree.keys()), pa.int64()), "b": pa.array(list(tree.values()), pa.int64())})

        for batch in batches:
            for key, p, q, side, fp, t in zip(*(c.to_pylist() for c in batch.columns[:5]), binary_values(batch.column(5)), strict=True):
                if (key, p, q) != at:
                    if held:
                        yield told()
                    at, held = (key, p, q), []
                held.append((fp, side, shingles(t, shingle)))
        if held:
            yield told()

    return map_arrow(met, run, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that connect all nodes of similar sets; rows: what ``signed_texts`` gives of ``docs``."""
    members = places(rows)
    # Nodes that share buckets, directly or over others, make a group.
    grouped = components(members.select(F.col("hub").alias("a"), F.col("fp").alias("b"))).withColumnRenamed("node", "fp")
    one = rows.groupBy("fp").agg(F.min(F.struct("hash", "chars")).alias("text"))
    nodes = materialise(one.join(sized(materialise(grouped)), "fp").select("fp", F.col("root").alias("group"), "text.hash", "text.chars"))
    text = F.col(f"`{text_col}`")
    every = docs.select(text.alias("text"), F.xxhash64(text).alias("hash"), F.length(text).alias("chars"))

    def texts(of: DataFrame) -> DataFrame:
        """The text of each node comes once to its node, and from there to where it is compared."""
        wanted = of.select("fp", F.col("hash").alias("h"), F.col("chars").alias("c"))
        return every.join(sized(wanted), (F.col("hash") == F.col("h")) & (F.col("chars") == F.col("c"))).groupBy("fp").agg(F.min("text").alias("text"))

    large = materialise(nodes.groupBy("group").agg(n_parts(F.count(F.lit(1)), F.sum("chars")).alias("parts")).filter("parts > 1"))
    whole = nodes.join(sized(large), "group", "left_anti").select(F.col("group").alias("key"), *[F.lit(0).alias(x) for x in ("p", "q", "side")], "fp")
    if large.isEmpty():
        return compared(whole, texts(nodes), similarity, shingle)
    inside = materialise(nodes.join(sized(large), "group"))
    first = materialise(compared(to_hubs(inside), texts(inside), similarity, shingle))
    rest = outside(inside, first, members)
    return first.unionByName(compared(whole.unionByName(rest), texts(nodes), similarity, shingle))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component, that with the largest id. Rows that share an id are told apart by their texts."""
    rows = materialise(signed_texts(docs, id_col, text_col, shingle))
    roots = components(links(docs, rows, text_col, shingle, similarity)).withColumnRenamed("node", "fp")
    ids = rows.groupBy("fp").agg(F.max("id").alias("high"))
    rooted = ids.join(roots, "fp", "left").select("fp", "high", F.coalesce("root", "fp").alias("root"))
    found = materialise(beside(rooted, "root", "fp", keep_id=(F.max, "high")).select("fp", "root", "keep_id"))
    return keep_one(docs, rows.select("id", "fp"), found, lambda t: node(shingles(t, shingle)), id_col, text_col)
