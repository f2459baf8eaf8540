import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from quaestor.llm import simhash
from quaestor.llm.components import SALTS, beside, components

SCHEMA = "doc_id bigint, text string, fp string, id string, key string"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    comp = list(range(len(fps)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), []).append(ids[i])
    low = {r: min((i for i in v if i is not None), default=None) for r, v in out.items()}
    return [low[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "One", "a b c", "a b c d", "A b\tC\nd  É é", "x y " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_kernels():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    block = np.concatenate([near, rng.integers(0, 2**63, 1000, dtype=np.uint64), base ^ np.uint64(0x1F), base ^ np.uint64(0xF)])
    want = {(i, j) for i in range(300) for j in range(len(block)) if bin(int(base[i] ^ block[j])).count("1") <= 4}
    assert set(zip(*map(np.ndarray.tolist, simhash.within(base, block)), strict=True)) == want
    for bits in range(65):
        a = np.array([0], np.uint64)
        b = np.array([(1 << bits) - 1], np.uint64)
        assert simhash.pairs_within(a, b)[0] == (bits <= 4)
        assert len(simhash.within(a, b)[0]) == (bits <= 4)


def test_upper_triangle_and_wide_fingerprints():
    rng = np.random.default_rng(4)
    for n, words, radius in ((0, 1, 4), (1, 1, 4), (70, 1, 4), (200, 1, 9), (200, 2, 40)):
        fps = rng.integers(0, 2**64, (n, words), dtype=np.uint64)
        for k in range(0, n, 3):
            fps[k] = fps[n // 2] ^ rng.integers(0, 256, words, dtype=np.uint64)
        far = np.array([[sum(bin(int(x)).count("1") for x in a ^ b) for b in fps] for a in fps]).reshape(n, n)
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(far <= radius, 1))), strict=True))
        got = simhash.within(fps[:, 0] if words == 1 else fps, fps[:, 0] if words == 1 else fps, radius, upper=True)
        assert set(zip(*map(np.ndarray.tolist, got), strict=True)) == want


def test_an_ordinary_bucket_abandons_blocks():
    """A bucket compared with itself: fingerprints agree in the bucket's 22 bits, and most planes of the others are never looked at."""
    fps = np.random.default_rng(5).integers(0, 2**64, 4000, dtype=np.uint64) >> np.uint64(22)
    simhash.work.update(done=0, whole=0)
    simhash._bucket_links(np.zeros(4000, np.int64), np.zeros(4000, np.int64), fps, 4)
    assert simhash.work["done"] < 0.4 * simhash.work["whole"]


@pytest.mark.parametrize("split", [16384, 40])
def test_links_find_every_component(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(400)]
    for f in fps[:60]:
        for _ in range(rng.randrange(4)):
            g = f
            for b in rng.sample(range(64), rng.randrange(7)):
                g ^= 1 << b
            fps.append(g)
    hot = rng.getrandbits(64)
    fps += [hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    want = plain_components(signed, fps)
    got = {}
    for f, w in zip(signed, want, strict=True):
        got.setdefault(roots.get(f, f), set()).add(w)
    assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want))


def documents():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 300))]
        docs.append((i, " ".join(text)))
        for k in range(rng.randrange(3)):
            copy = list(text)
            copy[rng.randrange(len(copy))] = "other"
            docs.append((100 + 3 * i + k, " ".join(copy).title()))
    docs += [(500, None), (501, ""), (502, " \n"), (None, None), (None, "only without id"), (10, docs[10][1]), (3, "same id other text here"), (700, "long " * 20000)]
    return [(i, t, "a", "b", "c") for i, t in docs]


def test_components_of_documents(spark):
    docs = documents()
    got = simhash.near_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    fps = [plain_fingerprint(d[1]) for d in docs]
    want = sorted(((d[0] if d[0] is not None else -1), f, -1 if c is None else c) for d, f, c in zip(docs, fps, plain_components([d[0] for d in docs], fps), strict=True))
    assert sorted((-1 if r.id is None else r.id, r.fp % (1 << 64), -1 if r.component_id is None else r.component_id) for r in got) == want


def test_one_document_of_each_component_stays(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    fps = [plain_fingerprint(d[1]) for d in docs]
    comp = plain_components(list(range(len(docs))), fps)
    by_fp = dict(zip(fps, comp, strict=True))
    found = [by_fp[plain_fingerprint(r.text)] for r in kept.collect()]
    assert sorted(found) == sorted(set(comp))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_classes(df).collect() == []
    assert simhash.drop_near_copies(df).collect() == []


def test_chain_is_one_component(spark):
    got = components(spark.createDataFrame([(k, k + 1) for k in range(-50, 200)], "a long, b long")).collect()
    assert {r.node for r in got} == set(range(-50, 201)) and {r.root for r in got} == {-50}


def test_components_of_a_star_a_clique_and_null_ends(spark):
    edges = [(5000, k) for k in range(1, 900)] + [(a, b) for a in range(6000, 6020) for b in range(6000, 6020)] + [(None, 3), (4, None), (None, None), (7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in [*range(1, 900), 5000]} | {k: 6000 for k in range(6000, 6020)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_beside_deals_a_hot_key_to_many_parts(spark):
    rows = [(0, k) for k in range(2000)] + [(k, -k) for k in range(1, 50)] + [(3, 7), (3, 7)]
    df = beside(spark.createDataFrame(rows, "u long, v long"), "u", "v", low=(F.min, "v"), high=(F.max, "v"))
    own = {}
    for u, v in rows:
        own.setdefault(u, []).append(v)
    assert sorted(map(tuple, df.collect())) == sorted((u, v, min(own[u]), max(own[u])) for u, v in rows)
    parts = spark.range(2000).select(F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("part")).groupBy("part").count().collect()
    assert len(parts) == SALTS and max(r["count"] for r in parts) < 100
