import random

import pytest

import corpus_pipeline
from quaestor.llm import near_copies

SCHEMA = "doc_id bigint, text string, fp string, id string, key string"


def plain_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(docs):
    """The largest id of each component, by comparing all pairs."""
    sets, comp = [plain_shingles(t) for _, t in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    best = {}
    for (doc, _), c in zip(docs, comp, strict=True):
        best[c] = max(best.get(c, -1), doc)
    return sorted(best.values())


def documents():
    """Short and medium texts, and copies of them with 0 to 6 changed words."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    docs = []
    for _ in range(80):
        text = [rng.choice(words) for _ in range(rng.choice((3, 30, 60, 80, 104, 150, 300)))]
        docs.append(" ".join(text))
        for _ in range(rng.randrange(5)):
            copy = list(text)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy).title())
    return list(enumerate(docs + [None, "", " \n", "w1", "W1", "long " * 20000]))


def test_fingerprints_hide_no_pair():
    """Pairs at a similarity of 0.8, of small sets and larger ones: of 4 and 5 shingles, some differ in more than RADIUS bits."""
    np, rng = near_copies.np, near_copies.np.random.default_rng(9)
    beyond = 0
    for common, a, b, times in ((4, 1, 0, 6000), (8, 1, 1, 500), (16, 4, 0, 500), (80, 10, 10, 300)):
        for _ in range(times):
            h = rng.integers(0, 2**64, common + a + b, dtype=np.uint64)
            sets = [np.sort(h[: common + a]), np.sort(np.r_[h[:common], h[common + a :]])]
            far = np.bitwise_count(near_copies.fingerprint(sets[0]) ^ near_copies.fingerprint(sets[1])).sum()
            beyond += far > near_copies.RADIUS
            assert near_copies.compare(np.array([1, 2]), np.array([0, 0]), sets) == {2: 1}
            assert near_copies.compare(np.array([1, 2]), np.array([2, 1]), sets) == {2: 1}
    assert beyond


def test_stage_keeps_one_of_each_component(spark):
    docs = documents()
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA)
    kept = corpus_pipeline.no_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(docs)


@pytest.mark.parametrize("split, hubs, wide", ((4096, 16, 32), (40, 16, 32), (40, 2, 1)))
def test_hub_does_not_hide_other_pairs(spark, monkeypatch, split, hubs, wide):
    """All nodes meet in one bucket, but only some pairs link, and not with its smallest node."""
    monkeypatch.setattr(near_copies, "buckets", lambda found: near_copies.np.zeros(min(1, len(found)), near_copies.np.int64))
    for name, value in (("SPLIT", split), ("HUBS", hubs), ("WIDE", wide)):
        monkeypatch.setattr(near_copies, name, value)
    docs = documents()
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df).collect()) == plain_kept(docs)


def test_hot_group_is_dealt_out(spark, monkeypatch):
    """Copies of one text, a few of a chain that only touches them, and texts apart: no part holds the group, and none is lost."""
    monkeypatch.setattr(near_copies, "buckets", lambda found: near_copies.np.zeros(min(1, len(found)), near_copies.np.int64))
    monkeypatch.setattr(near_copies, "SPLIT", 30)
    rng, base = random.Random(5), [f"w{k}" for k in range(100)]
    docs = []
    for k in range(300):
        copy = list(base)
        copy[rng.randrange(100)] = f"x{k}"
        docs.append(" ".join(copy))
    chain = list(base)
    for k in range(20):
        chain[k * 5 : k * 5 + 2] = [f"y{k}", f"z{k}"]
        docs.append(" ".join(chain))
    docs = list(enumerate(docs + [" ".join(f"v{k}w{j}" for j in range(40)) for k in range(10)]))
    seen, dealt = [], near_copies.compared
    monkeypatch.setattr(near_copies, "compared", lambda d, *rest: seen.append(d.groupBy("key", "p", "q").count().toPandas()["count"].max()) or dealt(d, *rest))
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df).collect()) == plain_kept(docs)
    assert len(seen) == 2 and max(seen) < 120


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "A b c d e f"), (1, "something else altogether here now"), (None, "only without id"), (None, None), (7, "")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    got = [(r.doc_id, (r.text or "").lower()) for r in near_copies.drop_near_copies(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b c d e f"), (1, "something else altogether here now"), (None, "only without id"), (7, "")], key=str)
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
