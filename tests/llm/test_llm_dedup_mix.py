import hashlib
import math
from collections import Counter, defaultdict

import pytest

from quaestor.llm import exact_dedup, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, kept string, size string, digest string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def rows(*items):
    return [(i, t, "en", s, None, "x", "y", "z", "w") for i, t, s in items]


DOCS = rows((1, "Same Text", "a"), (2, "same text", "a"), (3, None, "b"), (4, "", None), (5, "É", "a"), (6, "é", "b"), (7, "same text", None), (7, "same text", None), (None, "lone", "a"), (None, "SAME text", "a"), (8, "word " * 30000, "b"), (9, "word " * 30000 + "x", "b"))


def test_exact_classes(spark):
    got = exact_dedup.classes(spark.createDataFrame(DOCS, SCHEMA)).collect()
    assert len(got) == len(DOCS)
    groups = defaultdict(list)
    for r in DOCS:
        groups[lower(r[1] or "")].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_drop_copies(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    texts = [lower(r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({lower(r[1] or "") for r in DOCS})
    assert {r.doc_id for r in kept.collect() if lower(r.text or "") == "same text"} == {7}


def test_too_many_groups_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(DOCS, SCHEMA)
    want = sorted(map(str, exact_dedup.classes(df).collect()))
    monkeypatch.setattr(exact_dedup, "sized", lambda small, rows=None: small)
    assert sorted(map(str, exact_dedup.classes(df).collect())) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classes(df).collect() == []
    assert exact_dedup.drop_copies(df).collect() == []
    assert mixing.plan(df).collect() == []
    assert mixing.mix(df).collect() == []


def fill(sizes):
    """Water-filling by rounds."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    want = 1.5 * sum(sizes.values())
    while open_:
        level = want / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            want -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("skew", [1, 40])
def test_mixing(spark, skew):
    docs = rows(*[(i, "w " * (1 + i % 17), f"s{i % 7}" if i % (skew + 1) else (None if i % 3 else "hot")) for i in range(3000)])
    df = spark.createDataFrame(docs, SCHEMA)
    got = mixing.plan(df).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in docs:
        sizes[r[3]] += len(r[1].split())
    for r in got:
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 2
    want = fill(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    mixed = mixing.mix(df.repartition(5))
    assert mixed.columns == [*df.columns, "copy_no"]
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.id: r.copies for r in got if r.copies})


def test_mixing_null_rows(spark):
    got = mixing.plan(spark.createDataFrame(rows((1, None, None), (2, None, "a"), (None, "x y", "b"), (None, "x y", "b")), SCHEMA)).collect()
    assert {(r.source, r.size) for r in got} == {(None, 0), ("a", 0), ("b", 2)}
    assert sum(r.size * r.copies for r in got if r.source == "b") in (4, 8)
