import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quaestor.llm import bytegrams, lm_score

SCHEMA = "doc_id bigint, text string, token string, row string, n string"


def kt(a, b):
    p, x, y = 1.0, 0, 0
    for k in range(a):
        p *= (x + 0.5) / (x + y + 1)
        x += 1
    for k in range(b):
        p *= (y + 0.5) / (x + y + 1)
        y += 1
    return p


def brute_tree(texts, depth):
    """Context-tree weighting written down plainly: counts by context string and known bits, recursion over contexts."""
    counts = defaultdict(lambda: [0, 0])
    contexts = {}
    for t in texts:
        s = b"\n" * depth + t
        for i in range(depth, len(s)):
            bits = f"{s[i]:08b}"
            for d in range(depth + 1):
                contexts[s[i - d : i]] = None
                for k in range(8):
                    counts[s[i - d : i], bits[:k]][int(bits[k])] += 1

    def weighted(c, known):
        if (c, known) not in counts:
            return 1.0
        own = kt(*counts[c, known])
        if len(c) == depth:
            return own
        return 0.5 * own + 0.5 * math.prod(weighted(x, known) for x in contexts if len(x) == len(c) + 1 and x[1:] == c)

    def one_bit(context, known, bit):
        out, left = 0.0, 1.0
        if (b"", known) not in counts:
            return 0.5
        for d in range(depth + 1):
            c = context[len(context) - d :]
            estimate = (counts[c, known][bit] + 0.5) / (sum(counts[c, known]) + 1)
            if d == depth or (context[len(context) - d - 1 :], known) not in counts:
                return out + left * estimate
            stay = 0.5 * kt(*counts[c, known]) / weighted(c, known)
            out += left * stay * estimate
            left *= 1 - stay

    def probability(context, byte):
        bits = f"{byte:08b}"
        return math.prod(one_bit(context, bits[:k], int(bits[k])) for k in range(8))

    return probability


CONTEXTS = (b"\n\n", b"\na", b"ab", b"b ", b"zz", b"za", b"a\n", b"\xc3\xa9")


def test_tree_equals_plain_recursion(spark):
    texts = [b"abab abba\n", b"ab ac ad\n", b"\n", "é ab\n".encode()]
    rows = spark.createDataFrame([(1, t.decode()) for t in texts], "learn int, text string")
    seen = lm_score.gram_counts(rows, 2)
    asked = spark.createDataFrame([(c[0] << 16 | c[1] << 8 | b, 0) for c in CONTEXTS for b in range(256)], "code long, n long")
    grams = seen.select("code", "n").unionByName(asked).groupBy("code").sum("n").toDF("code", "n")
    got, plain = dict(lm_score.code_lengths(grams, 2).collect()), brute_tree(texts, 2)
    for c in CONTEXTS:
        p = [2.0 ** -got[c[0] << 16 | c[1] << 8 | b] for b in range(256)]
        assert np.allclose(p, [plain(c, b) for b in range(256)], rtol=1e-9)
        assert abs(sum(p) - 1) < 1e-9


def test_whole_texts_equal_plain_recursion_for_any_head(spark):
    docs = [(k, " ".join(random.Random(k).choices(["ab", "b", "Ba", "é", "cab"], k=k % 7))) for k in range(30)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain = brute_tree([bytegrams.body(t.encode()) for i, t in docs if not held(i)], 4)

    def want(t):
        s = b"\n" * 4 + bytegrams.body(t.encode())
        return sum(math.log10(plain(s[i - 4 : i], s[i])) for i in range(4, len(s)))

    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA)
    for head in (1 << 20, 10, 0):
        got = {r.id: r.score for r in lm_score.score(df, depth=4, head_grams=head).collect()}
        assert all(math.isclose(got[i], want(t), rel_tol=1e-9) for i, t in docs)


def test_pieces_do_not_change_scores(monkeypatch):
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(1, 900))) + b"\n" for _ in range(20)]
    codes = np.unique(np.concatenate([bytegrams.inside(g, f, e) for g, f, e, _ in bytegrams.pieces(texts, 3)]))
    head = lm_score.Head(codes[::2], np.arange(len(codes[::2])) + 1.0, 3)
    whole = head.score(texts)
    monkeypatch.setattr(bytegrams, "PIECE", 100)
    parts = head.score(texts)
    assert np.allclose(parts[0], whole[0])
    assert [x.tolist() for k in (1, 2) for x in parts[k]] == [x.tolist() for k in (1, 2) for x in whole[k]]


def documents():
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice(["The", "cat", "of", "dög", "is", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(80)))) for k in range(150)]
    return [*docs, (150, None), (151, ""), (152, " \n\t"), (None, "null id"), (7, docs[7][1]), (7, docs[7][1]), (153, "unknown " * 20000)]


@pytest.mark.parametrize("head", [200_000, 3])
def test_base_score(spark, head):
    docs = documents()
    got = lm_score.score(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA), head_tokens=head).collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not held(i) for w in [*lower(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        words = [*lower(t), "\n"]
        want.append((str(i), held(i), len(words), sum(w in counts for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    rows = sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(rows, sorted(want), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r.score < 0 for r in got)


def test_held_out_texts_gain_from_contexts(spark, sf_dir):
    """Against contexts of one byte; the word counts of ``base_score`` are beaten with more text (see README)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long, short = (lm_score.score(docs, depth=d).filter("held_out").toPandas()["score"].sum() for d in (5, 1))
    assert long > 0.9 * short


def test_empty(spark):
    assert lm_score.score(spark.createDataFrame([], SCHEMA)).collect() == []
    only = lm_score.score(spark.createDataFrame([(k, "held out", "", "", "") for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2], SCHEMA)).collect()
    assert only and all(r.n_known == 0 and r.train_tokens == 0 for r in only)
