import random

import numpy as np
import pytest

from quaestor.llm import decontaminate as dc

SCHEMA = "doc_id bigint, text string, items string, spans string, id string"


def words(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def brute(docs, items):
    windows = set()
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {(str(i) if i is not None else "", tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(item)
        out.append((d, len(w), sorted(hit), sorted(found)))
    return out


def data():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "ß9"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, say(rng.randrange(1, 60))) for k in range(30)] + [(30, []), (31, ["a"] * 40), (5, say(20)), (32, say(3))]
    docs = [(k, say(rng.randrange(300))) for k in range(30)]
    for k in range(40):
        x = rng.choice([i for i in items if i[1]])[1]
        a = rng.randrange(len(x))
        docs.append((100 + k, say(rng.randrange(400)) + x[a : a + rng.randrange(1, 40)] + say(rng.randrange(60))))
    docs += [(200, items[0][1]), (200, items[0][1]), (201, ["a"] * 500), (202, items[1][1] + items[2][1]), (203, say(40000) + items[3][1])]
    text = lambda w: "".join((x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice([" ", ", ", "\n", "-"]) for x in w)
    docs = [(i, text(w)) for i, w in docs] + [(None, text(items[0][1])), (300, None), (301, ""), (302, "!?")]
    return docs, [(i, " ".join(w)) for i, w in items] + [(40, None), (None, "x y z only without id")]


@pytest.mark.parametrize("block_words", [400_000, 150])
def test_findings(spark, block_words):
    docs, items = data()
    got = dc.findings(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words).collect()
    rows = sorted((str(r.id), r.n_words, [k for s in r.spans for k in range(s.first, s.end)], r["items"]) for r in got)
    assert rows == sorted((str(d), n, h, i) for d, n, h, i in brute(docs, items))
    assert all(a.end < b.first for r in got for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("block_words", [400_000, 150])
def test_contaminated_go_and_spans_are_cut(spark, block_words):
    docs, items = data()
    df, bench = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    found = brute(docs, items)
    stay = [(d, t, h) for (d, t), (_, n, h, _) in zip(docs, found, strict=True) if not (h and 20 * len(h) >= n)]
    kept = dc.decontaminate(df, bench, block_words=block_words)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(d), str(t)) for d, t, _ in stay)
    cut = dc.decontaminate(df, bench, cut=True, block_words=block_words).collect()
    left = [[w for k, w in enumerate(words(t)) if k not in set(h)] for _, t, h in stay]
    assert sorted(words(r.text) for r in cut) == sorted(left)


def test_empty(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    assert dc.findings(docs, items).collect() == []
    some = spark.createDataFrame([(1, "x", "", "", "")], SCHEMA)
    assert dc.findings(some, items).collect()[0]["items"] == []
    assert dc.decontaminate(some, items).count() == 1


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_longest_matches_of_a_stream(window):
    rng = random.Random(window)
    for kinds in (2, 3, 9):
        say = lambda n: [b"w%d" % rng.randrange(kinds) for _ in range(n)]
        items = [(str(k), say(rng.randrange(40))) for k in range(8)] + [("empty", [])]
        automaton = dc.Automaton(items, window)
        stream = [b"w%d" % rng.randrange(kinds + 1) for _ in range(3 * dc._LANE * window + 7)]  # some words in no item; more than one lane
        inside = {tuple(t[i:j]) for _, t in items for i in range(len(t)) for j in range(i + 1, min(len(t), i + window) + 1)}
        _, length = automaton.stream(np.array([automaton.number.get(w, 0) for w in stream]))
        best = [max((n for n in range(1, min(window, i + 1) + 1) if tuple(stream[i - n + 1 : i + 1]) in inside), default=0) for i in range(len(stream))]
        assert np.minimum(length, window).tolist() == best


def test_no_items_match_nothing():
    automaton = dc.Automaton([], 13)
    assert dc.matches(automaton, [b"a b", None, b""]) == [(2, [], set()), (0, [], set()), (0, [], set())]
