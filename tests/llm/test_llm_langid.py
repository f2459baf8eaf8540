import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np

from quaestor.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, held_out string, score string, key string"


def plain_length(text, training, depth):
    """Code length of ``text`` in bits by method C, from strings alone."""
    seen = defaultdict(Counter)
    for t in training:
        s = b"\n" * depth + t
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                seen[s[i - d : i]][s[i]] += 1
    bits, s = 0.0, b"\n" * depth + text
    for i in range(depth, len(s)):
        for d in range(depth, -1, -1):
            c = seen.get(s[i - d : i])
            if not c:
                continue
            space = c.total() + len(c)
            if s[i] in c:
                bits -= log2(c[s[i]] / space)
                break
            bits -= log2(len(c) / space)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    training = [[b"abab abba cab\n", b"ab\n"], ["ça va où\n".encode(), b"ab va\n"]]
    counts = []
    for texts in training:
        tally = langid.__dict__["count_grams"].__globals__["Tally"]()
        from quaestor.llm import bytegrams

        for grams, first, end, _ in bytegrams.pieces(texts, langid.DEPTH):
            tally.add(bytegrams.inside(grams, first, end))
        counts.append(tally.take())
    model = langid.build(counts)
    for text in (b"ab\n", b"\n", "zz çab ou\n".encode(), b"abab abba cab\n", b"va va va xyz\n"):
        want = [-plain_length(text, t, langid.DEPTH) for t in training]
        assert np.allclose(model.score([text])[0], want, rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs).join(docs.withColumnRenamed("doc_id", "id"), "id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_cases(spark):
    rows = [(k, "the cat and the dog " * (1 + k % 5), "en") for k in range(40)] + [(100 + k, "der hund und die katze " * (1 + k % 5), "de") for k in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 34 !?", "de"), (203, "über", None), (None, "the dog", None), (7, "der hund", "de"), (7, "der hund", "de"), (204, "und die " * 50000, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = langid.predictions(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.id is None else r.id).encode()) % 4 == 2)
    by = {r.id: r for r in got}
    assert [by[k].lang_pred for k in (200, 201, 202)] == ["und"] * 3 and by[200].score == 0
    assert by[203].lang_pred in ("de", "en") and by[204].lang_pred == "de" and by[None].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    assert langid.predictions(spark.createDataFrame([], SCHEMA)).collect() == []
    got = langid.predictions(spark.createDataFrame([(1, "text", None, "", "", "")], SCHEMA)).collect()
    assert [r.lang_pred for r in got] == ["und"]
