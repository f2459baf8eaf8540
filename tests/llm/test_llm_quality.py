import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quaestor.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, perplexity string, threshold string, code string"


def brute(texts, depth):
    """Interpolated modified Kneser-Ney from strings: probability(context, byte)."""
    top = Counter()
    for t in texts:
        s = b"\n" * depth + t
        for i in range(depth, len(s)):
            top[s[i - depth : i + 1]] += 1
    tables = [top]
    for _ in range(depth):
        tables.append(Counter(g[1:] for g in tables[-1]))
    tables.reverse()
    models = []
    for table in tables:
        n = Counter(table.values())
        if all(n[k] for k in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]
        else:
            d = [0.5, 1.0, 1.5]
        by = defaultdict(dict)
        for g, c in table.items():
            by[g[:-1]][g[-1]] = c
        models.append((by, d))

    def probability(context, byte):
        p = 1 / 256
        for depth_, (by, d) in enumerate(models):
            seen = by.get(context[len(context) - depth_ :])
            if not seen:
                break
            total = sum(seen.values())
            c = seen.get(byte, 0)
            p = (c - (d[min(c, 3) - 1] if c else 0)) / total + sum(d[min(x, 3) - 1] for x in seen.values()) / total * p
        return p

    return probability


def test_kneser_ney(spark):
    texts = ["abab abba cab dab", "ça va où va", "the cat the dog the cow", "", "aaaa bbbb"] * 3 + ["once only"]
    docs = spark.createDataFrame([(k, t, "x", "", "", "") for k, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(k, 1) for k in range(len(texts))], "doc_id bigint, quality int")
    model, chosen = quality.train(docs, labels)
    sampled = [texts[r.id] for r in chosen.filter("sampled").collect()]
    assert 0 < len(sampled) < len(texts)
    plain = brute([" ".join(t.split()).encode() + b"\n" for t in sampled], quality.DEPTH)
    for text in ("abab cat", "new words zq", "où", ""):
        body = b"\n" * quality.DEPTH + text.encode() + b"\n"
        want = sum(math.log2(plain(body[i - quality.DEPTH : i], body[i])) for i in range(quality.DEPTH, len(body)))
        assert np.isclose(model.score([body[quality.DEPTH :]])[0], want, rtol=1e-5)
    for context in (b"\n\n\n\n", b" the", b"zzzz"):
        code = np.array([int.from_bytes(context, "big") << 8 | b for b in range(256)], np.uint64)
        assert abs((2.0 ** model.values(code)).sum() - 1) < 1e-4


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").toPandas()
    assert got[got.quality == 1]["keep"].mean() > 0.97
    assert got[got.quality == 0]["keep"].mean() < 0.3
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.id for r in quality.classify(docs, labels).filter("keep").collect())


def test_cases(spark):
    rows = [(k, f"the good text number {k} of the tests", "en") for k in range(60)] + [(100, "@@ ## %% && ** !! ~~ ^^ ||" * 50, "en"), (101, None, "en"), (102, " \n", None), (103, "the good text", None), (None, "the good text", "fr"), (3, "the good text number 3 of the tests", "en"), (104, "the good text " * 20000, "en")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(0, 0), (1, 1), (None, 1), (5, None), (999, 1)], "doc_id bigint, quality int")
    kept = quality.keep_good(df, labels).collect()
    assert 100 not in {r.doc_id for r in kept} and {101, 102} <= {r.doc_id for r in kept}
    assert all(r.perplexity is None and r.keep for r in quality.classify(df, labels).filter("id in (101, 102)").collect())


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    df = spark.createDataFrame([(1, "text", "en", "", "", "")], SCHEMA)
    assert quality.keep_good(df, none).count() == 1
    assert quality.keep_good(df.limit(0), none).count() == 0
    assert quality.classify(df.limit(0), none).collect() == []


def test_every_trusted_document_counts(spark):
    words = ["abab abba cab dab", "ça va où va", "the cat the dog the cow", "", "aaaa bbbb", "The end of it all, they say"]
    rows = [(k, f"{words[k % 6]} {words[k * k % 5]} {k % 7}", "ab"[k % 2]) for k in range(40)]
    rows += [(100, "the cat they say", "a"), (101, "zq où ÿ@@ " * 9, "b"), (None, "abba cow", None), (7, "cab of it", "b"), (102, " ", "a"), (103, None, "c"), (104, "they say", "c")]
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id bigint, quality int")
    scored = {head: quality.perplexities(docs, labels, head_grams=head, words=F.col("text")).collect() for head in (30, quality.HEAD_GRAMS)}
    first, second = ({(r.id, r.words): (r.lang, r.trusted, r.perplexity) for r in found} for found in scored.values())
    assert first == second and len(first) == len(rows)  # the same to the last bit
    fold = {r.of: r.fold for r in quality._folds(docs, labels, "doc_id", "lang", "doc_id", "quality").collect()}
    assert sorted(fold) == list(range(40)) and len(set(fold.values())) == quality.FOLDS
    bodies = [(k, t, " ".join((t or "").split()).encode() + b"\n") for k, t, _ in rows]
    plain = {f: brute([b for k, _, b in bodies if k in fold and fold[k] != f], quality.DEPTH) for f in (*range(quality.FOLDS), None)}
    for k, t, b in bodies:
        s, probability = b"\n" * quality.DEPTH + b, plain[fold.get(k)]
        bits = sum(math.log2(probability(s[i - quality.DEPTH : i], s[i])) for i in range(quality.DEPTH, len(s)))
        lang, trusted, perplexity = first[k, t]
        assert trusted == (k in fold)
        assert perplexity is None if len(b) == 1 else np.isclose(perplexity, 2 ** (-bits / len(b)), rtol=1e-5)
    limit = {x: 2 ** np.quantile([round(math.log2(p), 3) for lang, trusted, p in first.values() if trusted and p and lang in x], quality.QUANTILE) * quality.MARGIN for x in ("a", "b", "ab")}
    judged = quality.classify(docs, labels).collect()
    for r in judged:
        assert np.isclose(r.threshold, limit.get(r.lang, limit["ab"]))
        assert r.keep == (r.perplexity is None or r.perplexity <= r.threshold)
    assert 0 < sum(not r.keep for r in judged) < len(rows)
    kept = Counter((r.doc_id, r.text) for r in quality.keep_good(docs, labels, head_grams=0).collect())
    assert kept == Counter(k for k, (lang, _, p) in first.items() if p is None or p <= limit.get(lang, limit["ab"]))
