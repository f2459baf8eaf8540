"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Trusted are the documents that the labels call good; all of them are learnt from,
whole. Grams of 1 to DEPTH + 1 bytes are counted in them, and none is left out.
Trusted documents are dealt to FOLDS folds by a hash of the id, and FOLDS + 1 models
are made at once: one of all trusted documents, and one of all but those of each
fold. A document's perplexity per byte comes from the model of all trusted
documents; a trusted document's own, from that of all but its fold, which hasn't read
it. A document is rejected if its perplexity is over its language's threshold: the
QUANTILE of all trusted documents of the language, times MARGIN, as the quantile of
a few hundred documents lies below that of all.

The models are never in one place. Counts, continuation counts, counts of counts,
context totals and probabilities are made in sharded tables, level by level. Grams
that only documents that aren't trusted have take part with count 0, so that the last
table has the cost of every gram of every document in every model. The HEAD_GRAMS most
frequent grams are sent to the tasks, and every other gram of a document is looked up
by a join. Costs are whole numbers of 2^-20 bits, so that a sum doesn't depend on its order.

White space is folded, case and punctuation aren't: junk shows in them.

Defined cases: a null or blank text has no perplexity and is kept; a null
language is a language of its own; a language with no trusted documents takes
the threshold of all; with no labels all are kept; labels whose document is
missing and repeated labels change nothing (a document that any row calls bad
isn't trusted); rows of one id are in one fold, and trusted together; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.llm.bytegrams import BackoffModel, arrays, body, count_grams, mask, tally_grams, threshold
from quaestor.llm.common import binary_values, free_name, map_arrow, materialise, opened, read, share, sized
from quaestor.llm.lm_score import Head

DEPTH = 4
FOLDS = 4
HEAD_GRAMS = 1 << 20
QUANTILE = 0.99
MARGIN = 1.1
#: Costs are in these parts of a bit.
PARTS = 1 << 20


def discounts(level: DataFrame, models: int = 1) -> list[tuple[float, float, float]]:
    """D1, D2 and D3+ of each model from the counts of counts; where these say nothing, 0.5, 1 and 1.5."""
    row = level.agg(*[F.count_if(F.col(f"n{m}") == k) for m in range(models) for k in (1, 2, 3, 4)]).first()
    out = []
    for m in range(models):
        counts = row[4 * m : 4 * m + 4]
        if not all(counts):
            out.append((0.5, 1.0, 1.5))
            continue
        n1, n2, n3, n4 = map(float, counts)
        y = n1 / (n1 + 2 * n2)
        found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        out.append(tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)))
    return out


def kneser_ney(grams: DataFrame, models: int = 1, depth: int = DEPTH) -> list[tuple[DataFrame, DataFrame]]:
    """For each length of gram: (code, p0, p1, ...), written, and (code, left0, left1, ...) of its contexts, from written counts (code, n0, n1, ...) of the longest grams in each model.

    p is the probability of a gram's byte after its context, and left the part of it that a context leaves to
    shorter ones, 1 if the model doesn't know the context. Every gram that is given has its p, also where its count is 0.
    Shorter grams count the different bytes before them, not their occurrences.
    """
    each = range(models)
    levels = [grams]
    for d in range(depth - 1, -1, -1):
        own = F.col("code").bitwiseAND(F.lit(mask(d)).cast("long")).alias("code")
        levels.append(materialise(levels[-1].groupBy(own).agg(*[F.count_if(F.col(f"n{m}") > 0).alias(f"n{m}") for m in each])))
    levels.reverse()
    out = []
    for d, level in enumerate(levels):
        context = Window.partitionBy("context")
        columns = {}
        for m, (d1, d2, d3) in enumerate(discounts(level, models)):
            n = F.col(f"n{m}")
            cut = F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)
            total = F.sum(n).over(context)
            columns[f"own{m}"] = (n - cut) / F.greatest(total, F.lit(1))
            columns[f"left{m}"] = F.when(total > 0, F.sum(cut).over(context) / F.greatest(total, F.lit(1))).otherwise(1.0)
        joined = level.withColumn("context", F.shiftrightunsigned("code", 8)).withColumns(columns)
        contexts = joined.select(F.col("context").alias("code"), *[f"left{m}" for m in each]).distinct()
        if out:
            before = out[-1][0].select(F.col("code").alias("shorter"), *[F.col(f"p{m}").alias(f"before{m}") for m in each])
            joined = joined.withColumn("shorter", F.col("code").bitwiseAND(F.lit(mask(d - 1)).cast("long"))).join(before, "shorter")
        else:  # every byte, seen or not
            joined = joined.withColumns({f"before{m}": F.lit(1 / 256) for m in each})
        p = joined.select("code", *[(F.col(f"own{m}") + F.col(f"left{m}") * F.col(f"before{m}")).alias(f"p{m}") for m in each])
        out.append((materialise(p), contexts))
    return out


def _trusted(docs: DataFrame, labels: DataFrame, id_col: str, lang_col: str, label_id: str, label_col: str) -> DataFrame:
    """(id, lang) of trusted documents, narrow."""
    good = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("of")).agg(F.min(label_col).alias("good")).filter("good > 0")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").alias("lang"))
    return rows.join(good.select("of"), F.col("id") == F.col("of"), "left_semi")


def _folds(docs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """(of, fold), written: ids of trusted documents."""
    fold = F.pmod(F.xxhash64(F.lit("quality"), F.col("id")), F.lit(FOLDS)).cast("int").alias("fold")
    return materialise(_trusted(docs, labels, *columns).select(F.col("id").alias("of"), fold).distinct())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", held: int = 0) -> tuple[BackoffModel, DataFrame]:
    """The model that hasn't read the fold ``held``, in one place, and the table (id, sampled) of all trusted documents: whether it has read them.

    For looking at a model, or for other use of one. It goes to the driver, so it must fit there; ``perplexities`` is without that bound.
    """
    chosen = _folds(docs, labels, id_col, lang_col, label_id, label_col).select(F.col("of").alias("id"), (F.col("fold") != held).alias("sampled"))
    ids = chosen.filter("sampled").select(F.col("id").alias("of"))
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(sized(ids), F.col("id") == F.col("of"), "left_semi")
    every = docs.sparkSession.range(256).select(F.col("id").alias("code"), F.lit(0).cast("long").alias("n"))
    grams = count_grams(text.select("text"), DEPTH, lower=False).select("code", "n").union(every).groupBy("code").agg(F.sum("n").alias("n0"))
    levels = kneser_ney(materialise(grams))
    as_arrays = lambda df, name: (lambda a: (a[0], a[1].astype(np.float32)))(arrays(df.select("code", F.log2(name))))
    return BackoffModel([as_arrays(p, "p0") for p, _ in levels], [as_arrays(c, "left0") for _, c in levels]), chosen


def gram_counts(rows: DataFrame) -> DataFrame:
    """(code, n0, n1, ..., uses), written, from rows (fold: FOLDS if not trusted, text): counts in the texts of each model, that of all last, and in all texts."""
    n, fold = F.col("n"), F.col("key")
    trusted = [F.sum(F.when((fold != m) & (fold != FOLDS), n).otherwise(0)).alias(f"n{m}") for m in range(FOLDS + 1)]
    return materialise(tally_grams(rows, DEPTH, FOLDS + 1, lower=False).groupBy("code").agg(*trusted, F.sum("n").alias("uses")))


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", head_grams: int = HEAD_GRAMS, **more: Column) -> DataFrame:
    """(id, lang, trusted, perplexity), written, a row per document, with ``more`` columns; no perplexity for blank texts."""
    spark, models = docs.sparkSession, range(FOLDS + 1)
    chosen = _folds(docs, labels, id_col, lang_col, label_id, label_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").alias("lang"), *[c.alias(name) for name, c in more.items()], F.col(f"`{text_col}`").alias("text"))
    dealt = rows.select("id", "text").join(sized(chosen), F.col("id") == F.col("of"), "left")
    grams = gram_counts(dealt.select(F.coalesce("fold", F.lit(FOLDS)).alias("fold"), "text"))
    found = kneser_ney(grams.drop("uses"), FOLDS + 1)[-1][0]
    costs = materialise(found.select("code", *[F.round(-F.log2(f"p{m}") * PARTS).cast("int").alias(f"cost{m}") for m in models]))
    frequent = grams.filter(F.col("uses") >= threshold(grams, "uses", head_grams)).select("code").join(costs, "code")
    codes, *values = arrays(frequent)
    shared = share(spark, Head(codes, np.stack(values, axis=1), DEPTH))
    kept = rows.drop("text").schema.fields

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            bodies = [body(t, lower=False) for t in binary_values(batch.column(batch.num_columns - 1))]
            total, codes, times = opened(shared).score(bodies)
            numbers = pa.array(np.arange(number, number + len(bodies)))
            number += len(bodies)
            columns = [numbers, *batch.columns[:-1], pa.array([len(b) for b in bodies], pa.int64()), *[pa.array(total[:, m].astype(np.int64)) for m in models], pa.array([c.view(np.int64) for c in codes], pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    many = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), *kept, T.StructField("size", T.LongType()), *[T.StructField(f"head{m}", T.LongType()) for m in models], T.StructField("codes", many), T.StructField("times", many)])
    # Written, so that row numbers stay as they are.
    scored = materialise(map_arrow(rows, run, schema))
    rare = scored.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    rare = rare.join(costs, "code").groupBy("row").agg(*[F.sum(F.col("times") * F.col(f"cost{m}")).alias(f"rare{m}") for m in models])
    # The model of all is the last; array indices are from 0.
    model = F.coalesce("fold", F.lit(FOLDS))
    cost = F.get(F.array(*[F.col(f"head{m}") + F.coalesce(f"rare{m}", F.lit(0)) for m in models]), model)
    perplexity = F.when(F.col("size") > 1, F.pow(F.lit(2.0), cost / PARTS / F.col("size")))
    both = scored.drop("codes", "times").join(rare, "row", "left").join(sized(chosen), F.col("id") == F.col("of"), "left")
    return materialise(both.select(*[f.name for f in kept], F.col("fold").isNotNull().alias("trusted"), perplexity.alias("perplexity")))


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> tuple[DataFrame, float | None]:
    """(of, threshold) for each language with trusted documents, and one for the others; scored: (id, lang, trusted, perplexity)."""
    rows = scored.filter("trusted AND perplexity IS NOT NULL")
    # Exact, over bits rounded to thousandths, so that it is the same for any partitioning and its state is bounded.
    at = (F.pow(F.lit(2.0), F.percentile(F.round(F.log2("perplexity"), 3), quantile)) * margin).alias("threshold")
    return materialise(rows.groupBy(F.col("lang").alias("of")).agg(at)), rows.agg(at).first()[0]


def _judged(scored: DataFrame, quantile: float, margin: float) -> DataFrame:
    """``scored`` with threshold and keep."""
    limit, other = thresholds(scored, quantile, margin)
    both = scored.join(sized(limit), F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(other).cast("double")))
    return both.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, **options) -> DataFrame:
    """One row per document: id, lang, perplexity, threshold, keep."""
    scored = perplexities(docs, labels, id_col, text_col, lang_col, **options)
    return _judged(scored, quantile, margin).select("id", "lang", "perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, **options) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    digest = F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)
    scored = perplexities(docs, labels, id_col, text_col, lang_col, **options, digest=digest)
    names = [free_name(docs, x) for x in ("id", "lang", "digest")]
    # Rows of the same id, language and text have the same perplexity, and go together.
    bad = materialise(_judged(scored, quantile, margin).filter(~F.col("keep")).select("id", "lang", "digest").distinct().toDF(*names))
    own = F.col(f"`{id_col}`").cast("long"), F.col(f"`{lang_col}`"), digest
    same = [x.eqNullSafe(F.col(name)) for x, name in zip(own, names, strict=True)]
    return docs.join(sized(bad), same[0] & same[1] & same[2], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")
