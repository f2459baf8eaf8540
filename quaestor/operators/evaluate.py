"""Evaluation of scores against labels, for any number of runs at once.

Everything is pre-aggregated by distinct score. Running counts along descending
score are taken in two steps, inside bins of the score and over the bins' sums,
so one very large run doesn't end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def counted(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows that have a score and a label."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isin(0, 1))


def roc_curve(df: DataFrame, run: str, score: str, label: str) -> DataFrame:
    """(run, threshold, fpr, tpr) for each distinct score, and the point (0, 0) at infinity; also the counts behind them.

    A rate without rows of its class is null. Rows without a score (null or NaN) or
    without a label of 0 or 1 don't count, here and in ``confusion``.
    """
    points = counted(df, score, label).groupBy(F.col(run).alias("run"), F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    points = points.withColumn("bin", F.floor(F.greatest(F.least("threshold", F.lit(1.0)), F.lit(0.0)) * BINS))
    inside = Window.partitionBy("run", "bin").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("run").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("run")
    bins = points.groupBy("run", "bin").agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("q"))
    bins = bins.select(
        "run", "bin", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("q").over(above), F.lit(0)).alias("q_above"), F.sum("p").over(every).alias("positives"), F.sum("q").over(every).alias("negatives")
    )
    rows = points.withColumn("p_in", F.sum("n_pos").over(inside)).withColumn("q_in", F.sum("n_neg").over(inside)).join(bins, ["run", "bin"])
    rows = rows.select("run", "threshold", "n_pos", "n_neg", (F.col("p_in") + F.col("p_above")).alias("tp"), (F.col("q_in") + F.col("q_above")).alias("fp"), "positives", "negatives")
    start = bins.select("run", "positives", "negatives").distinct().select("run", F.lit(float("inf")).alias("threshold"), *[F.lit(0).cast("long").alias(c) for c in ("n_pos", "n_neg", "tp", "fp")], "positives", "negatives")
    rate = lambda n, d: F.try_divide(F.col(n).cast("double"), F.col(d).cast("double"))
    return rows.unionByName(start).withColumn("fpr", rate("fp", "negatives")).withColumn("tpr", rate("tp", "positives"))


def auc(curve: DataFrame) -> DataFrame:
    """(run, auc) by trapezia; summed in whole numbers, so exact but for one division. Null without either class."""
    area = F.sum(F.col("n_neg") * (2 * F.col("tp") - F.col("n_pos")))
    return curve.groupBy("run").agg(F.try_divide(area.cast("double"), 2.0 * F.first("positives") * F.first("negatives")).alias("auc"))


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """(run, threshold, j): the first maximum of tpr - fpr along the curve, the highest threshold among ties; infinity without either class."""
    j = F.coalesce(F.col("tpr") - F.col("fpr"), F.lit(-1.0))
    known = F.when(F.col("tpr").isNull() | F.col("fpr").isNull(), F.when(F.col("threshold") == float("inf"), 0.0).otherwise(-1.0)).otherwise(j)
    return curve.withColumn("j", known).groupBy("run").agg(F.max_by("threshold", F.struct("j", "threshold")).alias("threshold"), F.max("j").alias("j"))


def confusion(df: DataFrame, run: str, score: str, label: str, thresholds: DataFrame) -> DataFrame:
    """tp, tn, fp, fn of each run at its threshold."""
    rows = counted(df, score, label).groupBy(F.col(run).alias("run"), F.col(score).alias("s"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(thresholds.select("run", "threshold"), "run")
    hit, n = F.col("s") >= F.col("threshold"), F.col("n")
    part = lambda c: F.sum(F.when(c, n).otherwise(0))
    return rows.groupBy("run").agg(
        F.first("threshold").alias("threshold"),
        part(hit & (F.col("y") == 1)).alias("tp"),
        part(~hit & (F.col("y") == 0)).alias("tn"),
        part(hit & (F.col("y") == 0)).alias("fp"),
        part(~hit & (F.col("y") == 1)).alias("fn"),
    )


def _over(n: Column, d: Column) -> Column:
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """The usual measures; 0 where a denominator is, but for accuracy, which has none without rows."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumn("accuracy", F.try_divide((tp + tn).cast("double"), (tp + tn + fp + fn).cast("double")))
    out = out.withColumn("precision", _over(tp, tp + fp)).withColumn("sensitivity", _over(tp, tp + fn)).withColumn("specificity", _over(tn, tn + fp))
    total = F.col("precision") + F.col("sensitivity")
    out = out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("sensitivity") / total).otherwise(0.0))
    out = out.withColumn("fpr", _over(fp, fp + tn)).withColumn("fnr", _over(fn, fn + tp))
    return out.withColumn("acc_balanced", (F.col("sensitivity") + F.col("specificity")) / 2)


def confusion_layout(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows: actual 1, 0 (hallucinated, factual); columns: predicted 1, 0."""
    return df.groupBy(F.col(actual).alias("actual")).agg(F.count_if(F.col(predicted) == 1).alias("predicted_hallucinated"), F.count_if(F.col(predicted) == 0).alias("predicted_factual"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) on [0, 1]; the last bin is closed, values outside are dropped, empty bins are there.

    Bins are found by comparing with the edges i / bins as floating point numbers have them.
    """
    v = F.col(value)
    at = sum((v >= F.lit(i * (1.0 / bins))).cast("int") for i in range(1, bins))
    n = df.filter(v.between(0.0, 1.0)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(n, "bin", "left").select("bin", (F.col("bin") / float(bins)).alias("low"), ((F.col("bin") + 1) / float(bins)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def check_labels(df: DataFrame, label: str) -> DataFrame:
    """Fails when a label isn't 0 or 1."""
    return df.withColumn(label, F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(F.raise_error(F.lit(f"{label} must be 0 or 1"))))
