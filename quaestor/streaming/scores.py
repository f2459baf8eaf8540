"""Verdicts as a stream. The reference area has no streams; this is for judges that answer over hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text


def verdict_rates(responses: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean verdict and count in each window of event time; rows later than ``late`` are dropped with the state."""
    own = responses.withColumn("verdict", text.verdict(F.col("response"))).withWatermark(time, late)
    out = own.groupBy(F.window(time, window)).agg(F.avg("verdict").alias("mean_verdict"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "mean_verdict", "n")
