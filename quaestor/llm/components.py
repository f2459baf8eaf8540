"""Connected components of an edge table, by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import materialise

MAX_ROUNDS = 60
#: Rows of one key are dealt to at most so many tasks.
SALTS = 64


def beside(rows: DataFrame, key: str, by: str, **aggregates: tuple) -> DataFrame:
    """``rows`` with aggregates of their key's rows: name=(function, column), functions that combine with themselves, such as minima.

    No key's rows meet in one task: they are dealt by the column ``by``, and only
    one row of each part goes to where the parts are combined. key, by: not null.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "__salt").agg(*[function(column).alias(name) for name, (function, column) in aggregates.items()])
    whole = parts.select(key, "__salt", *[function(name).over(Window.partitionBy(key)).alias(name) for name, (function, _) in aggregates.items()])
    return salted.join(whole, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node that can be reached.

    Each round is written to the shared folder. Minima are combined before the
    shuffle, and a node with very many neighbours has its edges dealt to SALTS
    tasks. Nothing goes to the driver but the sums that show that a round
    changed nothing. An edge with a null end is dropped.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = beside(both, "u", "v", m=(F.min, "v")).filter("v > u")
        large = low.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = beside(large, "u", "v", m=(F.min, "v"))
        small = low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
