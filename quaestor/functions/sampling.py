"""Reproducible randomness: everything follows from a row's key and a seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(id_col: Column, seed: str | int) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def uniform(id_col: Column, seed: str | int) -> Column:
    """In [0, 1), from 32 bits of the key."""
    return F.conv(F.substring(key(id_col, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def flag_above(u: Column, accuracy: float) -> Column:
    """1 (take the wrong answer) if u > accuracy."""
    return F.when(u > accuracy, 1).otherwise(0)


def flag_from(u: Column, precision: float) -> Column:
    """0 (take the right answer) if u < precision."""
    return F.when(u < precision, 0).otherwise(1)


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows; None keeps all."""
    if n is None:
        return df
    if n < 0:
        raise ValueError("a limit can't be negative")
    return df.orderBy(order).limit(n)


def exactly(df: DataFrame, id_col: str, n: int, seed: str | int, strict: bool = False) -> DataFrame:
    """n rows without replacement, in the order of their keys; strict: raises if there are fewer."""
    if strict and df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(key(F.col(id_col), seed), id_col).limit(n)


def choice(values: Column, id_col: Column, seed: str | int) -> Column:
    """One element of a list, null for an empty one."""
    at = F.pmod(F.conv(F.substring(key(id_col, seed), 1, 8), 16, 10).cast("bigint"), F.greatest(F.size(values), F.lit(1)))
    return F.try_element_at(values, (at + 1).cast("int"))


def per_group(df: DataFrame, by: list[str], id_col: str, n: int, seed: str | int) -> DataFrame:
    """At most n rows of each group; each task keeps no more than n a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key(F.col(id_col), seed), F.col(id_col)))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def stratified(df: DataFrame, source: str, file: str, id_col: str, n: int, seed: str | int, strict: bool = False) -> DataFrame:
    """One row per file, then n files per source (-1: all); strict: raises if a source has fewer."""
    if strict and n > 0:
        few = df.select(source, file).distinct().groupBy(source).count().filter(F.col("count") < n).first()
        if few:
            raise ValueError(f"{few[0]}: fewer than {n} files")
    one = per_group(df, [source, file], id_col, 1, seed)
    return one if n == -1 else per_group(one, [source], id_col, n, f"{seed}|files")
