"""Mixing sources to target weights by capped water-filling.

A source's target is its share, by weight, of the words wanted; no target goes
above ``max_epochs`` times the source's size, and what is cut off goes to the
others by weight until none is above. With the sources ordered by cap over
weight, those that stop at their cap come first, so one pass of running sums
over one row per source finds the level. Every document is then taken
floor(target / size) times, and the rest of the target is filled with documents
in the order of a seeded hash: 4096 bins of the hash, and 4096 bins in the bin
where the target is reached, are summed before any row is ordered, so no window
sees more than 4096 rows of a source.

Defined cases: a null text has size 0; the null source is a source of its own,
last in order; a source of size 0 has target 0 and gives nothing; rows that
repeat an id are taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.llm.common import free_name, materialise, read, sized

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def _hex(start: int, key: str):
    return F.conv(F.substring(key, start, 3), 16, 10).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "source",
        "source_size",
        "weight",
        (F.lit(share) * F.col("total") - F.lit(max_epochs) * F.coalesce(F.sum("source_size").over(level), F.lit(0))).alias("left"),
        (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(level), F.lit(0))).alias("open"),
    )
    cap = F.col("source_size") * F.lit(max_epochs)
    # Clamped sources come first in this order, so the first that isn't clamped sets the level for the rest.
    rows = rows.withColumn("clamped", F.col("weight") * F.col("left") >= cap * F.col("open"))
    level = F.max(F.when(~F.col("clamped"), F.struct("open", "left"))).over(Window.partitionBy())
    return rows.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("clamped"), cap.cast("double")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.open")).alias("target"),
    )


def _cut(bins: DataFrame, bin_col: str) -> DataFrame:
    """For each source: the first bin in which the running words pass ``want``, and what is still wanted there."""
    run = Window.partitionBy("source").orderBy(bin_col)
    rows = bins.withColumn("upto", F.sum("words").over(run)).filter(F.col("upto") > F.col("want"))
    return rows.groupBy("source").agg(F.min(bin_col).alias("cut"), F.min_by(F.col("want") - (F.col("upto") - F.col("words")), bin_col).alias("still"))


def _words(text_col: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _key(id_col: str, seed: int):
    return F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))


def _with_sources(df: DataFrame, side: DataFrame, n: int, how: str = "inner") -> DataFrame:
    side = side.withColumnRenamed("source", "of")
    return df.join(sized(side, n), F.col("source").eqNullSafe(F.col("of")), how).drop("of")


def rules(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One written row per source, from rows (source, size, b1, b2).

    whole: how often each document is taken. Once more go those in bins before (c1, c2), and at it if nearer.
    """
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = materialise(sources.select("*", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("want")))
    n = sources.count()
    want = sources.select("source", "want")
    first = materialise(_cut(_with_sources(rows.groupBy("source", "b1").agg(F.sum("size").alias("words")), want, n), "b1"))
    inside = _with_sources(rows, first, n).filter("b1 = cut").groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("still").alias("want"))
    second = materialise(_cut(inside, "b2").withColumnRenamed("cut", "c2"))
    cuts = _with_sources(first.select("source", F.col("cut").alias("c1")), second, n, "left")
    last = _with_sources(rows, cuts, n).filter("b1 = c1 AND b2 = c2").groupBy("source").agg(F.sum("size").alias("words"), F.first("still").alias("rest"))
    last = last.select("source", (2 * F.col("rest") >= F.col("words")).alias("nearer"))  # whole bins only: the nearer end
    return materialise(_with_sources(_with_sources(sources, cuts.drop("still"), n, "left"), last, n, "left"))


def _copies(rule: str, b1, b2, max_epochs: int):
    c1, c2, want = F.col(f"{rule}.c1"), F.col(f"{rule}.c2"), F.col(f"{rule}.want")
    # No cut: the part wanted is all of the source or, with nothing wanted, none.
    more = F.when(c1.isNull(), want > 0).otherwise((b1 < c1) | ((b1 == c1) & (c2.isNull() | (b2 < c2) | ((b2 == c2) & F.col(f"{rule}.nearer")))))
    return F.least(F.col(f"{rule}.whole") + F.coalesce(more, F.lit(False)).cast("int"), F.lit(max_epochs))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), _words(text_col).alias("size"), _key(id_col, seed).alias("key"))
    return materialise(rows.select("id", "source", "size", _hex(1, "key").alias("b1"), _hex(4, "key").alias("b2")))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies."""
    rows = _sizes(docs, id_col, text_col, source_col, seed)
    rule = rules(rows, weights, share, max_epochs)
    side = rule.select("source", F.struct(*[c for c in rule.columns if c != "source"]).alias("rule"))
    out = _with_sources(rows, side, rule.count())
    return out.select("id", "source", "size", "rule.source_size", "rule.target", _copies("rule", F.col("b1"), F.col("b2"), max_epochs).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture: each row of ``docs`` as often as the plan takes it, with a column copy_no (1, 2, ...).

    The rules of a few bytes per source go to the documents, which aren't shuffled.
    """
    rule = rules(_sizes(docs, id_col, text_col, source_col, seed), weights, share, max_epochs)
    name, of, number = (free_name(docs, x) for x in ("rule", "of", "number"))
    side = rule.select(F.col("source").alias(of), F.struct(*[c for c in rule.columns if c != "source"]).alias(name))
    rows = docs.join(sized(side), F.col(f"`{source_col}`").eqNullSafe(F.col(of)))
    key = _key(id_col, seed)
    copies = _copies(name, F.conv(F.substring(key, 1, 3), 16, 10).cast("int"), F.conv(F.substring(key, 4, 3), 16, 10).cast("int"), max_epochs)
    rows = rows.withColumn(number, copies).filter(F.col(number) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(number))))
    label = "copy_no" if "copy_no" not in {c.lower() for c in docs.columns} else number
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(number).alias(label))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|42') AS h FROM documents),
d2 AS (SELECT doc_id, source, size, ('0x' || substr(h, 1, 3))::INT AS b1, ('0x' || substr(h, 4, 3))::INT AS b2 FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d2 GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
t AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
    - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS opn FROM w),
u AS (SELECT *, weight * lft >= 2 * source_size * opn AS clamped FROM t),
v AS (SELECT max(opn) AS opn, arg_max(lft, opn) AS lft FROM u WHERE NOT clamped),
g AS (SELECT u.source, source_size, CASE WHEN clamped THEN (2 * source_size)::DOUBLE ELSE weight * v.lft::DOUBLE / v.opn::DOUBLE END AS target FROM u LEFT JOIN v ON true),
g2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
g3 AS (SELECT *, target - whole * source_size AS want FROM g2),
l1 AS (SELECT d2.source, b1, sum(size) AS words, any_value(want) AS want FROM d2 JOIN g3 ON d2.source IS NOT DISTINCT FROM g3.source GROUP BY d2.source, b1),
l1r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY b1) AS upto FROM l1),
c1 AS (SELECT source, min(b1) AS c1, arg_min(want - (upto - words), b1) AS still FROM l1r WHERE upto > want GROUP BY source),
l2 AS (SELECT d2.source, b2, sum(size) AS words, any_value(still) AS want FROM d2 JOIN c1 ON d2.source IS NOT DISTINCT FROM c1.source AND d2.b1 = c1.c1 GROUP BY d2.source, b2),
l2r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY b2) AS upto FROM l2),
c2 AS (SELECT source, min(b2) AS c2, arg_min(want - (upto - words), b2) AS still, arg_min(words, b2) AS words FROM l2r WHERE upto > want GROUP BY source),
k AS (SELECT c1.source, c1.c1, c2.c2, 2 * c2.still >= c2.words AS nearer FROM c1 LEFT JOIN c2 ON c1.source IS NOT DISTINCT FROM c2.source)
SELECT doc_id, size, source_size, target,
  (size * least(whole + CASE WHEN (CASE WHEN c1 IS NULL THEN want > 0 ELSE b1 < c1 OR (b1 = c1 AND (c2 IS NULL OR b2 < c2 OR (b2 = c2 AND nearer))) END) THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM d2 JOIN g3 ON d2.source IS NOT DISTINCT FROM g3.source LEFT JOIN k ON d2.source IS NOT DISTINCT FROM k.source
"""
