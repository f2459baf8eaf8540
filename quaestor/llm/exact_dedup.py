"""Exact dedup by progressive refinement, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. One pass over the texts
writes a narrow table of lengths and hashes of the first characters. Rows that share
their length with others are grouped by length and prefix; of the groups with more than
one row alone, a second pass reads the full content and groups by the full digest.
Counts are combined before every shuffle, so a group that holds a third of all rows
sends one row from each task.

Defined cases: a null text counts as empty; of equal texts the largest id stays
(null ids are smallest); rows that repeat both id and text are all marked as
kept by ``classes``, while ``drop_copies`` keeps one of them; an empty table
gives an empty result. Other columns, whatever their names, aren't touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.common import ascii_lower, ascii_lower_sql, free_name, materialise, read, sized

#: Characters that the second level hashes.
PREFIX_CHARS = 256


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def digest(text_col: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(_text(text_col)), 256))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, prefix) of every row, written. Lower-casing A-Z changes no length."""
    text = _text(text_col)
    prefix = F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS)))
    return materialise(docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).alias("n_bytes"), prefix.alias("prefix")))


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """(n_bytes, prefix) that several rows have, written; only rows that share their length get there."""
    lengths = materialise(rows.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("n_bytes"))
    left = rows.join(sized(lengths), "n_bytes", "left_semi")
    return materialise(left.groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("n_bytes", "prefix"))


def groups(members: DataFrame) -> DataFrame:
    """One row (digest, keep_id, group_size) for each text that several rows have, from rows (id, digest)."""
    each = members.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    return materialise(each.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")).filter("group_size > 1"))


def _with_levels(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = _text(text_col)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).alias("n_bytes"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"), F.col(f"`{text_col}`").alias("text"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. The column of digests asks for one of every text; groups are made of survivors' alone."""
    several = shared_prefixes(narrow(docs, id_col, text_col))
    rows = materialise(_with_levels(docs, id_col, text_col).select("id", "n_bytes", "prefix", digest("text").alias("digest")))
    found = groups(rows.join(sized(several), ["n_bytes", "prefix"], "left_semi").select("id", "digest"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select("id", "digest").join(sized(found), "digest", "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row for each text.

    Full content is read of the survivors of the first two levels alone. Rows go by
    their ids; where rows share an id, those are told apart by their digests.
    """
    rows = narrow(docs, id_col, text_col)
    several = sized(shared_prefixes(rows))
    members = materialise(_with_levels(docs, id_col, text_col).join(several, ["n_bytes", "prefix"], "left_semi").select("id", digest("text").alias("digest")))
    found = groups(members)
    marked = members.join(sized(found.select("digest", "keep_id")), "digest")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("of"))
    shared = materialise(repeated.join(sized(materialise(marked.select("id").distinct())), F.col("of").eqNullSafe(F.col("id")), "left_semi"))
    own, key, keep = F.col(f"`{id_col}`"), free_name(docs, "digest"), free_name(docs, "keep")
    mark = free_name(docs, "id")

    def by_id(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return df.join(sized(ids.toDF(mark)), own.eqNullSafe(F.col(mark)), how)

    stays = by_id(docs, materialise(marked.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id").distinct()), "left_anti")
    if shared.isEmpty():
        return stays
    texts = found.select(F.col("digest").alias(key), F.col("keep_id").alias(keep), F.lit(True).alias(mark))
    rest = by_id(docs, shared, "left_semi").withColumn(key, digest(text_col)).join(sized(texts), key, "left")
    single = rest.filter(F.col(mark).isNull())
    one = rest.filter(F.col(mark) & own.eqNullSafe(F.col(keep))).dropDuplicates([key])
    return by_id(stays, shared, "left_anti").unionByName(single.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, sha256({ascii_lower_sql("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
