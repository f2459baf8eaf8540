"""Building question-answer test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import sampling, text

# Fixed values.
EXCLUDED_SOURCES = ("2_GARD_QA", "6_NINDS_QA", "7_SeniorHealth_QA", "9_CDC_QA", "5_NIDDK_QA")
UNKNOWN_CODE = "Unknown diagnosis code"
NO_ANSWER = "No information found."
QUESTION_SUFFIX = " - resources ?"
QUESTION_PREFIX = "Do you have information about "


def choose_answer(flag: Column, right: Column, wrong: Column) -> Column:
    return F.when(flag == 1, wrong).otherwise(right)


def qa_test(rows: DataFrame, id_col: str, accuracy: float, seed: str | int, question: str, right: str, wrong: str, context: str | None = None) -> DataFrame:
    """context, question, answer, hallucination; rows with an empty answer go."""
    flagged = rows.withColumn("hallucination", sampling.flag_above(sampling.uniform(F.col(id_col), seed), accuracy))
    answer = choose_answer(F.col("hallucination"), F.col(right), F.col(wrong)).alias("answer")
    kept = [F.col(context).alias("context")] if context else []
    return flagged.select(F.col(id_col), *kept, F.col(question).alias("question"), answer, "hallucination").filter("answer <> ''")


def with_samples(rows: DataFrame, answer: str, correct: Column) -> DataFrame:
    """The correct answers but for the one chosen, as samples; rows left without any go."""
    return rows.withColumn("samples", text.without(correct, F.col(answer))).filter(F.size("samples") > 0)


def good_pairs(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """Drops pairs without a question or an answer worth keeping; `` (are)`` goes from questions before the prefix is tested.

    Null stands for a missing element; an answer that is there but empty stays.
    """
    cleaned = rows.withColumn(question, F.replace(F.col(question), F.lit(" (are)"), F.lit("")))
    q, a = F.col(question), F.col(answer)
    return cleaned.filter(q.isNotNull() & ~q.endswith(QUESTION_SUFFIX) & ~q.startswith(QUESTION_PREFIX) & a.isNotNull() & (a != NO_ANSWER))


def usable_sources(rows: DataFrame, source: str, excluded=EXCLUDED_SOURCES) -> DataFrame:
    return rows.filter(F.col(source).rlike("^[0-9]") & ~F.col(source).isin(*excluded))


def known(rows: DataFrame, ids: DataFrame, on: str, wanted: bool = True) -> DataFrame:
    """Rows whose key is in ``ids``, or those whose isn't."""
    return rows.join(ids.select(on).distinct(), on, "left_semi" if wanted else "left_anti")


def filled(rows: DataFrame, column: str, empty: bool = False) -> DataFrame:
    """Rows with a value; an empty text counts as none unless told otherwise."""
    return rows.filter(F.col(column).isNotNull() & (F.lit(empty) | (F.col(column) != "")))


def join_reports(reports: DataFrame, qa: DataFrame, on: str, given: str, strict: bool = False) -> DataFrame:
    """Each report with each of its pairs. Null documents have no pairs; strict: fails if a report has no document."""
    if strict and not reports.join(qa, on, "left_anti").isEmpty():
        raise ValueError("reports without a document of pairs")
    return reports.join(qa.filter(F.col(given).isNotNull()), on)


def last_of_each(dimension: DataFrame, code: str, value: str, order: str) -> DataFrame:
    """A dictionary: of repeated codes the last counts."""
    return dimension.groupBy(code).agg(F.max_by(value, order).alias(value))


def look_up(rows: DataFrame, code: str, dimension: DataFrame, dim_code: str, value: str, default: str = UNKNOWN_CODE) -> DataFrame:
    """Adds the description of a code, or the default."""
    side = dimension.select(F.col(dim_code).alias("__code"), F.col(value).alias("__value"))
    return rows.join(side, F.col(code) == F.col("__code"), "left").withColumn(value, F.coalesce("__value", F.lit(default))).drop("__code", "__value")


def look_up_all(rows: DataFrame, id_col: str, list_col: str, dimension: DataFrame, dim_code: str, value: str, default: str = UNKNOWN_CODE) -> DataFrame:
    """(id, descriptions) of a list of codes, in its order."""
    each = rows.select(id_col, F.posexplode(list_col).alias("__pos", "__own"))
    found = look_up(each, "__own", dimension, dim_code, value, default)
    lists = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__pos", value))).alias("x"))
    return lists.select(id_col, F.col(f"x.{value}").alias("descriptions"))


def append(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
