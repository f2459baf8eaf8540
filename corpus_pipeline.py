"""From raw documents to a mixture: five stages, each of them from ``quaestor.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the rows of
``docs`` that stay with the columns of ``docs``, in the last stage each row as
often as the mixture takes it, with its copy_no.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaestor.llm import decontaminate, exact_dedup, mixing, near_copies, quality
from quaestor.llm.common import materialise, read


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_text),
    ("exact dedup", no_copies),
    ("simhash near-dedup", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("mixing to target weights", mixture),
]

#: Perplexities and similarities are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
