"""From judge responses to scores: trials, sentences and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text


def explode_trials(qa: DataFrame, times: int) -> DataFrame:
    """A row per trial."""
    if times < 1:
        raise ValueError("at least one trial")
    return qa.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def trial_scores(responses: DataFrame, threshold: float = -1.0) -> DataFrame:
    """(qa_id, hallucination_pred): the mean verdict of a pair's trials. The last turn of a trial counts."""
    own = responses.withColumn("verdict", text.verdict(F.col("response")))
    return own.groupBy("qa_id").agg(F.avg("verdict").alias("p")).select("qa_id", text.binarise(F.col("p"), threshold).alias("hallucination_pred"))


def sentence_samples(qa: DataFrame) -> DataFrame:
    """(qa_id, sent_no, sentence, sample_no, sample) from (qa_id, answer, samples): every sentence with every sample of its row."""
    rows = qa.select("qa_id", "samples", F.posexplode(text.sentences(F.col("answer"))).alias("sent_no", "sentence"))
    return rows.select("qa_id", "sent_no", "sentence", F.posexplode("samples").alias("sample_no", "sample"))


def contrast_scores(responses: DataFrame, trim: bool = False) -> DataFrame:
    """(qa_id, hallucination_pred): the mean over sentences of the mean over samples."""
    own = responses.withColumn("verdict", text.verdict(F.col("response"), supported=True, trim=trim))
    return own.groupBy("qa_id", "sent_no").agg(F.avg("verdict").alias("s")).groupBy("qa_id").agg(F.avg("s").alias("hallucination_pred"))
