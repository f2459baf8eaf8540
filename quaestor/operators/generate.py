"""Making test sets with a model: prompts of a stage, and what becomes of its responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators.judge import last_turn

# Fixed values.
MISSING = "Missing information"
PAIR_KEYS = ("question", "right_answer", "hallucinated_answer")


def check_model(model: str, available: list[str]) -> str:
    """The name of a model, if it is available."""
    if model not in available:
        raise ValueError(f"{model}: none of {', '.join(available)}")
    return model


def checked_models(rows: DataFrame, column: str, available: list[str]) -> DataFrame:
    """Fails when a row names a model that isn't available."""
    own = F.col(column)
    return rows.withColumn(column, F.when(own.isin(*available), own).otherwise(F.raise_error(F.concat(F.coalesce(own, F.lit("null")), F.lit(": no such model")))))


def stage_prompts(rows: DataFrame, id_col: str, body: str, slots: list[tuple[str, Column]]) -> DataFrame:
    """(qa_id, trial, turns) for ``judge.ask_missing``: a template, filled for each row; each row is a chat of its own."""
    filled = text.fill(F.lit(body), slots)
    return rows.select(F.col(id_col).cast("long").alias("qa_id"), F.lit(0).alias("trial"), text.turns(filled).alias("turns"))


def _answers(responses: DataFrame) -> DataFrame:
    return last_turn(responses).groupBy(F.col("qa_id").alias("__qa")).agg(F.min_by("response", "trial").alias("__response"))


def regenerated(rows: DataFrame, responses: DataFrame, id_col: str, answer: str = "right_answer", drop_missing: bool = False) -> DataFrame:
    """Rows with the model's answer in place of their own. One that says it lacks information, or that failed, leaves the old answer; ``drop_missing`` drops rows of the first kind."""
    both = rows.join(_answers(responses), F.col(id_col) == F.col("__qa"), "left")
    lacking = F.coalesce(F.contains(F.col("__response"), F.lit(MISSING)), F.lit(False))
    out = both.filter(~lacking) if drop_missing else both
    return out.withColumn(answer, F.when(lacking, F.col(answer)).otherwise(F.coalesce("__response", answer))).drop("__qa", "__response")


def hallucinated(rows: DataFrame, responses: DataFrame, id_col: str, strict: bool = False) -> DataFrame:
    """Rows with the model's wrong answer, without sentences that speak of the context (strict: or of hallucinating); null where the call failed."""
    both = rows.join(_answers(responses), F.col(id_col) == F.col("__qa"), "left")
    return both.withColumn("hallucinated_answer", text.without_context_sentences(F.col("__response"), strict)).drop("__qa", "__response")


def documents_of_pairs(rows: DataFrame, id_col: str, response: str, names: tuple[str, ...] = PAIR_KEYS) -> DataFrame:
    """(id, ok, pairs) from responses that hold a JSON list of objects somewhere; a document with no list, or with any object of other keys, has none at all."""
    found = rows.select(id_col, text.qa_objects(text.bracketed(F.col(response))).alias("pairs"))
    ok = F.coalesce(F.forall("pairs", lambda m: F.coalesce(text.keys_are(m, *names), F.lit(False))), F.lit(False))
    return found.select(id_col, ok.alias("ok"), F.when(ok, F.col("pairs")).alias("pairs"))


def pairs(documents: DataFrame, id_col: str, names: tuple[str, ...] = PAIR_KEYS) -> DataFrame:
    """(id, pos, a column per key) of the documents that are whole."""
    each = documents.filter("ok").select(id_col, F.posexplode("pairs").alias("pos", "__m"))
    return each.select(id_col, "pos", *[F.col("__m")[n].alias(n) for n in names])
