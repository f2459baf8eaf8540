"""Prompt templates by method and role, in our own words. Slots: [C] context, [Q] question, [A] answer, [S] sample or sentence, [R] report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENDING = "Finish with a line of this form:\n#Verdict#: Yes or No"
_ROLE = {"agnostic": "You check answers against what is known.", "medical": "You are a clinician who checks answers against a record."}
_METHODS = {
    "bcv": "Context:\n[C]\n\nQuestion: [Q]\nAnswer: [A]\n\nDoes the answer state anything that is wrong or that the context doesn't bear out? " + _ENDING,
    "bcv-cot": "Context:\n[C]\n\nQuestion: [Q]\nAnswer: [A]\n\nGo through the answer claim by claim, then say whether any is wrong or not borne out. " + _ENDING,
    "sca": "Context:\n[C]\n\nQuestion: [Q]\n[next]\nNow compare your own answer with this one: [A]\nDo they contradict each other? " + _ENDING,
    "issc": "Text: [C]\nSentence: [S]\n\nDoes the text support the sentence? " + _ENDING,
    "issc-cot": "Text: [C]\nSentence: [S]\n\nReason step by step on whether the text supports the sentence, then decide. Begin with a line #Reasoning#: and your reasons. " + _ENDING,
    "report-questions": "Report:\n[R]\n\nWrite ten questions on it as a JSON list of objects with question, right_answer and hallucinated_answer.",
    "hallucinate": "Context:\n[C]\n\nQuestion: [Q]\nRight answer: [A]\n\nWrite a plausible answer that is wrong.",
    "regenerate": "Context:\n[A]\n\nQuestion: [Q]\n\nAnswer from the context alone, or say: Missing information",
}


def table(spark: SparkSession) -> DataFrame:
    """(method, role, body)"""
    return spark.createDataFrame([(m, r, f"{text}\n\n{body}") for m, body in _METHODS.items() for r, text in _ROLE.items()], "method string, role string, body string")
