"""The boundary to a language model: an expensive, nondeterministic call per row.

Responses are written before anything reads them, so a call isn't repeated when
its result is used twice, and a later run asks only for what is missing.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Judge(Protocol):
    def ask(self, turns: list[str], salt: str, timeout: float) -> list[str]:
        """The responses to the turns of one chat, which starts with no history."""


class HashJudge:
    """Deterministic stand-in: the verdict follows from a digest of the chat so far."""

    def ask(self, turns: list[str], salt: str, timeout: float = 900) -> list[str]:
        out, history = [], salt
        for turn in turns:
            history += "\n" + turn
            d = hashlib.md5(history.encode()).hexdigest()[0]
            out.append("thought\n#Verdict#: Yes" if d < "7" else "thought\n#Verdict#: No" if d < "e" else "no verdict")
        return out


SCHEMA = "qa_id long, trial int, turn int, response string, error string"


def ask_all(prompts: DataFrame, judge: Judge, timeout: float = 900, concurrency: int | None = None) -> DataFrame:
    """(qa_id, trial, turn, response, error) from (qa_id, trial, turns); a failed call gives null responses and the error.

    A chat that takes more than ``timeout`` seconds a turn has failed; its thread is left to itself.
    """
    rows = prompts.select(F.col("qa_id").cast("long"), F.col("trial").cast("int"), "turns")
    if concurrency:
        rows = rows.repartition(concurrency)

    def run(batches):
        for batch in batches:
            out = []
            for qa, trial, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pool = ThreadPoolExecutor(1)
                try:
                    told = pool.submit(judge.ask, turns, f"{qa}|{trial}", timeout).result(timeout * max(1, len(turns)))
                    out += [(qa, trial, k, r, None) for k, r in enumerate(told)]
                except Exception as e:  # the call is foreign code: one row's failure is data
                    out += [(qa, trial, k, None, f"{type(e).__name__}: {e}") for k in range(len(turns))]
                finally:
                    pool.shutdown(wait=False, cancel_futures=True)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["qa_id", "trial", "turn", "response", "error"])

    return rows.mapInArrow(run, SCHEMA)


def ask_missing(prompts: DataFrame, path: str, judge: Judge, timeout: float = 900, concurrency: int | None = None) -> DataFrame:
    """Asks for the trials that the table at ``path`` doesn't have yet, adds them, and returns the table."""
    spark = prompts.sparkSession
    try:
        done = spark.read.schema(SCHEMA).parquet(path).filter("response IS NOT NULL").select("qa_id", "trial").distinct()
        prompts = prompts.join(done, ["qa_id", "trial"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    ask_all(prompts, judge, timeout, concurrency).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def recorded(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses from an earlier run instead of a model."""
    return prompts.select("qa_id", "trial").join(responses, ["qa_id", "trial"])


def last_turn(responses: DataFrame) -> DataFrame:
    """The response to each trial's last turn; rows of calls that failed count only where no call succeeded, then as null."""
    return responses.groupBy("qa_id", "trial").agg(F.max_by("response", F.struct(F.col("response").isNotNull(), "turn")).alias("response"))
