"""Run logs: which runs ended, and how long they took."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text


RUNS = "run_id string, title string, settings map<string,string>, started double, seconds double, error string"
TRIALS = "run_id string, qa_id long, trial int, turn int, response string, error string"


def recorded_run(spark: SparkSession, path: str, run_id: str, title: str, settings: dict, work: Callable[[], Any], clock: Callable[[], float] = time.time) -> Any:
    """Does the work and adds a row to the table of runs at ``path``: when it began and how long it took; a run that failed has an error and no seconds."""

    def add(seconds, error):
        row = (run_id, title, {k: str(v) for k, v in settings.items()}, started, seconds, error)
        spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(path)

    started = float(clock())
    try:
        out = work()
    except Exception as e:
        add(None, f"{type(e).__name__}: {e}")
        raise
    add(clock() - started, None)
    return out


def record_trials(responses: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's responses to the table of trials at ``path``."""
    responses.select(F.lit(run_id).alias("run_id"), "qa_id", "trial", "turn", "response", "error").write.mode("append").parquet(path)


def log_text(title: Column, settings: Column, started: Column, seconds: Column) -> Column:
    """A run as the text of a log, of which ``total_time`` reads the last line; settings by name. A run without seconds has no last line."""
    pair = lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(settings)), pair), "\n")
    # The lines with times.
    start = F.concat(F.lit("Current time "), text.fixed(started, 2))
    end = F.concat(F.lit("Finished after "), text.fixed(seconds, 2), F.lit(" seconds\n"))
    return F.concat(F.lit("=" * 49 + "\n"), title, F.lit("\n"), start, F.lit("\n"), listed, F.lit("\n\n"), F.coalesce(end, F.lit("")))


def last_line_of_log(content: Column) -> Column:
    """The last line of a log, with or without a final newline."""
    return F.regexp_extract(content, r"([^\n]*)\n?$", 1)


def seconds(line: Column) -> Column:
    """The number in 'Finished after N seconds', null if it isn't there."""
    return F.regexp_extract(line, r"Finished after ([0-9.]+) seconds", 1).try_cast("double")


def total_time(logs: DataFrame, content: str = "content") -> DataFrame:
    """One row: runs that ended, their seconds, and hours and minutes in words."""
    own = seconds(last_line_of_log(F.col(content)))
    total = logs.agg(F.count(own).alias("runs"), F.coalesce(F.sum(own), F.lit(0.0)).alias("seconds"))
    return total.withColumn("duration", text.duration(F.col("seconds")))
