"""Readers and writers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays or objects, one file each; a file that is ``null`` or empty has no rows. Adds the file's name."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = rows.filter(~F.regexp_replace("value", r"^\s+|\s+$", "").isin("", "null"))
    whole = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<struct<{_fields(schema)}>>")).otherwise(
        F.array(F.from_json("value", f"struct<{_fields(schema)}>"))
    )
    return rows.select("file", F.explode(F.filter(whole, lambda x: x.isNotNull())).alias("x")).select("file", "x.*")


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays by Spark's own reader, a row per element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header, all strings; quoted fields may hold quotes and line ends. Also for dictionaries exported from sheets."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(code, description); of repeated codes the last counts."""
    rows = csv(spark, path).select(F.trim("DIAGNOSIS CODE").alias("code"), F.col("LONG DESCRIPTION").alias("description"), F.monotonically_increasing_id().alias("line"))
    return rows.groupBy("code").agg(F.max_by("description", "line").alias("description"))


def clinical_xml(spark: SparkSession, path: str) -> DataFrame:
    """Reports with four leaf elements below a root of any name."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    leaf = lambda tag: F.expr(f"xpath_string(value, '/*/{tag}')").alias(tag)
    return rows.select("file", *[leaf(t) for t in ("chief_complaint", "admit_diagnosis", "discharge_diagnosis", "report_text")])


def clean_reports(reports: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Reports with codes as descriptions and clean text, values in lower case."""
    from quaestor.operators.datasets import look_up, look_up_all

    coded = reports.select(
        "file", text.strip(F.col("chief_complaint")).alias("chief_complaint"), F.replace(F.col("admit_diagnosis"), F.lit("."), F.lit("")).alias("admit"), text.codes(F.col("discharge_diagnosis")).alias("codes"), text.clean_report(F.col("report_text")).alias("report_text")
    )
    one = look_up(coded, "admit", dictionary, "code", "description").withColumnRenamed("description", "admit_diagnosis")
    lists = look_up_all(coded, "file", "codes", dictionary, "code", "description").withColumnRenamed("descriptions", "discharge_diagnosis")
    both = one.join(lists, "file", "left")
    discharge = F.transform(F.coalesce("discharge_diagnosis", F.array().cast("array<string>")), lambda d: F.lower(d))
    return both.select("file", F.lower("chief_complaint").alias("chief_complaint"), F.lower("admit_diagnosis").alias("admit_diagnosis"), discharge.alias("discharge_diagnosis"), "report_text")


def question_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, url, pair, question, answer) of files in either of two dialects of tags; a missing answer is null."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    count = F.expr("cast(xpath_number(value, 'count(//QAPair | //pair)') as int)")
    pairs = rows.withColumn("pair", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))))
    # Path expressions must be constant, so a pair's own block is cut out first.
    listed = pairs.withColumn("blocks", F.expr("regexp_extract_all(value, '(?s)<(?:QAPair|pair)\\\\b.*?</(?:QAPair|pair)>', 0)"))
    block = F.element_at("blocks", F.col("pair"))
    one = listed.select("file", F.expr("xpath_string(value, '/*/@url')").alias("url"), "pair", block.alias("block"))
    has = lambda tag: F.col("block").rlike(f"<{tag}\\b")
    value = lambda a, b: F.when(has(a), F.expr(f"xpath_string(block, '/*/{a}')")).when(has(b), F.expr(f"xpath_string(block, '/*/{b}')"))
    return one.select("file", "url", "pair", value("Question", "question").alias("question"), value("Answer", "answer").alias("answer"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def whole_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(file, content) of all files, of templates or logs for instance; empty ones are skipped."""
    reader = spark.read.option("pathGlobFilter", f"*{suffix}") if suffix else spark.read
    return reader.text(path, wholetext=True).filter("_metadata.file_size > 0").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def qa_file(spark: SparkSession, path: str) -> DataFrame:
    """A question-answer file by its name: medquad (JSON array), .json (lines) or .csv."""
    from quaestor.sources import schemas

    if "medquad" in path:
        return json_arrays(spark, path, schemas.MEDQUAD)
    if path.endswith(".json"):
        return json_lines(spark, path, schemas.HALUEVAL)
    if path.endswith(".csv"):
        return csv(spark, path)
    raise ValueError(f"{path}: neither .json nor .csv")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, so every row has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """A JSON array in each file; nulls are written. Rows go out one by one, so a file is never held whole."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches):
        before = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            texts = [before, *texts] if before is not None else ["[" + texts[0], *texts[1:]]
            before = texts.pop()
            yield pa.RecordBatch.from_arrays([pa.array([t + "," for t in texts], pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before is None else before + "]"])], ["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def split_rejects(df: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and the others."""
    return df.filter(F.coalesce(good, F.lit(False))), df.filter(~F.coalesce(good, F.lit(False)))
