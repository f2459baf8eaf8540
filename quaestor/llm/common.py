"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A table is broadcast only up to this many rows, after they were counted.
BROADCAST_ROWS = 200_000

_own_folder: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; where that is unset, in a folder of our own, if all runs on this machine."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder. DataFrames that read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="quaestor-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/quaestor/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and lost executors recompute nothing before it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``limit`` rows; otherwise Spark joins it by shuffle."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= limit else small


def share(spark: SparkSession, value) -> Broadcast:
    """Sends a value of this package's types, of a size that is bounded, to the tasks; they need no copy of the package to read it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    """What ``share`` has sent, unpacked once in each worker."""
    if not hasattr(shared, "opened"):
        shared.opened = pickle.loads(shared.value)
    return shared.opened


def within_chars(sample: DataFrame, by: str, chars: int) -> DataFrame:
    """Of a sample (id, text, ...) that is bounded in rows, those of each value of ``by`` whose texts fit in so many characters, in the order of hashes."""
    order = Window.partitionBy(by).orderBy(F.xxhash64(F.lit("order"), "id"), F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(order)
    return sample.withColumn("__so_far", so_far).filter(F.col("__so_far") <= chars).drop("__so_far")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. The quick path is for texts of ASCII only, where ``lower`` is the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_lower_sql(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def binary_values(column: pa.Array) -> list:
    """Values of a string column as bytes (None for null), without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def id_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch: texts are long, and a task holds a batch in the JVM and in Python.
#: Its bytes are bounded by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set).
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_ROWS rows; a session that asks for fewer keeps its own number."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def with_arrow_column(df: DataFrame, name: str, kind: T.DataType, values) -> DataFrame:
    """``df`` with one more column; ``values`` makes its Arrow array from a record batch with all columns of ``df``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, values(batch)], [*batch.schema.names, name])

    return map_arrow(df, run, schema)

