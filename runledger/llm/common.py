"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runledger.session import checkpoint_dir, table_path


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TEXT_ROWS = 1000         # rows in an Arrow batch that carries whole texts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  Python workers of a local session also get this package's
    folder on their path; a cluster has it installed or sent with the job."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint directory and
    read it back: lineage is cut and the rows survive a lost executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """At most so many rows in an Arrow batch, for the jobs that run within the block."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    spark.conf.set(option, str(rows))
    try:
        yield
    finally:
        spark.conf.set(option, before)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array (null: empty) as its bytes and n + 1 offsets from 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    o = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(array):
        return np.empty(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 22):
    """Split rows into runs of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def carried(docs: DataFrame, carry: list[str] | None) -> tuple[DataFrame, StructField]:
    """The columns to carry along (all by default) as one struct ``rec``, so
    that no column of the table can clash with an operator's own, and the text."""
    names = docs.columns if carry is None else carry
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("rec"), "text")
    return out, StructField("rec", out.schema["rec"].dataType)


def with_fields(rec: StructField, fields: str) -> StructType:
    """The schema of ``rec`` and the fields of a DDL string."""
    return StructType([rec, *StructType.fromDDL(fields).fields])


def sha256_of_list(column) -> F.Column:
    """Lower-case hex digest of the comma-joined strings."""
    return F.sha2(F.array_join(column, ","), 256)
