"""The ledger as a stream.

Runs are written to the ledger one event at a time; as a stream, the same
insert rules (schema alignment, tenant default: D1-D3) apply to each
micro-batch, and the duplicate-run and trigger-mode checks (A2, A3) become
running counts per job kept in the state store.

* ``append_stream`` writes through Spark's parquet file sink, which records
  every committed batch in its metadata log: a batch replayed after a failure
  is not written twice (exactly-once), and readers of the path see only
  committed files.
* ``run_status_stream`` is a streaming aggregate (state = one row per key,
  bounded by the number of jobs, not by the number of runs).
* ``write_snapshot`` materialises that aggregate with ``foreachBatch``,
  overwriting the snapshot each batch, so a replayed batch is idempotent.

Checkpoints go under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runledger.operators.ledger import (
    LEDGER_PARTITIONS, STS_RUNNING, STS_TRIGGER_RUNNING, align_to,
)
from runledger.session import checkpoint_dir


def stream_location(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def read_event_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None, name_glob: str | None = None) -> DataFrame:
    """Files arriving in ``folder`` (only names matching ``name_glob``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    return r.load(folder)


def append_stream(events: DataFrame, path: str, schema: T.StructType,
                  defaults: Mapping[str, Column | str] | None = None,
                  partitions: Sequence[str] = LEDGER_PARTITIONS, checkpoint: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """D1-D3 per micro-batch, exactly-once into a partitioned parquet path."""
    spark = events.sparkSession
    checkpoint = checkpoint or stream_location(spark, "ledger-append")
    w = (
        align_to(events, schema, defaults).writeStream.format("parquet")
        .partitionBy(*partitions)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_status_stream(events: DataFrame, keys: Sequence[str] = ("job_nm",),
                      status_col: str = "job_sts") -> DataFrame:
    """A2 + A3 as running counts per key (streaming aggregate)."""
    s = F.col(status_col)
    return (
        events.groupBy(*keys)
        .agg(F.count_if(s == STS_RUNNING).alias("n_running"),
             F.count_if(s == STS_TRIGGER_RUNNING).alias("n_trigger"),
             F.count_if(s != STS_TRIGGER_RUNNING).alias("n_other"))
        .withColumn("is_duplicate", F.col("n_running") > 0)
        .withColumn("trigger_ok", (F.col("n_trigger") == 1) & (F.col("n_other") == 0))
    )


def write_snapshot(status: DataFrame, path: str, checkpoint: str | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """Keep the latest complete result of a streaming aggregate at ``path``.

    Every batch is a folder of its own, which counts once its write has
    succeeded (a repeated batch overwrites its own folder), so a reader never
    meets half a snapshot.  The folder before it stays for readers that have
    just opened it; older ones are removed."""
    spark = status.sparkSession
    checkpoint = checkpoint or stream_location(spark, "run-status")

    def _write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        for old in _snapshots(spark, path)[:-2]:
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    w = (
        status.writeStream.outputMode("complete")
        .foreachBatch(_write)
        .option("checkpointLocation", checkpoint)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a ledger path with its own schema (no partition-type guessing:
    ``dl_data_dt`` stays text), through the sink's log of committed files."""
    return spark.read.schema(schema).parquet(path)


def _snapshots(spark: SparkSession, path: str) -> list:
    """The folders of complete batches, oldest first (as Hadoop paths)."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
    return sorted((f.getPath().getParent() for f in found), key=lambda p: p.getName())


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The latest complete snapshot, or no rows when no batch has run yet."""
    found = _snapshots(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(found[-1].toString())
