"""Streaming ledger: exactly-once append and running run-status counts."""

import os

from pyspark.sql import types as T

from runledger.operators import ledger
from runledger.streaming import ledger_stream as ls

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                       ["log_no", "job_sts", "rmrk", "monoline", "dl_data_dt", "job_nm"]])
EVENTS = T.StructType([T.StructField(c, T.StringType()) for c in
                       ["log_no", "job_nm", "dl_data_dt", "job_sts", "rmrk"]])


def test_append_stream_exactly_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    spark.createDataFrame([("1", "pi_1", "2024-01-01", "RUNNING", "")], EVENTS) \
        .write.mode("append").parquet(src)
    out, ck = os.path.join(tmp_dir, "ledger"), os.path.join(tmp_dir, "ck")
    ev = ls.read_event_stream(spark, src, EVENTS)
    ls.append_stream(ev, out, SCHEMA, ledger.tenant_defaults("mono_a"), checkpoint=ck).awaitTermination()
    # A new file arrives; a restarted stream on the same checkpoint takes only it.
    spark.createDataFrame([("2", "pi_1", "2024-01-02", "SUCCESS", "x")], EVENTS) \
        .write.mode("append").parquet(src)
    ev = ls.read_event_stream(spark, src, EVENTS)
    ls.append_stream(ev, out, SCHEMA, ledger.tenant_defaults("mono_a"), checkpoint=ck).awaitTermination()
    got = sorted(tuple(r) for r in ls.read_ledger(spark, out, SCHEMA)
                 .select("log_no", "job_sts", "rmrk", "monoline", "dl_data_dt", "job_nm").collect())
    assert got == [("1", "RUNNING", None, "MONO_A", "2024-01-01", "pi_1"),
                   ("2", "SUCCESS", "x", "MONO_A", "2024-01-02", "pi_1")]


def test_run_status_stream_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    rows = [("1", "a", "d", "TRIGGER-RUNNING", None), ("2", "b", "d", "RUNNING", None),
            ("3", "b", "d", "TRIGGER-RUNNING", None), ("4", "c", "d", None, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(src)
    out = os.path.join(tmp_dir, "status")
    ev = ls.read_event_stream(spark, src, EVENTS)
    ls.write_snapshot(ls.run_status_stream(ev), out).awaitTermination()
    got = {r.job_nm: (r.n_running, r.n_trigger, r.n_other, r.is_duplicate, r.trigger_ok)
           for r in spark.read.parquet(out).collect()}
    assert got == {"a": (0, 1, 0, False, True), "b": (1, 1, 1, True, False), "c": (0, 0, 0, False, False)}
    batch = {r.job_nm: r.is_ok for r in ledger.trigger_run_status(
        spark.createDataFrame(rows, EVENTS), ["job_nm"]).collect()}
    assert {k: v[4] for k, v in got.items()} == batch


def test_snapshot_of_empty_stream_has_no_rows(spark, tmp_dir):
    src = os.path.join(tmp_dir, "empty")
    os.makedirs(src)
    out = os.path.join(tmp_dir, "status")
    status = ls.run_status_stream(ls.read_event_stream(spark, src, EVENTS))
    ls.write_snapshot(status, out).awaitTermination()
    snap = ls.read_snapshot(spark, out, status.schema)
    assert snap.count() == 0 and snap.columns == status.columns
