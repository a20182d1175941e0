"""Ledger sinks (D1-D9 persisted) on a managed, partitioned parquet table."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.operators import ledger

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                       ["log_no", "job_sts", "rmrk", "monoline", "dl_data_dt", "job_nm"]])


@pytest.fixture()
def table(spark):
    name = f"ledger_{uuid.uuid4().hex[:8]}"
    ledger.create_ledger(spark, name, SCHEMA)
    rows = spark.createDataFrame([
        ("1", "RUNNING", "r", "2024-01-01", "pi_1"),
        ("2", "SUCCESS", "r", "2024-01-01", "pi_1"),
        ("3", "RUNNING", "r", "2024-01-02", "pi_1"),
        ("4", "TRIGGER-RUNNING", "r", "2024-01-01", "pt_2"),
    ], "log_no string, job_sts string, rmrk string, dl_data_dt string, job_nm string")
    ledger.write_append(spark, name, rows, ledger.tenant_defaults("mono_a"))
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def content(spark, name):
    return sorted(tuple(r) for r in spark.table(name)
                  .select("log_no", "job_sts", "rmrk", "monoline", "dl_data_dt", "job_nm").collect())


def test_append_aligns_and_defaults(spark, table):
    got = content(spark, table)
    assert got[0] == ("1", "RUNNING", "r", "MONO_A", "2024-01-01", "pi_1")
    more = spark.createDataFrame([("5", "", "MONO_B", "2024-01-03", "po_3")],
                                 "log_no string, rmrk string, monoline string, dl_data_dt string, job_nm string")
    ledger.write_append(spark, table, more, ledger.tenant_defaults("mono_a"))
    assert ("5", None, None, "MONO_B", "2024-01-03", "po_3") in content(spark, table)


def test_update_rewrites_only_touched_partitions(spark, table):
    pred = (F.col("job_nm") == "pi_1") & (F.col("dl_data_dt") == "2024-01-01") & (F.col("job_sts") == "RUNNING")
    ledger.write_update(spark, table, pred, {"job_sts": "SUCCESS", "rmrk": ""}, tenant="mono_a")
    got = content(spark, table)
    assert got == [
        ("1", "SUCCESS", "r", "MONO_A", "2024-01-01", "pi_1"),
        ("2", "SUCCESS", "r", "MONO_A", "2024-01-01", "pi_1"),
        ("3", "RUNNING", "r", "MONO_A", "2024-01-02", "pi_1"),
        ("4", "TRIGGER-RUNNING", "r", "MONO_A", "2024-01-01", "pt_2"),
    ]


def test_update_other_tenant_is_noop(spark, table):
    before = content(spark, table)
    ledger.write_update(spark, table, F.col("job_sts") == "RUNNING", {"job_sts": "X"}, tenant="mono_b")
    assert content(spark, table) == before


def test_update_refuses_partition_columns(spark, table):
    with pytest.raises(ValueError):
        ledger.write_update(spark, table, F.lit(True), {"job_nm": "x"})
    # A falsy assignment is dropped, so it does not count as moving rows.
    ledger.write_update(spark, table, F.col("log_no") == "4", {"job_nm": "", "rmrk": "z"})
    assert ("4", "TRIGGER-RUNNING", "z", "MONO_A", "2024-01-01", "pt_2") in content(spark, table)


def test_delete_drops_emptied_partition(spark, table):
    ledger.write_delete(spark, table, F.col("job_nm") == "pt_2")
    assert [r[0] for r in content(spark, table)] == ["1", "2", "3"]
    parts = [r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    assert not any("pt_2" in p for p in parts)


def test_delete_keeps_null_predicate_rows(spark, table):
    ledger.write_delete(spark, table, F.when(F.col("log_no") == "1", None).otherwise(F.col("log_no") == "3"))
    assert [r[0] for r in content(spark, table)] == ["1", "2", "4"]


def test_duplicate_update_guard(spark, table):
    log = spark.table(table)
    with pytest.raises(RuntimeError):
        ledger.assert_no_duplicate_update(log, F.col("job_nm") == "pi_1")
    ledger.assert_no_duplicate_update(log, F.col("log_no") == "4")


def test_partition_filter_reaches_scan(spark, table, capsys):
    spark.table(table).where((F.col("job_nm") == "pi_1") & (F.col("dl_data_dt") == "2024-01-01")).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "job_nm" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_dsr_layout_without_tenant(spark):
    name = f"dsr_{uuid.uuid4().hex[:8]}"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["log_no", "job_sts", "dl_data_dt", "job_nm"]])
    ledger.create_ledger(spark, name, schema, ledger.DSR_PARTITIONS)
    rows = spark.createDataFrame([("1", "RUNNING", "2024-01-01", "pi_1"), ("2", "RUNNING", "2024-01-02", "pi_1")],
                                 "log_no string, job_sts string, dl_data_dt string, job_nm string")
    ledger.write_append(spark, name, rows)
    ledger.write_update(spark, name, F.col("log_no") == "1", {"job_sts": "SUCCESS"})
    ledger.write_delete(spark, name, F.col("log_no") == "2")
    got = [tuple(r) for r in spark.table(name).select("log_no", "job_sts", "dl_data_dt", "job_nm").collect()]
    assert got == [("1", "SUCCESS", "2024-01-01", "pi_1")]
    assert len(spark.sql(f"SHOW PARTITIONS {name}").collect()) == 1
    spark.sql(f"DROP TABLE {name}")


def test_delete_many_emptied_partitions_in_batches(spark, monkeypatch):
    monkeypatch.setattr(ledger, "PARTITION_BATCH", 2)
    name = f"many_{uuid.uuid4().hex[:8]}"
    ledger.create_ledger(spark, name, SCHEMA)
    rows = spark.createDataFrame([(str(i), "X", "r", "M", f"2024-01-0{i}", "j") for i in range(1, 6)], SCHEMA)
    ledger.write_append(spark, name, rows)
    ledger.write_delete(spark, name, F.col("dl_data_dt") >= "2024-01-02")
    assert [r.log_no for r in spark.table(name).collect()] == ["1"]
    assert len(spark.sql(f"SHOW PARTITIONS {name}").collect()) == 1
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("parts", [(), ("dl_data_dt",), ("dl_data_dt", "job_nm")])
def test_no_row_is_lost_whatever_the_layout(spark, parts):
    """The whole table before and after, for every layout, NULL partitions too."""
    name = f"layout_{uuid.uuid4().hex[:8]}"
    rows = [("1", "RUNNING", "2024-01-01", "j"), ("2", "RUNNING", None, "j"), ("3", "DONE", "2024-01-01", "k"),
            ("4", "DONE", "2024-01-02", "j"), ("5", "DONE", None, None), ("6", "RUNNING", "2024-01-02", None)]
    df = spark.createDataFrame(rows, "log_no string, job_sts string, dl_data_dt string, job_nm string")
    df.write.format("parquet").partitionBy(*parts).saveAsTable(name)

    def table():
        return sorted(tuple(r) for r in spark.table(name).select("log_no", "job_sts", "dl_data_dt", "job_nm").collect())

    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        ledger.write_update(spark, name, F.col("log_no").isin("1", "2"), {"job_sts": "FAILED"})
        assert table() == [(a, "FAILED" if a in "12" else b, c, d) for a, b, c, d in rows]
        ledger.write_delete(spark, name, F.col("job_nm") == "j")
        assert table() == [r for r in rows if r[3] != "j"]
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        spark.sql(f"DROP TABLE {name}")


def test_rewrite_scans_named_partitions_only(spark, table, capsys):
    seen = []

    def change(df):
        df.explain("formatted")
        seen.append(capsys.readouterr().out)
        return df

    keys = spark.createDataFrame([("MONO_A", "2024-01-02", "pi_1")], "monoline string, dl_data_dt string, job_nm string")
    for touched in (F.col("log_no") == "3", keys):        # a data column, and a table of keys
        ledger.rewrite_partitions(spark, table, touched, change)
    for plan in seen:
        scan = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "2024-01-02" in scan and "pi_1" in scan and "Join" not in plan


def test_append_writes_few_files_per_partition(spark, table):
    rows = spark.range(200, numPartitions=20).select(
        F.col("id").cast("string").alias("log_no"), F.lit("2024-02-01").alias("dl_data_dt"),
        F.concat(F.lit("j"), (F.col("id") % 5).cast("string")).alias("job_nm"))
    ledger.write_append(spark, table, rows, ledger.tenant_defaults("mono_a"))
    files = spark.table(table).where("dl_data_dt = '2024-02-01'").select(
        "job_nm", F.input_file_name().alias("f")).distinct().groupBy("job_nm").count().collect()
    assert len(files) == 5 and max(r["count"] for r in files) <= 2
