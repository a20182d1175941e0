"""Drop-in entry points: original call shapes on the whole-table operators."""

import os
import uuid

import pytest
from pyspark.sql import types as T

from runledger.dropin import DropIn, predicate
from runledger.operators import ledger

LOG = T.StructType([T.StructField(c, T.StringType()) for c in
                    ["log_no", "job_sts", "rmrk", "monoline", "dl_data_dt", "job_nm"]])


@pytest.fixture()
def env(spark):
    db = f"cfg_{uuid.uuid4().hex[:6]}"
    spark.sql(f"CREATE DATABASE {db}")
    spark.createDataFrame([
        ("pi_1", "T", "Y"), ("pi_2", "T", "N"), ("pi_3", "T", "Y"), ("pi_3", "T", "y"), ("pi_4", "T", "X"),
    ], "job_nm string, trgt_tbl_nm string, actv_flag string").write.saveAsTable(f"{db}.tbl_ingt_job")
    ledger.create_ledger(spark, f"{db}.tbl_log", LOG)
    yield DropIn(spark, db, tenant="mono_a")
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_predicate_text(spark):
    assert str(predicate(None)) == str(predicate("  "))
    assert "job_nm" in str(predicate("WHERE job_nm = 'a'"))


def test_get_config_verdicts(env):
    assert env.get_config("tbl_ingt_job", "WHERE job_nm = 'pi_1'").count() == 1
    for job, msg in [("pi_2", "Inactive found"), ("pi_3", "Duplicate"), ("pi_4", "not found"),
                     ("pi_9", "not found")]:
        with pytest.raises(SystemError, match=msg):
            env.get_config("tbl_ingt_job", f"WHERE job_nm = '{job}'")
    with pytest.raises(SystemError):
        env.get_config("tbl_ingt_job", "WHERE job_nm = 'pi_9'", tbl_area=True)
    assert env.get_config("tbl_ingt_job", "WHERE job_nm = 'pi_4'", tbl_area=True).count() == 1


def test_ledger_round_trip(env, spark):
    env.insert_log("tbl_log", {"log_no": "1", "job_nm": "pi_1", "dl_data_dt": "2024-01-01",
                               "job_sts": "TRIGGER-RUNNING", "rmrk": ""})
    env.insert_log("tbl_log", [{"log_no": "2", "job_nm": "pi_2", "dl_data_dt": "2024-01-01",
                                "job_sts": "RUNNING", "rmrk": "it's"}], multi_values=True)
    env.chck_dup_job("tbl_log", "WHERE job_nm = 'pi_1'", flag="Y")
    with pytest.raises(SystemError):
        env.chck_dup_job("tbl_log", "WHERE job_nm = 'pi_2'")
    env.update_log("tbl_log", "WHERE job_nm = 'pi_2' ", {"job_sts": "SUCCESS", "rmrk": ""}, "Y")
    env.update_log("tbl_log", "WHERE job_nm = 'pi_1'",
                   {"rmrk": "CASE WHEN job_sts = 'TRIGGER-RUNNING' THEN 'T' END"}, "N")
    rows = {r.log_no: (r.job_sts, r.rmrk, r.monoline) for r in spark.table(f"{env.db}.tbl_log").collect()}
    assert rows == {"1": ("TRIGGER-RUNNING", "T", "MONO_A"), "2": ("SUCCESS", 'it"s', "MONO_A")}
    env.cleanup_log("tbl_log", {"job_nm": "pi_1"})
    env.cleanup_dsr_log("tbl_log", "job_sts = 'NONE'")
    assert [r.log_no for r in spark.table(f"{env.db}.tbl_log").collect()] == ["2"]


def test_validators_raise(env, spark):
    df = spark.createDataFrame([("Y", "/p/", "A"), ("y", "/p", "b")], "f string, p string, v string")
    with pytest.raises(ValueError):
        env.vld_flag_config(df, ["f"])
    with pytest.raises(ValueError):
        env.vld_path_config(df, ["p"])
    with pytest.raises(ValueError):
        env.vld_val_config(df, {"v": ["A", "B"]})
    with pytest.raises(ValueError, match="Null value"):
        env.vld_config(spark.createDataFrame([("",)], "c string"), ["c"])
    env.vld_config(df, ["f", "p"])


def test_control_file_and_copy_check(env, tmp_dir):
    os.makedirs(f"{tmp_dir}/a")
    os.makedirs(f"{tmp_dir}/b")
    for d, text in [("a", "12345"), ("b", "12345")]:
        with open(f"{tmp_dir}/{d}/f.dat", "w") as fh:
            fh.write(text)
    with open(f"{tmp_dir}/a/x.ctl", "w") as fh:
        fh.write("H|a|b|c|d|5\n")
    assert env.read_ctl_file(f"{tmp_dir}/a/x.ctl", {}) == 5
    with pytest.raises(ValueError):
        env.read_ctl_file(f"{tmp_dir}/a/x.ctl", {"ctl_cnt_pstn": "2"})
    env.vld_copy_file([f"{tmp_dir}/a/f.dat"], [f"{tmp_dir}/b/f.dat"])
    with open(f"{tmp_dir}/b/f.dat", "a") as fh:
        fh.write("!")
    with pytest.raises(RuntimeError):
        env.vld_copy_file([f"{tmp_dir}/a/f.dat"], [f"{tmp_dir}/b/f.dat"])


def test_dsr_and_archive_entry_points(env, spark):
    dsr = T.StructType([T.StructField(c, T.StringType()) for c in ["log_no", "job_sts", "dl_data_dt", "job_nm"]])
    ledger.create_ledger(spark, f"{env.db}.tbl_dsr", dsr, ledger.DSR_PARTITIONS)
    env.insert_dsr_log("tbl_dsr", {"log_no": "1", "job_sts": "RUNNING", "dl_data_dt": "2024-01-01", "job_nm": "j"})
    env.update_dsr_log("tbl_dsr", "WHERE log_no = '1'", {"job_sts": "SUCCESS"}, "Y")
    assert [tuple(r) for r in spark.table(f"{env.db}.tbl_dsr").select("log_no", "job_sts").collect()] == \
        [("1", "SUCCESS")]
    arch = T.StructType([T.StructField(c, T.StringType()) for c in ["adb_run_id", "monoline", "expt_sts"]])
    spark.createDataFrame([], arch).write.saveAsTable(f"{env.db}.tbl_arch_nb_log")
    env.insr_arch_nb_log({"adb_run_id": "7", "monoline": "MONO_A", "expt_sts": ""})
    r = spark.table(f"{env.db}.tbl_arch_nb_log").collect()[0]
    assert (r.adb_run_id, r.monoline, r.expt_sts) == ("7", "MONO_A", "NOT STARTED")


def test_marker_hooks(env, spark):
    from runledger.operators import markers
    env.marker_table, env.route_tables, env.marker_root = "tbl_markers", {"pi": "tbl_ingt_job"}, "/r"
    markers.create_marker_table(spark, f"{env.db}.tbl_markers")
    env.insert_log("tbl_log", {"log_no": "1", "job_nm": "pi_1", "dl_data_dt": "2024-01-02", "job_sts": "RUNNING"})
    env.update_log("tbl_log", "WHERE log_no = '1'", {"job_sts": "SUCCESS"}, "N")
    got = spark.table(f"{env.db}.tbl_markers").collect()
    assert len(got) == 1 and got[0].file_nm.startswith("t.pi_1.20240102.") and got[0].zone == "ingt"
    # A new run of the same job and date removes the marker.
    env.insert_log("tbl_log", {"log_no": "2", "job_nm": "pi_1", "dl_data_dt": "2024-01-02", "job_sts": "RUNNING"})
    assert spark.table(f"{env.db}.tbl_markers").count() == 0


def test_job_configuration_log(env, spark):
    spark.createDataFrame([], "job_nm string, actv_flag string, n string").write.saveAsTable(f"{env.db}.tbl_cfg_log")
    env.insert_log_job_configuration("tbl_cfg_log", {"job_nm": "pi_1", "actv_flag": False, "n": 0})
    env.insert_log_job_configuration("tbl_cfg_log", [{"job_nm": "it's", "actv_flag": True}, {"n": "5", "actv_flag": ""}],
                                     multi_values=True)
    got = sorted((tuple(r) for r in spark.table(f"{env.db}.tbl_cfg_log").collect()), key=str)
    assert got == sorted([("pi_1", None, None), ('it"s', "True", None), (None, None, "5")], key=str)


def test_bulk_update(env, spark):
    for i, job in enumerate(["pi_1", "pi_2", "pi_2"]):
        env.insert_log("tbl_log", {"log_no": str(i), "job_nm": job, "dl_data_dt": "2024-01-01", "job_sts": "RUNNING"})
    new = spark.createDataFrame([("pi_1", "DONE"), ("pi_2", "DONE")], "job_nm string, job_sts string")
    status = env.update_log_bulk("tbl_log", new, ["job_nm"], ["job_sts"], "Y")
    assert {r.job_nm: r.status for r in status.collect()} == {"pi_1": "OK", "pi_2": "DUPLICATE_ROWS"}
    assert {r.log_no: r.job_sts for r in spark.table(f"{env.db}.tbl_log").collect()} == {"0": "DONE", "1": "RUNNING", "2": "RUNNING"}


def test_copy_check_counts_empty_and_hidden_files(env, tmp_dir):
    for d, size in [("a", 5), ("b", 0)]:
        os.makedirs(f"{tmp_dir}/{d}")
        for name in ("f.dat", "_g.dat"):
            with open(f"{tmp_dir}/{d}/{name}", "w") as fh:
                fh.write("x" * (size if name == "f.dat" else 3))
    env.vld_copy_file([f"{tmp_dir}/a/_g.dat"], [f"{tmp_dir}/b/_g.dat"])
    with pytest.raises(RuntimeError) as e:
        env.vld_copy_file([f"{tmp_dir}/a/f.dat", f"{tmp_dir}/a/_g.dat"], [f"{tmp_dir}/b/f.dat", f"{tmp_dir}/b/_g.dat"])
    # The emptied copy is a difference of size, not a missing file.
    assert [(r["file_nm"], r["src_size"], r["tgt_size"]) for r in e.value.args[1]] == [("f.dat", 5, 0)]


def test_copy_reports_against_files(env, tmp_dir):
    import json
    for name, size in [("f.dat", 5), ("c.ctl", 2)]:
        with open(f"{tmp_dir}/{name}", "w") as fh:
            fh.write("x" * size)

    def copy(n, size):
        return {"activityType": "Copy", "activityName": "C",
                "output": {"filesRead": n, "filesWritten": n, "dataRead": size, "dataWritten": size}}

    def meta(name, size):
        return {"activityType": "GetMetadata", "activityName": "G", "output": {"itemName": name, "size": size}}

    data, control = [f"{tmp_dir}/f.dat"], [f"{tmp_dir}/c.ctl"]
    both = json.dumps({"value": [copy(1, 5), copy(1, 2), meta("f.dat", 5), meta("c.ctl", 2)]})
    env.vld_adf_copy_file(both, "G", data)
    env.vld_adf_copy_file_outbnd(both, "G", data, control)
    env.vld_adf_copy_file_outbnd_total(both, "G", data, control)
    for check, args, verdict in [(env.vld_adf_copy_file_outbnd, (both, "G", data, []), "COUNT"),
                                 (env.vld_adf_copy_file_outbnd, (both, "Other", data, control), "SIZE"),
                                 (env.vld_adf_copy_file_outbnd_total, (both, "G", data, []), "SIZE"),
                                 (env.vld_adf_copy_file, (both[:-1], "G", data), "MALFORMED")]:
        with pytest.raises(RuntimeError, match=verdict):
            check(*args)


def test_bulk_update_writes_markers(env, spark):
    from runledger.operators import markers
    env.marker_table, env.route_tables, env.marker_root = "tbl_markers", {"pi": "tbl_ingt_job"}, "/r"
    markers.create_marker_table(spark, f"{env.db}.tbl_markers")
    for i, job in enumerate(["pi_1", "pi_3"]):
        env.insert_log("tbl_log", {"log_no": str(i), "job_nm": job, "dl_data_dt": "2024-01-02", "job_sts": "RUNNING"})
    new = spark.createDataFrame([("pi_1", "SUCCESS"), ("pi_3", "FAILED")], "job_nm string, job_sts string")
    env.update_log_bulk("tbl_log", new, ["job_nm"], ["job_sts"])
    assert [r.job_nm for r in spark.table(f"{env.db}.tbl_markers").collect()] == ["pi_1"]


def test_allowed_values_as_a_table(env, spark):
    df = spark.createDataFrame([("A", "x"), ("b", "y")], "v string, w string")
    lists = spark.createDataFrame([("v", "A"), ("v", "B")], "column_name string, allowed_value string")
    with pytest.raises(ValueError) as e:
        env.vld_val_config(df, lists)
    assert [(r["column_name"], r["bad_value"]) for r in e.value.args[1]] == [("v", "b")]
    env.vld_val_config(df.where("v = 'A'"), lists)
