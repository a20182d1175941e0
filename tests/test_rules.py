"""Golden rule tests: tiny hand-made inputs, expected rows written by hand
from the rules in SURVEY §2.8-2.12."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions import columns as X
from runledger.operators import calendar, config, ledger, quality, reconcile

S = T.StringType()


def _key(t):
    return tuple((v is None, "" if v is None else v) for v in t)


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)


def cfg_df(spark, data):
    schema = "job_nm string, trgt_tbl_nm string, actv_flag string, expt_data_type string, " \
             "expt_file_ppty string, expt_file_nm_fmt string"
    return spark.createDataFrame(data, schema)


# ------------------------------------------------------------------ V1-V5
def test_required_treats_empty_null_text_and_zero_as_missing(spark):
    df = spark.createDataFrame(
        [("a", 1, True), ("", 2, True), (None, 0, False), ("null", 3, None)],
        "s string, n int, b boolean")
    got = rows(quality.required_violations(df, ["s", "n", "b"]))
    assert got == [("b", 2), ("n", 1), ("s", 3)]


def test_required_reports_nothing_for_clean_columns(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert quality.required_violations(df, ["s"]).count() == 0


def test_flag_rules(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("y",), ("n",), ("X",), ("",), (None,), ("yes",)], "f string")
    got = rows(quality.flag_violations(df, ["f"]), "bad_value", "reason", "n_rows")
    assert got == [("X", quality.REASON_YN, 1), ("n", quality.REASON_UPPER, 1),
                   ("y", quality.REASON_UPPER, 1), ("yes", quality.REASON_YN, 1)]


def test_path_rules(spark):
    df = spark.createDataFrame([("/a/",), ("C:\\a\\",), ("/a",), ("",), (None,)], "p string")
    got = rows(quality.path_violations(df, ["p"]), "bad_value", "reason")
    assert got == [("/a", quality.REASON_PATH)]


def test_value_rules_lower_case_list_rejects_exact_values(spark):
    df = spark.createDataFrame([("file",), ("FILE",)], "t string")
    got = rows(quality.value_violations(df, {"t": ["file"]}), "bad_value", "reason")
    assert got == [("FILE", quality.REASON_NOT_IN_LIST), ("file", quality.REASON_NOT_IN_LIST)]


def test_value_rules_null_is_not_in_list(spark):
    df = spark.createDataFrame([("WEEKEND",), ("holiday",), ("other",), (None,)], "t string")
    got = rows(quality.value_violations(df, {"t": ["WEEKEND", "HOLIDAY"]}), "bad_value", "reason")
    assert got == [("holiday", quality.REASON_UPPER), ("other", quality.REASON_NOT_IN_LIST),
                   (None, quality.REASON_NOT_IN_LIST)]


def test_business_dates(spark):
    df = spark.createDataFrame([("2024-03-05",), ("2024-3-5",), ("20240305",), ("2024115",),
                                ("1999-02-30",), ("20011301",), ("abc",)], "d string")
    got = dict(rows(quality.business_dates(df, "d"), "d", "bsns_date"))
    assert got == {"2024-03-05": dt.date(2024, 3, 5), "2024-3-5": dt.date(2024, 3, 5),
                   "20240305": dt.date(2024, 3, 5), "2024115": None, "1999-02-30": None,
                   "20011301": None, "abc": None}


def test_assert_clean_raises(spark):
    df = spark.createDataFrame([("X",)], "f string")
    import pytest
    with pytest.raises(ValueError):
        quality.assert_clean(quality.flag_violations(df, ["f"]))
    quality.assert_clean(quality.flag_violations(spark.createDataFrame([("Y",)], "f string"), ["f"]))


# ------------------------------------------------------------------ A1, J6
def test_active_config_statuses(spark):
    cfg = cfg_df(spark, [
        ("ok", "T", "Y", None, None, None),
        ("ok", "T", "N", None, None, None),
        ("lower", "T", "y", None, None, None),
        ("inactive", "T", "N", None, None, None),
        ("dup", "T", "Y", None, None, None), ("dup", "T", "Y", None, None, None),
        ("other", "T", "Z", None, None, None),
        ("nullflag", "T", None, None, None, None),
    ])
    req = spark.createDataFrame([("ok",), ("missing",)], "job_nm string")
    got = dict(rows(config.active_config_status(cfg), "job_nm", "status"))
    assert got == {"ok": "OK", "lower": "OK", "inactive": "INACTIVE_ONLY", "dup": "DUPLICATE_ACTIVE",
                   "other": "NOT_FOUND", "nullflag": "NOT_FOUND"}
    got = dict(rows(config.active_config_status(cfg, requested=req), "job_nm", "status"))
    assert got == {"ok": "OK", "missing": "NOT_FOUND"}


def test_jobs_registered(spark):
    jobs = spark.createDataFrame([("a",), ("a",), ("b",)], "job_nm string")
    reg = spark.createDataFrame([("a",), ("a",), ("c",)], "job_nm string")
    assert rows(config.jobs_registered(jobs, reg)) == [("a", True), ("b", False)]


# ------------------------------------------------------------------ R1
def test_routing_rules(spark):
    cfg = cfg_df(spark, [
        ("pi_ok", "Tbl", "Y", None, None, None),
        ("pi_nulltitle", None, "Y", None, None, None),
        ("pi_dup", "T", "Y", None, None, None), ("pi_dup", "T", "Y", None, None, None),
        ("pt_ok", "Cur", "Y", None, None, None),
        ("po_file", None, "Y", "file", None, "OUT.csv"),
        ("po_file_null", None, "Y", "file", None, None),
        ("po_cosmos", None, "Y", "cosmos_db", '{"trgt_container_nm":"c1"}', None),
        ("po_badjson", None, "Y", "cosmos_db", "not json", None),
        ("po_nokey", None, "Y", "cosmos_db", '{"x":1}', None),
        ("po_inactive", None, "N", "file", None, "F"),
    ])
    jobs = spark.createDataFrame([(j,) for j in [
        "pi_ok", "pi_nulltitle", "pi_dup", "pi_missing", "pt_ok", "po_file", "po_file_null",
        "po_cosmos", "po_badjson", "po_nokey", "po_inactive", "po_missing", "xx_other"]], "job_nm string")
    got = {r.job_nm: (r.zone, r.title_nm, r.route_error)
           for r in config.route_jobs(jobs, {"pi": cfg, "pt": cfg, "po": cfg}).collect()}
    assert got == {
        "pi_ok": ("ingt", "Tbl", None),
        "pi_nulltitle": ("ingt", "", None),
        "pi_dup": ("ingt", "", config.MSG_DUPLICATE),
        "pi_missing": ("ingt", "", config.MSG_NOT_FOUND),
        "pt_ok": ("curated", "Cur", None),
        "po_file": ("outbnd", "OUT.csv", None),
        "po_file_null": ("outbnd", "", None),
        "po_cosmos": ("outbnd", "c1", None),
        "po_badjson": ("skip", "", None),
        "po_nokey": ("skip", "", None),
        "po_inactive": ("skip", "", None),
        "po_missing": ("skip", "", None),
        "xx_other": ("", "", None),
    }


def test_routing_uses_each_prefix_table_only(spark):
    ingest = cfg_df(spark, [("pi_1", "I", "Y", None, None, None)])
    transform = cfg_df(spark, [("pi_1", "WRONG", "Y", None, None, None)])
    jobs = spark.createDataFrame([("pi_1",)], "job_nm string")
    got = config.route_jobs(jobs, {"pi": ingest, "pt": transform, "po": transform}).collect()
    assert (got[0].zone, got[0].title_nm) == ("ingt", "I")


def test_workspace_first_hit_wins(spark):
    df = spark.createDataFrame([("x_CardX_dl",), ("card2",), ("AutoX",), ("dl_db",), ("misc",)], "d string")
    got = rows(df.select("d", X.workspace("d").alias("w"), X.main_source_system("d").alias("m")))
    assert got == sorted([("x_CardX_dl", "CARDX", "MOBIUS"), ("card2", "CARDX", "MOBIUS"),
                          ("AutoX", "AUTOX", "MOBIUS"), ("dl_db", "SCB", "RM"),
                          ("misc", "OTHERX", "MOBIUS")])


# ------------------------------------------------------------------ J2, V6
def test_holiday_flag_true_or_null(spark):
    runs = spark.createDataFrame(
        [("2024-06-01",), ("2024-06-03",), ("2024-06-04",)], "d string")  # Sat, Mon, Tue
    cal = spark.createDataFrame([("2024-06-03",)], "dt_en string")
    out = calendar.holiday_flags(runs, "d", cal, {
        "wk": F.lit("WEEKEND"), "hd": F.lit("HOLIDAY"), "low": F.lit("holiday")})
    got = {r.d: (r.wkdy_nm, r.wk, r.hd, r.low) for r in out.collect()}
    assert got == {"2024-06-01": ("Saturday", True, True, None),
                   "2024-06-03": ("Monday", None, True, None),
                   "2024-06-04": ("Tuesday", None, None, None)}


# ------------------------------------------------------------------ A2-A4
def test_trigger_and_duplicate_checks(spark):
    log = spark.createDataFrame([
        ("a", "TRIGGER-RUNNING"), ("b", "TRIGGER-RUNNING"), ("b", "RUNNING"),
        ("c", "TRIGGER-RUNNING"), ("c", None), ("d", "TRIGGER-RUNNING"), ("d", "TRIGGER-RUNNING"),
    ], "job_nm string, job_sts string")
    ok = dict(rows(ledger.trigger_run_status(log, ["job_nm"]), "job_nm", "is_ok"))
    assert ok == {"a": True, "b": False, "c": True, "d": False}
    dup = dict(rows(ledger.duplicate_runs(log, ["job_nm"]), "job_nm", "is_duplicate"))
    assert dup == {"a": False, "b": True, "c": False, "d": False}
    assert rows(ledger.duplicate_updates(log, ["job_nm"])) == [("b", 2), ("c", 2), ("d", 2)]


# ------------------------------------------------------------------ D1-D9
LOG_SCHEMA = T.StructType([T.StructField(c, S) for c in
                           ["log_no", "job_nm", "dl_data_dt", "monoline", "job_sts", "rmrk"]])


def test_align_to_order_defaults_and_falsy(spark):
    new = spark.createDataFrame([("pi_1", "", "it's", "7")], "job_nm string, job_sts string, rmrk string, log_no string")
    out = ledger.align_to(new, LOG_SCHEMA, ledger.tenant_defaults("mono_x"), swap_quotes=True)
    assert out.columns == [f.name for f in LOG_SCHEMA.fields]
    r = out.collect()[0]
    assert (r.log_no, r.job_nm, r.dl_data_dt, r.monoline, r.job_sts, r.rmrk) == \
        ("7", "pi_1", None, "MONO_X", None, 'it"s')


def test_update_rules(spark):
    log = spark.createDataFrame([
        ("1", "a", "d", "MONO_A", "RUNNING", "r"),
        ("2", "a", "d", "MONO_B", "RUNNING", "r"),
        ("3", "b", "d", "MONO_A", None, "r"),
    ], LOG_SCHEMA)
    pred = F.col("job_sts") == "RUNNING"
    out = ledger.update_rows(log, pred, {"job_sts": "SUCCESS", "rmrk": "", "job_nm": None,
                                         "dl_data_dt": F.concat(F.col("dl_data_dt"), F.lit("!"))},
                             tenant="mono_a")
    got = rows(out, "log_no", "job_sts", "rmrk", "dl_data_dt", "job_nm")
    assert got == [("1", "SUCCESS", "r", "d!", "a"), ("2", "RUNNING", "r", "d", "a"),
                   ("3", None, "r", "d", "b")]


def test_delete_keeps_null_predicate_rows(spark):
    log = spark.createDataFrame([("1", "a", None, None, "X", None), ("2", "b", None, None, None, None),
                                 ("3", "c", None, None, "Y", None)], LOG_SCHEMA)
    kept = ledger.delete_where(log, F.col("job_sts") == "X")
    assert rows(kept, "log_no") == [("2",), ("3",)]
    keys = spark.createDataFrame([("c",)], "job_nm string")
    assert rows(ledger.delete_keys(kept, keys), "log_no") == [("2",)]


def test_unique_rows_nulls_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "k string, v string")
    assert ledger.unique_rows(df).count() == 2


# ------------------------------------------------------------------ A5-A7, J3-J5, L2
def acts(spark, docs):
    df = spark.createDataFrame([(1, i, i, d) for i, d in enumerate(docs)],
                               "run_id long, activity_seq int, activity_id long, doc string")
    return reconcile.parse_activities(df)


def copy(fr, fw, dr=None, dw=None):
    out = {"filesRead": fr, "filesWritten": fw, "dataRead": dr, "dataWritten": dw}
    body = ",".join(f'"{k}":{v}' for k, v in out.items() if v is not None)
    return '{"activityType":"Copy","activityName":"C","output":{' + body + "}}"


def test_copy_totals_rules(spark):
    docs = [copy(3, 3, 10, 10),      # good: files 3, bytes 10
            copy(2, 1, 5, 5),        # files mismatch: files counted, bytes not, bad
            copy(4, 4, 7, 6),        # bytes mismatch: files counted, bytes counted, bad
            '{"activityType":"Copy","activityName":"C"}',  # no output: bad, nothing counted
            copy(1, 1),              # no data fields: files counted, bad only with data
            "not json"]
    with_data = reconcile.copy_totals(acts(spark, docs), ["run_id"], 2, True, "activity_seq").collect()[0]
    assert (with_data.n_copy, with_data.files_written, with_data.bytes_written, with_data.n_bad,
            with_data.failed, with_data.last_files_written) == (5, 9, 16, 4, True, 1)
    files_only = reconcile.copy_totals(acts(spark, docs), ["run_id"], 2, False).collect()[0]
    assert (files_only.n_bad, files_only.failed) == (2, False)


def test_last_metadata_wins(spark):
    meta = '{{"activityType":"GetMetadata","activityName":"{n}","output":{{"itemName":"f","size":{s}}}}}'
    docs = [meta.format(n="G", s=1), meta.format(n="G", s=2), meta.format(n="Other", s=9)]
    got = reconcile.last_metadata(acts(spark, docs), ["run_id"], "G", "activity_seq").collect()
    assert [(r.item_name, r.item_size) for r in got] == [("f", 2)]


def test_compare_listings_statuses(spark):
    src = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("d", 5), ("e", 6), ("e", 6)],
                                "file_nm string, file_size long")
    tgt = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), ("e", 6), ("z", 1)],
                                "file_nm string, file_size long")
    got = dict(rows(reconcile.compare_listings(src, tgt, ["file_nm"]), "file_nm", "status"))
    assert got == {"a": "MATCH", "b": "SIZE_MISMATCH", "c": "MISSING_IN_TARGET", "d": "DUPLICATE",
                   "e": "DUPLICATE", "z": "MISSING_IN_SOURCE"}


def test_union_listings_and_totals(spark):
    data = spark.createDataFrame([(1, "a", 5)], "b long, file_nm string, file_size long")
    ctl = spark.createDataFrame([(1, "a.ctl", 1)], "b long, file_nm string, file_size long")
    both = reconcile.union_listings(data, ctl)
    left = reconcile.listing_totals(both, ["b"], tag="l")
    right = reconcile.listing_totals(data, ["b"], tag="r")
    r = reconcile.compare_totals(left, right, ["b"], "l", "r").collect()[0]
    assert (r.l_files, r.r_files, r.files_match, r.l_bytes, r.r_bytes, r.bytes_match) == \
        (2, 1, False, 6, 5, False)


# ------------------------------------------------------------------ X functions
def test_scalar_functions(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678901), "x", None)],
                               "ts timestamp, msg string, nul string")
    r = df.select(
        X.time_text("ts", "date").alias("d"), X.time_text("ts", "datetime").alias("dt"),
        X.time_text("ts", "datetimelog").alias("log"), X.time_text("ts", "bogus").alias("other"),
        X.log_line("WARN", "msg", "ts").alias("line"),
        X.info_lines([("a", F.col("msg")), ("b", F.col("nul"))], "ts").alias("info"),
        X.none_to_empty("nul").alias("n2s"),
    ).collect()[0]
    assert (r.d, r.dt, r.log, r.other) == ("2024-01-02", "2024-01-02 03:04:05.678", "20240102_030405", "")
    assert r.line == "[2024-01-02 03:04:05.678] [WARN] x"
    assert r.info == "[2024-01-02 03:04:05.678] [INFO] a: x\n[2024-01-02 03:04:05.678] [INFO] b: NULL"
    assert r.n2s == ""


def test_predicate_value_extraction(spark):
    df = spark.createDataFrame([("WHERE job_nm ='a' AND dl_data_dt ='2024-01-01'",),
                                ("WHERE job_nm = 'a'",), ("WHERE job_nm ='x' OR job_nm ='y'",)], "p string")
    got = [r[0] for r in df.select(X.predicate_value("p", "job_nm")).collect()]
    assert got == ["a", None, "x"]


def test_markers_names(spark):
    df = spark.createDataFrame([("My.Tbl", "pi_1", "2024-01-02")], "t string, j string, d string")
    r = df.select(X.marker_file_name("t", "j", "d", F.lit("20240103_101010")).alias("n"),
                  X.marker_folder(F.lit("/root"), F.lit("mono"), F.lit("ingt"), "d").alias("f"),
                  X.marker_match_key(F.lit(""), "j", "d").alias("k")).collect()[0]
    assert r.n == "my.tbl.pi_1.20240102.20240103_101010.success"
    assert r.f == "/root/mono/evtg/ingt/20240102/"
    assert r.k == ".pi_1.20240102"


def test_base64_one_line_and_roundtrip(spark):
    text = "ก" * 200 + "é"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(X.b64_encode("t").alias("b")).select("b", X.b64_decode("b").alias("d")).collect()[0]
    import base64
    assert r.b == base64.b64encode(text.encode("utf-8")).decode()
    assert r.d == text


def test_json_is_read_as_a_whole(spark):
    from runledger.functions.columns import container_name, is_json_object

    cases = {'{"trgt_container_nm":"a"}': ("a", True), ' {"trgt_container_nm":"a"} ': ("a", True),
             '{"trgt_container_nm":"a"} junk': (None, False), '{"trgt_container_nm":"a"': (None, False),
             '{"trgt_container_nm":"a"}{"b":1}': (None, False), '{"trgt_container_nm":"a"}, {}': (None, False),
             '{"trgt_container_nm":"a"}]': (None, False), '{"trgt_container_nm":"a","trgt_container_nm":"b"}': ("b", True),
             '["a"]': (None, False), "not json": (None, False), "": (None, False), "{}": (None, True),
             # as strictly as the reader of the original: no single quotes, no raw line feed in a
             # string; a JSON null is a value, and the title of a null is empty
             "{'trgt_container_nm':'a'}": (None, False), '{"trgt_container_nm":"a\nb"}': (None, False),
             '{"trgt_container_nm": null}': ("", True), '\r\n{"trgt_container_nm":"a"}\t': ("a", True),
             '{"trgt_container_nm":"a"}],[{}': (None, False), '{},0],{}': (None, False), '{"a":1,}': (None, False),
             '{"trgt_container_nm":7}': ("7", True), '{trgt_container_nm:"a"}': (None, False)}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string")
    got = {r.d: (r.c, r.ok) for r in df.select("d", container_name("d").alias("c"), is_json_object("d").alias("ok")).collect()}
    assert got == {**cases, None: (None, False)}


def test_malformed_date_does_not_end_the_job(spark):
    df = spark.createDataFrame([("2024-01-06",), ("20240106x",), (None,)], "d string")
    cal = spark.createDataFrame([("2024-01-01",)], "dt_en string")
    got = {r.d: (r.is_date, r.w) for r in calendar.holiday_flags(df, "d", cal, {"w": F.lit("WEEKEND")}).collect()}
    assert got == {"2024-01-06": (True, True), "20240106x": (False, None), None: (False, None)}


def test_all_violations_are_reported(spark):
    df = spark.createDataFrame([(f"bad{i}",) for i in range(30)], "c string")
    with pytest.raises(ValueError) as e:
        quality.assert_clean(quality.value_violations(df, {"c": ["GOOD"]}))
    assert len(e.value.args[1]) == 30
