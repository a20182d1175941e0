"""File sources (S2-S7) on files written into a fresh temporary folder."""

import json
import os

from pyspark.sql import functions as F

from runledger.sources import config_json as cj
from runledger.sources.control_files import ControlSpec, read_control_files
from runledger.sources.manifests import file_manifest


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_area_and_dependency_json(spark, tmp_dir):
    write(f"{tmp_dir}/cmmn_area/a.json", json.dumps({
        "area_nm": "A", "job": [
            {"job_type": "ingt", "job_nm": "pi_1", "job_seq": 1, "job_hldy_flag": "Y"},
            {"job_type": "tnfm", "job_nm": "pt_1", "job_seq": 2, "job_hldy_flag": "N"}]}, indent=2))
    write(f"{tmp_dir}/cmmn_area/b.json", json.dumps({"area_nm": "B", "job": []}, indent=2))
    write(f"{tmp_dir}/cmmn_dpdc/d.json", json.dumps({"job_nm": "pt_1", "pndng_job": [
        {"pndng_type": "job", "pndng_db": "db", "pndng_tbl": "t", "pndng_job_nm": "pi_1",
         "alw_zero_rec_flag": "N", "script_chck_dpdc": None}]}, indent=2))
    write(f"{tmp_dir}/ingt_job/x.json", json.dumps({"job_nm": "pi_1", "trgt_tbl_nm": "T"}, indent=2))
    status = cj.create_config_views(spark, tmp_dir)
    assert status["cmmn_area"] == "created" and status["tnfm_job"] == "missing"
    area = sorted(tuple(r) for r in spark.table("json_cmmn_area").collect())
    assert area == [("A", "ingt", "pi_1", 1, "Y"), ("A", "tnfm", "pt_1", 2, "N")]
    dep = spark.table("json_cmmn_dpdc").collect()
    assert [(r.job_nm, r.pndng_job_nm, r.script_chck_dpdc) for r in dep] == [("pt_1", "pi_1", None)]
    assert spark.table("json_ingt_job").collect()[0].trgt_tbl_nm == "T"


def test_control_files(spark, tmp_dir):
    write(f"{tmp_dir}/ctl/a.ctl", "H|x|1|a|b|42\n")
    write(f"{tmp_dir}/ctl/b.ctl", "H|x|1|a|b|n/a\n")
    write(f"{tmp_dir}/ctl/c.ctl", "H|short\n")
    write(f"{tmp_dir}/ctl/d.ctl", 'H|"a|b"|1|a|b| 7 \n')
    got = {os.path.basename(r.path): r.ctl_count for r in read_control_files(spark, f"{tmp_dir}/ctl/*.ctl").collect()}
    assert got == {"a.ctl": 42, "b.ctl": None, "c.ctl": None, "d.ctl": 7}


def test_control_files_header_delimiter_position(spark, tmp_dir):
    write(f"{tmp_dir}/ctl2/a.csv", "name,count\nx,+12\n")
    spec = ControlSpec.from_dict({"ctl_header": "1", "ctl_delimiter": ",", "ctl_cnt_pstn": "2"})
    assert spec == ControlSpec(True, ",", 2)
    assert read_control_files(spark, f"{tmp_dir}/ctl2/*.csv", spec).collect()[0].ctl_count == 12
    assert ControlSpec.from_dict({"ctl_header": "9"}) == ControlSpec()


def test_control_spec_rejects_bad_position():
    import pytest
    with pytest.raises(ValueError):
        ControlSpec.from_dict({"ctl_cnt_pstn": "x"})
    with pytest.raises(ValueError):
        ControlSpec(position=0)


def test_file_manifest_sizes_without_reading_content(spark, tmp_dir, capsys):
    write(f"{tmp_dir}/in/a.dat", "12345")
    write(f"{tmp_dir}/in/b.dat", "")
    df = file_manifest(spark, f"{tmp_dir}/in/*.dat")
    # Spark's file scan skips zero-byte files: an emptied copy shows as missing.
    assert sorted((r.file_nm, r.file_size) for r in df.collect()) == [("a.dat", 5)]
    df.explain()
    plan = capsys.readouterr().out
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_control_lines_with_extra_and_missing_fields(spark):
    from runledger.sources.control_files import control_counts_of_lines
    df = spark.createDataFrame([("H|a|b|c|d|42|x|y",), ("H|a",), ('H|"q|q"|b|c|d| 7 ',), ("",)], "line string")
    got = [r.ctl_count for r in control_counts_of_lines(df, "line").collect()]
    assert got == [42, None, 7, None]


def test_listing_holds_empty_and_hidden_files(spark, tmp_dir):
    from runledger.sources.manifests import list_files

    for name, text in [("a.dat", "12345"), ("b.dat", ""), ("_c.dat", "1"), (".d.dat", "22"), ("sub/e.dat", "333"),
                       ("sub/deep/f.dat", ""), ("sub two/g.dat", "1")]:
        write(f"{tmp_dir}/in/{name}", text)

    def found(paths, **kw):
        return sorted((r.file_nm, r.file_size) for r in list_files(spark, paths, **kw).collect())

    top = [(".d.dat", 2), ("_c.dat", 1), ("a.dat", 5), ("b.dat", 0)]
    assert found(f"{tmp_dir}/in") == found(f"file://{tmp_dir}/in/") == sorted(top)
    assert found(f"{tmp_dir}/in", recursive=True) == sorted(top + [("e.dat", 3), ("f.dat", 0), ("g.dat", 1)])
    assert found(f"{tmp_dir}/in/*.dat") == sorted(top)
    assert found(f"file://{tmp_dir}/in/?.dat") == [("a.dat", 5), ("b.dat", 0)]
    assert found(f"{tmp_dir}/in/sub*/[eg].dat") == [("e.dat", 3), ("g.dat", 1)]
    assert found(f"{tmp_dir}/in/{{a,b,z}}.dat") == [("a.dat", 5), ("b.dat", 0)]
    assert found(f"{tmp_dir}/in/none*") == [] == found([])
    paths = {r.path for p in (f"{tmp_dir}/in/a.dat", f"file:{tmp_dir}/in/a.dat", f"file://{tmp_dir}/in/a*")
             for r in list_files(spark, p).collect()}
    assert paths == {f"file:{tmp_dir}/in/a.dat"}
    named = [f"{tmp_dir}/in/b.dat", f"{tmp_dir}/in/_c.dat", f"{tmp_dir}/in/b.dat"]
    assert found(named) == [("_c.dat", 1), ("b.dat", 0), ("b.dat", 0)]
    df = list_files(spark, f"{tmp_dir}/in", recursive=True)
    assert df.rdd.getNumPartitions() == 3 and df.columns == ["path", "file_nm", "file_size"]
    import pytest
    with pytest.raises(Exception, match="missing"):
        list_files(spark, f"{tmp_dir}/in/missing").collect()


def test_empty_control_file_is_a_row(spark, tmp_dir):
    write(f"{tmp_dir}/ctl3/a.ctl", "H|x|1|a|b|42\n")
    write(f"{tmp_dir}/ctl3/b.ctl", "")
    got = {r.path: (r.ctl_count, r.is_valid) for r in read_control_files(spark, f"{tmp_dir}/ctl3/{{a,b}}.ctl").collect()}
    assert got == {f"file:{tmp_dir}/ctl3/a.ctl": (42, True), f"file:{tmp_dir}/ctl3/b.ctl": (None, False)}


def test_bad_config_files_are_kept_apart(spark, tmp_dir):
    write(f"{tmp_dir}/q/a.json", json.dumps({"area_nm": "A", "job": [{"job_nm": "pi_1", "job_seq": 1}]}, indent=2))
    write(f"{tmp_dir}/q/b.json", '{"area_nm": "B", "job": [')
    write(f"{tmp_dir}/q/c.json", json.dumps([{"area_nm": "C1"}, {"area_nm": "C2", "job": []}], indent=2))
    write(f"{tmp_dir}/q/d.json", "")
    write(f"{tmp_dir}/q/e.json", "{'area_nm': 'E'}")
    write(f"{tmp_dir}/q/f.json", '{"area_nm": "F"} {"area_nm": "G"}')
    write(f"{tmp_dir}/q/g.json", '[{"area_nm": "G"}, 5]')
    good, bad = cj.read_config_checked(spark, f"{tmp_dir}/q/*.json", cj.AREA_SCHEMA)
    assert sorted((os.path.basename(r.path), r.area_nm) for r in good.collect()) == [
        ("a.json", "A"), ("c.json", "C1"), ("c.json", "C2")]
    assert [r.job_nm for r in cj.flatten_area(good).collect()] == ["pi_1"]
    assert sorted(os.path.basename(r.path) for r in bad.collect()) == ["b.json", "d.json", "e.json", "f.json", "g.json"]
    assert {r.text for r in bad.where(F.col("path").endswith("b.json")).collect()} == {'{"area_nm": "B", "job": ['}
