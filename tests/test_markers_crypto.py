"""Stale-marker matching (D11/D12) against a brute-force substring check,
and encryption round trips (E1/E2)."""

import secrets

import pytest
from pyspark.sql import functions as F

from runledger.functions.crypto import decrypt_columns, encrypt_columns, rewrap_columns
from runledger.operators import markers


def _keys(spark, runs):
    """runs: (zone, job_nm, dl_data_dt, title_nm) -> invalidation keys."""
    df = spark.createDataFrame(runs, "zone string, job_nm string, dl_data_dt string, title_nm string")
    return markers.invalidation_keys(df.withColumn("route_error", F.lit(None).cast("string")), F.lit("T"))


def _brute(marker_rows, runs):
    out = set()
    for zone, folder, name in marker_rows:
        for rz, job, d, title in runs:
            if rz in ("", "skip"):
                continue
            key = f"{title.lower()}.{job}.{d.replace('-', '')}"
            if rz == zone and folder == d.replace("-", "") and key in name:
                out.add((zone, folder, name))
    return out


CASES_MARKERS = [
    ("ingt", "20240102", "tbl.pi_1.20240102.20240103_000000.success"),
    ("ingt", "20240102", "tbl.pi_1.20240102.20240102_000000.success"),  # ts starts with the date
    ("ingt", "20240102", "other.pi_1.20240102.20240103_000000.success"),
    ("ingt", "20240102", "x.tbl.pi_1.20240102.20240103_000000.success"),  # title ends in tbl
    ("ingt", "20240102", "tbl.pi_12.20240102.20240103_000000.success"),   # other job
    ("ingt", "20240102", "tbl.a.b.20240102.20240103_000000.success"),     # dotted job a.b
    ("ingt", "20240103", "tbl.pi_1.20240103.20240103_000000.success"),    # other date
    ("curated", "20240102", "tbl.pi_1.20240102.20240103_000000.success"),  # other zone
    ("ingt", "20240102", "nodots"),
    ("ingt", "20240102", ""),
]
CASES_RUNS = [
    ("ingt", "pi_1", "2024-01-02", "TBL"),
    ("ingt", "b", "2024-01-02", "tbl.a"),     # key tbl.a.b.20240102
    ("ingt", "pi_1", "2024-01-02", ""),       # empty title: any title of the job
    ("skip", "pi_12", "2024-01-02", "tbl"),
]


def test_stale_markers_equal_brute_force(spark):
    m = spark.createDataFrame(CASES_MARKERS, "zone string, folder_dt string, file_nm string"
                              ).withColumn("tenant", F.lit("T"))
    got = {tuple(r) for r in markers.stale_markers(m, _keys(spark, CASES_RUNS))
           .select("zone", "folder_dt", "file_nm").collect()}
    assert got == _brute(CASES_MARKERS, CASES_RUNS)
    assert ("ingt", "20240102", "tbl.pi_12.20240102.20240103_000000.success") not in got
    rest = markers.remaining_markers(m, _keys(spark, CASES_RUNS))
    assert rest.count() + len(got) == len(CASES_MARKERS)


def test_title_only_key_matches_suffix_title(spark):
    m = spark.createDataFrame([("ingt", "20240102", "x.tbl.pi_1.20240102.t.success")],
                              "zone string, folder_dt string, file_nm string").withColumn("tenant", F.lit("T"))
    keys = _keys(spark, [("ingt", "pi_1", "2024-01-02", "tbl")])
    assert markers.stale_markers(m, keys).count() == 1


def test_stale_markers_random_against_brute_force(spark):
    import random
    rnd = random.Random(7)
    jobs = ["pi_1", "pi_11", "pt_2", "a.b", "b", "po_3"]
    titles = ["", "t", "x.t", "T", "tt"]
    dates = ["2024-01-02", "2024-01-03"]
    runs = [(rnd.choice(["ingt", "curated"]), rnd.choice(jobs), rnd.choice(dates), rnd.choice(titles))
            for _ in range(20)]
    mk = []
    for _ in range(150):
        d = rnd.choice(dates).replace("-", "")
        ts = rnd.choice([d, "20991231"]) + "_000000"
        name = f"{rnd.choice(titles).lower()}.{rnd.choice(jobs)}.{d}.{ts}.success"
        mk.append((rnd.choice(["ingt", "curated"]), d, name))
    mk = sorted(set(mk))
    m = spark.createDataFrame(mk, "zone string, folder_dt string, file_nm string").withColumn("tenant", F.lit("T"))
    got = {tuple(r) for r in markers.stale_markers(m, _keys(spark, runs))
           .select("zone", "folder_dt", "file_nm").collect()}
    assert got == _brute(mk, runs)


def test_success_markers_need_zone_and_title(spark):
    routed = spark.createDataFrame([
        ("pi_1", "2024-01-02", "SUCCESS", "ingt", "Tbl"),
        ("pi_2", "2024-01-02", "RUNNING", "ingt", "Tbl"),
        ("po_3", "2024-01-02", "SUCCESS", "skip", ""),
        ("pt_4", "2024-01-02", "SUCCESS", "curated", ""),
        ("px_5", "2024-01-02", "SUCCESS", "", ""),
    ], "job_nm string, dl_data_dt string, job_sts string, zone string, title_nm string")
    out = markers.success_markers(routed, "/r", F.lit("TS"), F.lit("mono")).collect()
    assert [(r.job_nm, r.marker_path) for r in out] == \
        [("pi_1", "/r/mono/evtg/ingt/20240102/tbl.pi_1.20240102.TS.success")]


# ------------------------------------------------------------------ E1, E2
def test_encrypt_decrypt_roundtrip_and_wrong_key(spark):
    df = spark.createDataFrame([(1, "alice"), (2, None), (3, "ข้อความ")], "id int, name string")
    k1, k2 = secrets.token_bytes(32), secrets.token_bytes(32)
    enc = encrypt_columns(df, ["name"], k1)
    enc_rows = enc.collect()
    assert all(r.name != s.name for r, s in zip(sorted(enc_rows), sorted(df.collect())) if s.name)
    back = {r.id: r.name for r in decrypt_columns(enc, ["name"], k1).collect()}
    assert back == {1: "alice", 2: None, 3: "ข้อความ"}
    wrong = {r.id: r.name for r in decrypt_columns(enc, ["name"], k2).collect()}
    assert wrong == {1: None, 2: None, 3: None}


def test_rewrap(spark):
    df = spark.createDataFrame([(1, "secret")], "id int, v string")
    old, new = secrets.token_bytes(16), secrets.token_bytes(24)
    rew = rewrap_columns(encrypt_columns(df, ["v"], old), ["v"], old, new)
    assert decrypt_columns(rew, ["v"], new).collect()[0].v == "secret"
    assert decrypt_columns(rew, ["v"], old).collect()[0].v is None


def test_key_not_in_plan(spark, capsys):
    key = b"K" * 32
    df = encrypt_columns(spark.createDataFrame([(1, "x")], "id int, v string"), ["v"], key)
    df.explain(extended=True)
    plan = capsys.readouterr().out
    assert "aes_encrypt" in plan
    assert "KKKKKKKK" not in plan and key.hex() not in plan.lower()


def test_bad_key_length(spark):
    with pytest.raises(ValueError):
        encrypt_columns(spark.createDataFrame([(1, "x")], "id int, v string"), ["v"], b"short")


def test_markers_after_update_only_for_success(spark):
    routed = spark.createDataFrame([
        ("pi_1", "2024-01-02", "RUNNING", "ingt", "Tbl"),
        ("pi_2", "2024-01-02", "RUNNING", "ingt", "Tbl"),
    ], "job_nm string, dl_data_dt string, job_sts string, zone string, title_nm string")
    pred = F.col("job_nm") == "pi_1"
    out = markers.markers_after_update(routed, pred, {"job_sts": "SUCCESS"}, "/r", F.lit("TS"), F.lit("m"))
    assert [r.file_nm for r in out.collect()] == ["tbl.pi_1.20240102.TS.success"]
    none = markers.markers_after_update(routed, pred, {"job_sts": "FAILED"}, "/r", F.lit("TS"), F.lit("m"))
    assert none.count() == 0


def test_marker_table_append_and_stale_removal(spark):
    import uuid
    name = f"markers_{uuid.uuid4().hex[:8]}"
    markers.create_marker_table(spark, name)
    routed = spark.createDataFrame([
        ("pi_1", "2024-01-02", "SUCCESS", "ingt", "Tbl", "m"),
        ("pi_2", "2024-01-02", "SUCCESS", "ingt", "Tbl", "m"),
        ("pi_3", "2024-01-03", "SUCCESS", "ingt", "Tbl", "m"),
        ("pi_1", "2024-01-02", "SUCCESS", "ingt", "Tbl", "other"),
    ], "job_nm string, dl_data_dt string, job_sts string, zone string, title_nm string, monoline string")
    markers.write_markers(spark, name, markers.success_markers(routed, "/r", F.lit("TS"), F.col("monoline")))
    assert spark.table(name).count() == 4
    # A new run of pi_1 on 2024-01-02 invalidates its own tenant's marker only;
    # pi_3's folder is emptied and dropped.
    new = spark.createDataFrame([("pi_1", "2024-01-02", "ingt", "Tbl", None), ("pi_3", "2024-01-03", "ingt", "", None)],
                                "job_nm string, dl_data_dt string, zone string, title_nm string, route_error string")
    markers.remove_stale_markers(spark, name, markers.invalidation_keys(new, F.lit("m")))
    assert sorted((r.tenant, r.job_nm) for r in spark.table(name).collect()) == [("m", "pi_2"), ("other", "pi_1")]
    parts = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    assert sorted(parts) == ["tenant=m/zone=ingt/folder_dt=20240102", "tenant=other/zone=ingt/folder_dt=20240102"]
    spark.sql(f"DROP TABLE {name}")


def test_one_marker_for_several_runs_of_an_update(spark):
    routed = spark.createDataFrame([("pi_1", "2024-01-02", "RUNNING", "ingt", "Tbl")] * 2,
                                   "job_nm string, dl_data_dt string, job_sts string, zone string, title_nm string")
    out = markers.markers_after_update(routed, F.lit(True), {"job_sts": "SUCCESS"}, "/r", F.lit("TS"), F.lit("m"))
    assert out.count() == 1


def test_ciphertext_is_one_line_and_rewrap_keeps_damage_local(spark):
    old, new = secrets.token_bytes(32), secrets.token_bytes(32)
    df = spark.createDataFrame([("x" * 500,), ("short",), (None,)], "v string")
    enc = encrypt_columns(df, ["v"], old)
    assert not any("\n" in r.v or "\r" in r.v for r in enc.collect() if r.v)
    broken = enc.unionByName(spark.createDataFrame([("AAAA",)], "v string"))
    out = decrypt_columns(rewrap_columns(broken, ["v"], old, new), ["v"], new)
    assert sorted((r.v or "") for r in out.collect()) == ["", "", "short", "x" * 500]
