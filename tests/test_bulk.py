"""Whole-table forms: updates from a table, allowed values from a table, stale
markers with a hot job ending, envelope keys."""

import random
import secrets
import uuid
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.crypto import (
    create_key_ring, decrypt_with_ring, encrypt_with_ring, rotate_key_ring,
)
from runledger.operators import ledger, markers, quality

COLUMNS = ["log_no", "job_sts", "rmrk", "monoline", "dl_data_dt", "job_nm"]
LOG = ", ".join(f"{c} string" for c in COLUMNS)
UPDATES = "job_nm string, dl_data_dt string, job_sts string, rmrk string, rows string"
ON, SET = ["job_nm", "dl_data_dt"], ["job_sts", "rmrk"]


# ------------------------------------------------------------------ D6 + A4
def brute_updates(rows, updates, tenant, guard):
    """What row-by-row updates do to each key, and the ledger after the sound ones."""
    per_key = defaultdict(list)
    for job, day, sts, rmrk, _ in updates:
        per_key[job, day].append((sts or None, rmrk or None))
    report, after = {}, {r: r for r in rows}
    for key, sets in per_key.items():
        hit = [r for r in rows if (r[5], r[4]) == key and None not in key and (tenant is None or r[3] == tenant.upper())]
        values = [{s[i] for s in sets if s[i] is not None} for i in (0, 1)]
        status = ("NOT_FOUND" if not hit else "CONFLICTING_UPDATES" if any(len(v) > 1 for v in values)
                  else "DUPLICATE_ROWS" if guard and len(hit) > 1 else "OK")
        report[key] = (len(sets), len(hit), status)
        if status == "OK":
            for r in hit:
                new = list(r)
                for i, v in enumerate(values):
                    if v:
                        new[1 + i] = next(iter(v))
                after[r] = tuple(new)
    return report, sorted(after.values(), key=str)


def random_case(seed):
    rng = random.Random(seed)
    jobs, days = ["a", "b", "c", "d", None], ["2024-01-01", "2024-01-02", None]
    rows = [(str(i), rng.choice(["RUNNING", None]), rng.choice(["r", None]), rng.choice(["MONO_A", "MONO_B", None]),
             rng.choice(days), rng.choice(jobs)) for i in range(25)] + [(f"h{i}", "RUNNING", "x", "MONO_A", days[0], "hot")
                                                                       for i in range(60)]
    updates = [(rng.choice([*jobs, "hot", "lost"]), rng.choice(days), rng.choice(["DONE", "FAILED", "", None]),
                rng.choice(["n", "", None]), "x") for _ in range(18)]
    return rows, updates


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("tenant,guard", [(None, True), ("mono_a", False)])
def test_updates_from_a_table(spark, seed, tenant, guard):
    rows, updates = random_case(seed)
    log, up = spark.createDataFrame(rows, LOG), spark.createDataFrame(updates, UPDATES)
    keyed = ledger.keyed_updates(log, up, ON, SET, tenant, guard)
    report, after = brute_updates(rows, updates, tenant, guard)
    assert {(r.job_nm, r.dl_data_dt): (r.n_updates, r.n_rows, r.status) for r in keyed.collect()} == report
    got = ledger.apply_updates(log, keyed, ON, SET, tenant).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == after


@pytest.fixture()
def table(spark):
    name = f"bulk_{uuid.uuid4().hex[:8]}"
    ledger.create_ledger(spark, name, T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS]))
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("on", [ON, ["job_nm"], [*ON, "monoline"]])
def test_updates_are_written_to_their_partitions(spark, table, on):
    rows = [("1", "RUNNING", "r", "MONO_A", "2024-01-01", "a"), ("2", "RUNNING", "r", "MONO_A", "2024-01-01", "b"),
            ("3", "RUNNING", "r", "MONO_A", "2024-01-02", "c"), ("4", "RUNNING", "r", "MONO_A", "2024-01-02", "c")]
    ledger.write_append(spark, table, spark.createDataFrame(rows, LOG))
    files = {r.f for r in spark.table(table).where("job_nm = 'b'").select(F.input_file_name().alias("f")).collect()}
    updates = spark.createDataFrame([("a", "2024-01-01", "DONE", "", "MONO_A"), ("c", "2024-01-02", "DONE", "", "MONO_A"),
                                     ("z", "2024-01-02", "DONE", "", "MONO_A")],
                                    "job_nm string, dl_data_dt string, job_sts string, rmrk string, monoline string")
    report = ledger.write_updates(spark, table, updates, on, SET, "mono_a")
    assert {r.job_nm: r.status for r in report.collect()} == {"a": "OK", "c": "DUPLICATE_ROWS", "z": "NOT_FOUND"}
    assert {r.log_no: r.job_sts for r in spark.table(table).collect()} == {"1": "DONE", "2": "RUNNING", "3": "RUNNING",
                                                                          "4": "RUNNING"}
    # The untouched partition keeps its file.
    assert {r.f for r in spark.table(table).where("job_nm = 'b'").select(F.input_file_name().alias("f")).collect()} == files
    ledger.write_updates(spark, table, updates, on, SET, "mono_a", guard=False)
    assert {r.log_no: r.job_sts for r in spark.table(table).collect()}["4"] == "DONE"


def test_no_updates_write_nothing(spark, table):
    none = spark.createDataFrame([], UPDATES)
    assert ledger.write_updates(spark, table, none, ON, SET).count() == 0
    with pytest.raises(ValueError):
        ledger.write_updates(spark, table, none, ON, ["dl_data_dt"])


def test_update_report_needs_no_join(spark, capsys):
    rows, updates = random_case(1)
    ledger.keyed_updates(spark.createDataFrame(rows, LOG), spark.createDataFrame(updates, UPDATES), ON, SET).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 1


# ------------------------------------------------------------------ V4
LISTS = {"c": ["A", "B", "b", "é"], "d": ["X"], "e": []}


def test_values_from_a_table_are_the_literal_report(spark):
    rows = [(rng, d, e) for rng in ["A", "a", "B", "b", "É", "é", "x", "", None] for d in ["X", "x", None] for e in ["q"]]
    df = spark.createDataFrame(rows, "c string, d string, e string")
    lists = spark.createDataFrame([(c, v) for c, vs in LISTS.items() for v in vs] + [("c", None), ("other", "x"), ("c", "A")],
                                  "column_name string, allowed_value string")
    a = quality.value_violations(df, LISTS).select("column_name", "bad_value", "reason", "n_rows")
    b = quality.value_violations_from(df, list(LISTS), lists)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_a_list_of_100_000_values(spark, capsys):
    lists = spark.range(100_000).select(F.lit("c").alias("column_name"),
                                        F.concat(F.lit("V"), F.col("id").cast("string")).alias("allowed_value"))
    df = spark.range(200_000).select(F.concat(F.when(F.col("id") % 10 == 0, "v").otherwise("V"),
                                              (F.col("id") % 120_000).cast("string")).alias("c"))
    got = {r.reason: r.n for r in quality.value_violations_from(df, ["c"], lists).groupBy("reason").agg(
        F.sum("n_rows").alias("n")).collect()}
    # Of the ids below 200,000, those modulo 120,000 below 100,000 are in the list: 180,000.
    assert got == {quality.REASON_NOT_IN_LIST: 20_000, quality.REASON_UPPER: 18_000}
    quality.value_violations_from(df, ["c"], lists).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out


# ------------------------------------------------------------------ D11
def test_jobs_with_one_ending_meet_their_own_keys_only(spark):
    n = 300
    names = [(f"t.x{i}.daily.20240102.20240103_000000.success", f"x{i}.daily") for i in range(n)]
    m = spark.createDataFrame([("T", "ingt", "20240102", f) for f, _ in names],
                              "tenant string, zone string, folder_dt string, file_nm string")
    runs = spark.createDataFrame([("ingt", j, "2024-01-02", "t", None) for _, j in names],
                                 "zone string, job_nm string, dl_data_dt string, title_nm string, route_error string")
    keys = markers.invalidation_keys(runs, F.lit("T"))
    cand, k, equal = markers._met(m, keys)
    assert cand.join(k, equal).count() == n  # not n * n
    assert markers.stale_markers(m, keys).count() == n


@pytest.mark.parametrize("seed", range(3))
def test_stale_markers_with_dots_everywhere(spark, seed):
    rng = random.Random(seed)
    part = lambda n: ".".join(rng.choice(["a", "b", "", "2024", "20240102"]) for _ in range(n))
    runs = [("ingt", part(rng.randint(1, 3)), rng.choice(["2024-01-02", "2024.01.02", ""]), part(rng.randint(1, 2)), None)
            for _ in range(25)]
    names = sorted({(rng.choice(["20240102", "2024.01.02", ""]), part(rng.randint(1, 7))) for _ in range(200)})
    m = spark.createDataFrame([("T", "ingt", d, f) for d, f in names], "tenant string, zone string, folder_dt string, file_nm string")
    r = spark.createDataFrame(runs, "zone string, job_nm string, dl_data_dt string, title_nm string, route_error string")
    got = {(x.folder_dt, x.file_nm) for x in markers.stale_markers(m, markers.invalidation_keys(r, F.lit("T"))).collect()}
    want = {(d, f) for d, f in names for _, job, day, title, _ in runs
            if d == day.replace("-", "") and f"{title}.{job}.{d}" in f}
    assert got == want


# ------------------------------------------------------------------ E2
def test_rotation_leaves_the_data(spark):
    old, new = secrets.token_bytes(32), secrets.token_bytes(16)
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "key_id int")
    ring = create_key_ring(ids, old)
    assert sorted(r.key_id for r in ring.collect()) == [1, 2]
    df = spark.createDataFrame([(1, "alice"), (2, "bob"), (2, None), (1, "x" * 300), (None, None)], "key_id int, v string")
    kept = encrypt_with_ring(df, ["v"], ring, old).cache()
    before = sorted((r.v or "") for r in kept.collect())
    rotated = rotate_key_ring(ring, old, new).cache()
    read = lambda r, w: sorted((x.v or "") for x in decrypt_with_ring(kept, ["v"], r, w).collect())
    plain = sorted(["alice", "bob", "", "", "x" * 300])
    assert read(rotated, new) == plain and read(ring, old) == plain
    assert read(rotated, old) == read(ring, new) == [""] * 5
    assert sorted((r.v or "") for r in kept.collect()) == before
    assert {r.wrapped_key for r in ring.collect()}.isdisjoint(r.wrapped_key for r in rotated.collect())
    # Another row's key opens nothing.
    swapped = kept.withColumn("key_id", F.lit(3) - F.col("key_id"))
    assert all(r.v is None for r in decrypt_with_ring(swapped, ["v"], ring, old).collect())


def test_lost_keys_fail_instead_of_losing_values(spark):
    wrap = secrets.token_bytes(32)
    ring = create_key_ring(spark.createDataFrame([(1,)], "key_id int"), wrap)
    with pytest.raises(PySparkException, match="no data key"):
        encrypt_with_ring(spark.createDataFrame([(2, "x")], "key_id int, v string"), ["v"], ring, wrap).collect()
    with pytest.raises(PySparkException, match="not opened"):
        rotate_key_ring(ring, secrets.token_bytes(32), wrap).collect()


def test_no_key_in_a_ring_plan(spark, capsys):
    wrap = b"W" * 32
    ring = create_key_ring(spark.createDataFrame([(1,)], "key_id int"), wrap)
    df = spark.createDataFrame([(1, "x")], "key_id int, v string")
    encrypt_with_ring(df, ["v"], ring, wrap).explain(extended=True)
    assert "WWWWWWWW" not in capsys.readouterr().out


def test_updates_of_a_table_without_partitions(spark):
    name = f"flat_{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([("1", "RUNNING", "a"), ("2", None, "b")], "log_no string, job_sts string, job_nm string").write.saveAsTable(name)
    up = spark.createDataFrame([("b", "DONE"), ("c", "DONE")], "job_nm string, job_sts string")
    report = ledger.write_updates(spark, name, up, ["job_nm"], ["job_sts"])
    assert {r.job_nm: r.status for r in report.collect()} == {"b": "OK", "c": "NOT_FOUND"}
    assert {r.log_no: r.job_sts for r in spark.table(name).collect()} == {"1": "RUNNING", "2": "DONE"}
    spark.sql(f"DROP TABLE {name}")
