"""Property tests on random small inputs (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.operators import ledger, reconcile

STS = st.sampled_from(["RUNNING", "SUCCESS", "TRIGGER-RUNNING", None])
ROWS = st.lists(st.tuples(st.integers(0, 50), st.sampled_from(["a", "b", "c"]), STS), max_size=30)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def df_of(spark, rows):
    return spark.createDataFrame(rows, "log_no int, job_nm string, job_sts string")


@SETTINGS
@given(rows=ROWS, sts=STS)
def test_delete_plus_kept_is_all(spark, rows, sts):
    df = df_of(spark, rows)
    pred = F.col("job_sts") == sts if sts is not None else F.col("job_sts").isNull()
    kept = ledger.delete_where(df, pred).count()
    deleted = df.where(F.coalesce(pred, F.lit(False))).count()
    assert kept + deleted == len(rows)


@SETTINGS
@given(rows=ROWS)
def test_update_with_false_predicate_is_identity(spark, rows):
    df = df_of(spark, rows)
    out = ledger.update_rows(df, F.lit(False), {"job_sts": "X"})
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


FILES = st.lists(st.tuples(st.sampled_from(["f1", "f2", "f3", "f4"]), st.integers(0, 3)), max_size=12)


@SETTINGS
@given(src=FILES, tgt=FILES)
def test_listing_compare_covers_every_name_once(spark, src, tgt):
    s = spark.createDataFrame(src, "file_nm string, file_size int")
    t = spark.createDataFrame(tgt, "file_nm string, file_size int")
    out = reconcile.compare_listings(s, t, ["file_nm"]).collect()
    names = [r.file_nm for r in out]
    assert sorted(names) == sorted({n for n, _ in src} | {n for n, _ in tgt})
    for r in out:
        if r.status == "MATCH":
            assert r.src_size == r.tgt_size


LISTING = st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["a", "b", "c"]), st.integers(0, 9)), max_size=15)


@SETTINGS
@given(src=LISTING, tgt=LISTING)
def test_listing_totals_match_plain_sums(spark, src, tgt):
    def totals(rows):
        out = {}
        for b, _, size in rows:
            n, s = out.get(b, (0, 0))
            out[b] = (n + 1, s + size)
        return out
    schema = "batch_id int, file_nm string, file_size long"
    s = reconcile.listing_totals(spark.createDataFrame(src, schema), ["batch_id"], tag="src")
    t = reconcile.listing_totals(spark.createDataFrame(tgt, schema), ["batch_id"], tag="tgt")
    got = {r.batch_id: (r.src_files, r.src_bytes, r.tgt_files, r.tgt_bytes, r.files_match, r.bytes_match)
           for r in reconcile.compare_totals(s, t, ["batch_id"], "src", "tgt").collect()}
    ps, pt = totals(src), totals(tgt)
    want = {}
    for b in set(ps) | set(pt):
        sf, sb = ps.get(b, (0, 0))
        tf, tb = pt.get(b, (0, 0))
        want[b] = (sf, sb, tf, tb, sf == tf, sb == tb)
    assert got == want
