"""The column rules against plain-Python statements of the original rules,
on random text (hypothesis), and a hot-key case for the per-run aggregates."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.operators import quality, reconcile

SETTINGS = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
TEXT = st.one_of(st.none(), st.sampled_from(["Y", "N", "y", "n", "", "YES", "x", "WEEKEND", "weekend",
                                             "HOLIDAY", "Holiday", "/a/", "/a", "C:\\b\\", "NULL"]),
                 st.text(alphabet="YNyn/\\aA-", max_size=4))
VALUES = st.lists(TEXT, min_size=1, max_size=25)


def flag_rule(v):
    if not v:
        return None
    if v.upper() not in ("Y", "N"):
        return quality.REASON_YN
    if v not in ("Y", "N"):
        return quality.REASON_UPPER
    return None


def value_rule(v, allowed):
    if v is None:
        return quality.REASON_NOT_IN_LIST
    if v.upper() in allowed:
        return quality.REASON_UPPER if v not in allowed else None
    return quality.REASON_NOT_IN_LIST


def path_rule(v):
    return quality.REASON_PATH if v and v[-1] not in ("/", "\\") else None


def reasons(spark, values, col):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.orderBy("i").select(col.alias("r")).collect()]


@SETTINGS
@given(values=VALUES)
def test_flag_rule(spark, values):
    assert reasons(spark, values, quality.flag_reason("v")) == [flag_rule(v) for v in values]


@SETTINGS
@given(values=VALUES, allowed=st.sampled_from([["WEEKEND", "HOLIDAY"], ["Y"], ["file"]]))
def test_value_rule(spark, values, allowed):
    assert reasons(spark, values, quality.value_reason("v", allowed)) == [value_rule(v, allowed) for v in values]


@SETTINGS
@given(values=VALUES)
def test_path_rule(spark, values):
    assert reasons(spark, values, quality.path_reason("v")) == [path_rule(v) for v in values]


def date_rule(text):
    import re
    try:
        if "-" in text:
            return dt.datetime.strptime(text, "%Y-%m-%d").date()
        if re.fullmatch(r"[0-9]{8}", text):
            return dt.datetime.strptime(text, "%Y%m%d").date()
    except ValueError:
        return None
    return None


DATES = st.one_of(
    st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2030, 12, 31)).flatmap(
        lambda d: st.sampled_from([d.isoformat(), d.strftime("%Y%m%d"), f"{d.year}-{d.month}-{d.day}"])),
    st.sampled_from(["1999-02-30", "20011301", "2024115", "abcd", "2024-13-01", "2024-1-32"]))


@SETTINGS
@given(values=st.lists(DATES, min_size=1, max_size=20))
def test_business_date_rule(spark, values):
    assert reasons(spark, values, quality.business_date("v")) == [date_rule(v) for v in values]


def test_hot_run_totals(spark):
    """One run holds a third of all activities; totals equal a direct count."""
    rows = []
    for i in range(3000):
        run = 1 if i % 3 == 0 else 100 + i
        fr, fw = 2, 2 if i % 7 else 1
        rows.append((run, i, i, '{"activityType":"Copy","activityName":"C","output":'
                     f'{{"filesRead":{fr},"filesWritten":{fw},"dataRead":5,"dataWritten":5}}}}'))
    df = spark.createDataFrame(rows, "run_id long, activity_seq int, activity_id long, doc string")
    acts = reconcile.parse_activities(df.repartition(8))
    hot = reconcile.copy_totals(acts, ["run_id"], 0, True).where(F.col("run_id") == 1).collect()[0]
    mine = [r for r in rows if r[0] == 1]
    assert hot.n_copy == len(mine) == 1000
    assert hot.files_written == sum(1 if r[1] % 7 == 0 else 2 for r in mine)
    assert hot.n_bad == sum(1 for r in mine if r[1] % 7 == 0)
    assert hot.bytes_written == 5 * sum(1 for r in mine if r[1] % 7)
