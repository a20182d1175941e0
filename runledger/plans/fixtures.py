"""Control-plane tables derived from the driver's base tables (FIXTURES.md §2).

Each table has two forms that must agree: a DataFrame builder used by the
Spark queries, and the portable SQL text used as a CTE by the DuckDB oracle.
Every builder is a narrow projection of one base table (no shuffle), except
``hldy`` (one distinct) and ``job_config`` (a union of two scans).
"""

from __future__ import annotations

import functools
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.sources.tables import read_table

# The driver's tables are read-only, so each fixture is defined once per
# session and data folder and the (lazy) DataFrame is reused: every query
# still runs its whole plan over the files; only building the plan in Python
# is saved.  Nothing is cached in memory.
# The driver's tables are one row group each, so one task would parse them all.
SPREAD = 8

_DEFINED: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _once(fn):
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        per_session = _DEFINED.setdefault(spark, {})
        key = (fn.__name__, sf_dir)
        if key not in per_session:
            per_session[key] = fn(spark, sf_dir)
        return per_session[key]
    return wrapper


def _prefix(key):
    return (
        F.when(key % 4 == 0, "pi")
        .when(key % 4 == 1, "pt")
        .when(key % 4 == 2, "po")
        .otherwise("px")
    )


def _job_name(key):
    return F.concat(_prefix(key), F.lit("_"), key.cast("string"))


def _date_text(ts):
    return ts.cast("date").cast("string")


@_once
def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_log_of(read_table(spark, sf_dir, "orders"))


def job_log_of(o: DataFrame) -> DataFrame:
    """The job log from an orders DataFrame (batch or streaming)."""
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        ok.alias("log_no"),
        _job_name(ck).alias("job_nm"),
        _date_text(F.col("o_orderdate")).alias("dl_data_dt"),
        F.when(ok % 3 == 0, "MONO_A").otherwise("MONO_B").alias("monoline"),
        F.when(ok % 50 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("TRIGGER-RUNNING")
        .alias("job_sts"),
        F.col("o_orderpriority").alias("rmrk"),
    )


@_once
def job_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    bs = F.lit("\\")
    cfg = c.select(
        _job_name(k).alias("job_nm"),
        F.when(k % 15 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("c_mktsegment"))
        .alias("trgt_tbl_nm"),
        F.when(k % 10 == 7, "N")
        .when(k % 10 == 8, "y")
        .when(k % 10 == 9, F.lit(None).cast("string"))
        .otherwise("Y")
        .alias("actv_flag"),
        F.when(k % 8 == 2, "cosmos_db").otherwise("file").alias("expt_data_type"),
        F.when(k % 16 == 10, "not json")
        .when(k % 80 == 2, "{'trgt_container_nm':'quoted'}")
        .when(k % 80 == 18, '{"trgt_container_nm": null}')
        .when(k % 80 == 34, '{"trgt_container_nm":"two\nlines"}')
        .when(k % 160 == 50, '{"container":"other"}')
        .when(
            k % 8 == 2,
            F.concat(F.lit('{"trgt_container_nm":"cont_'), k.cast("string"), F.lit('"}')),
        )
        .alias("expt_file_ppty"),
        F.when(k % 12 == 6, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("OUT_"), k.cast("string"), F.lit(".csv")))
        .alias("expt_file_nm_fmt"),
        F.when(k % 4 == 0, "/mnt/in/")
        .when(k % 4 == 1, F.concat(F.lit("C:"), bs, F.lit("in"), bs))
        .when(k % 4 == 2, "/mnt/in")
        .alias("src_path"),
        F.when(k % 6 == 0, "WEEKEND")
        .when(k % 6 == 1, "holiday")
        .when(k % 6 == 2, "NULL")
        .when(k % 6 == 3, "")
        .otherwise("HOLIDAY")
        .alias("hldy_type"),
        F.concat(
            F.when(k % 5 == 0, "CardX")
            .when(k % 5 == 1, "card2")
            .when(k % 5 == 2, "AUTOX")
            .when(k % 5 == 3, "dl")
            .otherwise("misc"),
            F.lit("_db"),
        ).alias("db_nm"),
        k.alias("_k"),
    )
    # Every customer once, plus a second copy of each hundredth (duplicate
    # active rows).  Same rows as the SQL text's two-row product, as a union.
    return cfg.unionByName(cfg.where(F.col("_k") % 100 == 0)).drop("_k")


@_once
def allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of allowed values as a table; the list of export names grows with the jobs."""
    c = read_table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.concat(F.lit("OUT_"), F.col("c_custkey").cast("string"))
    names = c.where(k % 3 != 0).select(
        F.lit("expt_file_nm_fmt").alias("column_name"), F.concat(name, F.lit(".CSV")).alias("allowed_value"))
    as_is = c.where(k % 6 == 1).select(F.lit("expt_file_nm_fmt").alias("column_name"),
                                       F.concat(name, F.lit(".csv")).alias("allowed_value"))
    segments = c.where(F.col("c_mktsegment") != "BUILDING").select(
        F.lit("trgt_tbl_nm").alias("column_name"), F.col("c_mktsegment").alias("allowed_value")).distinct()
    types = spark.createDataFrame([("hldy_type", "WEEKEND"), ("hldy_type", "HOLIDAY"), ("other", "x"), ("hldy_type", None)],
                                  "column_name string, allowed_value string")
    return names.unionByName(as_is).unionByName(segments).unionByName(types)


# Area documents, most of them good: (k modulo, remainder, text with {k}).  First hit wins.
AREA_DOCS = (
    (31, 0, '{"area_nm":"a{k}","job":[{"job_nm":"pi_{k}"'),
    (37, 0, "{'area_nm':'a{k}'}"),
    (41, 0, '{"area_nm":"a{k}"} {"area_nm":"b{k}"}'),
    (43, 0, '"a{k}"'),
    (47, 0, '[{"area_nm":"a{k}"},"b{k}"]'),
    (53, 0, None),
    (59, 0, ""),
    (3, 0, '[{"area_nm":"a{k}","job":[{"job_nm":"pi_{k}","job_seq":1},{"job_nm":"pt_{k}"}]},\n {"area_nm":"b{k}"}]'),
    (1, 0, '{"area_nm":"a{k}",\n "job":[{"job_nm":"pi_{k}","job_seq":1}]}\n'),
)


@_once
def area_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    doc = None
    for mod, rest, text in AREA_DOCS:
        value = F.replace(F.lit(text).cast("string"), F.lit("{k}"), k.cast("string"))
        doc = F.when(k % mod == rest, value) if doc is None else doc.when(k % mod == rest, value)
    return read_table(spark, sf_dir, "customer").select(k.alias("k"), doc.alias("doc"))


@_once
def hldy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return (
        o.where(F.col("o_orderkey") % 40 == 0)
        .select(_date_text(F.col("o_orderdate")).alias("dt_en"))
        .distinct()
    )


@_once
def run_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the job log as they may arrive: some that no calendar has."""
    k, d = F.col("log_no"), F.col("dl_data_dt")
    return job_log(spark, sf_dir).select("log_no", F.when(k % 41 == 0, "1998-02-30").when(k % 43 == 0, "")
        .when(k % 47 == 0, F.lit(None).cast("string")).when(k % 53 == 0, "someday").otherwise(d).alias("dl_data_dt"))


@_once
def manifest_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("batch_id"),
        F.concat(F.lit("f_"), F.col("o_orderkey").cast("string"), F.lit(".dat")).alias("file_nm"),
        F.floor("o_totalprice").cast("bigint").alias("file_size"),
    )


@_once
def manifest_recv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    return o.where(ok % 20 != 0).select(
        F.col("o_custkey").alias("batch_id"),
        F.concat(
            F.when(ok % 77 == 0, "x_").otherwise("f_"), ok.cast("string"), F.lit(".dat")
        ).alias("file_nm"),
        (
            F.floor("o_totalprice").cast("bigint")
            + F.when(ok % 33 == 0, 1).otherwise(0)
        ).alias("file_size"),
    )


@_once
def ctl_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control files: one beside the data file of each fourth run."""
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    return o.where(ok % 4 == 1).select(
        ok.alias("run_id"), F.concat(F.lit("c_"), ok.cast("string"), F.lit(".ctl")).alias("file_nm"),
        F.lit(64).cast("bigint").alias("file_size"))


@_once
def activity_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    # JSON text is built and parsed per row: spread a scan that has too few
    # splits, hashed on the row's identity (unique), so one hot run cannot
    # land in one task.
    li = read_table(spark, sf_dir, "lineitem", spread_by=["l_orderkey", "l_linenumber"], spread=SPREAD)
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    price = F.floor("l_extendedprice").cast("bigint")
    qty = F.col("l_quantity").cast("bigint")
    s = lambda c: c.cast("string")
    get_meta = F.concat(
        F.lit('{"activityType":"GetMetadata","activityName":"Get File","output":{"itemName":"f_'),
        s(ok), F.lit('.dat","size":'), s(price), F.lit("}}"),
    )
    copy_no_output = F.lit('{"activityType":"Copy","activityName":"Copy File"}')
    copy = F.concat(
        F.lit('{"activityType":"Copy","activityName":"Copy File","output":{"filesRead":'),
        s(qty), F.lit(',"filesWritten":'),
        s(qty - F.when(pk % 50 == 1, 1).otherwise(0)),
        F.lit(',"dataRead":'), s(price), F.lit(',"dataWritten":'),
        s(price - F.when(pk % 50 == 2, 1).otherwise(0)),
        F.lit("}}"),
    )
    return li.select(
        ok.alias("run_id"),
        F.col("l_linenumber").alias("activity_seq"),
        pk.alias("activity_id"),
        F.when(F.col("l_returnflag") == "N", get_meta)
        .when(pk % 40 == 0, copy_no_output)
        .otherwise(copy)
        .alias("doc"),
    )


@_once
def activity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activities of ``activity_run`` as the copy service sends them: one
    document per run, the activities in order under ``value``."""
    acts = F.array_sort(F.collect_list(F.struct("activity_seq", "activity_id", "doc")))
    return activity_run(spark, sf_dir).groupBy("run_id").agg(acts.alias("a")).select(
        "run_id", F.concat(F.lit('{"runId":"r","value":['), F.array_join(F.col("a.doc"), ","),
                           F.lit("]}")).alias("doc"))


# One whole report per run, with every fault that the copy checks tell apart:
# (k modulo, remainder, text in place of the report).  First hit wins.
BAD_REPORTS = (
    (101, 0, '{"value":[{"activityType":"Copy"'),
    (103, 0, '{"value":[]} trailing'),
    (107, 0, "{'value':[]}"),
    (109, 0, '{"value":[],"note":"two\nlines"}'),
    (113, 0, '{"value":null}'),
    (127, 0, '{"values":[]}'),
    (131, 0, '[{"activityType":"Copy"}]'),
    (137, 0, None),
    (139, 0, '{"value":["text"]}'),
    (149, 0, '{"value":[{"activityName":"Copy File"}]}'),
    (151, 0, '{"value":[]}'),
    (157, 0, '{"value":[{"activityType":"GetMetadata","activityName":"Get File","output":{"itemName":"f"}}]}'),
)
# Activities of a run's report in order: (SQL condition on k, JSON with {k} and {s}).
REPORT_ACTIVITIES = (
    ("true", '{"activityType":"Wait","activityName":"Get File"}'),
    ("k % 11 not in (3, 5)", '{"activityType":"Copy","activityName":"A","output":{"filesRead":1,"filesWritten":1,'
     '"dataRead":{s},"dataWritten":{s}}}'),
    ("k % 11 = 3", '{"activityType":"Copy","activityName":"A","output":{"filesRead":1,"filesWritten":0,'
     '"dataRead":{s},"dataWritten":{s}}}'),
    ("k % 11 = 5", '{"activityType":"Copy","activityName":"A"}'),
    ("k % 33 = 3", '{"activityType":"Copy","activityName":"A","output":{"filesRead":2,"filesWritten":null}}'),
    ("k % 55 = 5", '{"activityType":"Copy","activityName":"A","output":"failed"}'),
    ("k % 4 = 1 and k % 12 <> 1", '{"activityType":"Copy","activityName":"C","output":{"filesRead":"1",'
     '"filesWritten":"1","dataRead":64,"dataWritten":64}}'),
    ("k % 13 = 2", '{"activityType":"Copy","activityName":"B","output":{"filesRead":0,"filesWritten":0,'
     '"dataRead":9,"dataWritten":8}}'),
    ("k % 9 <> 0", '{"activityType":"GetMetadata","activityName":"Get File","output":{"itemName":"f_{k}.dat",'
     '"size":{s}}}'),
    ("k % 7 = 0", '{"activityType":"GetMetadata","activityName":"Get File","output":{"itemName":"f_{k}.dat",'
     '"size":5}}'),
    ("k % 14 = 0", '{"activityType":"GetMetadata","activityName":"Get File","output":{"itemName":"f_{k}.dat",'
     '"size":{s}}}'),
    ("k % 4 = 1 and k % 24 <> 1", '{"activityType":"GetMetadata","activityName":"Get File","output":'
     '{"itemName":"c_{k}.ctl","size":64}}'),
    ("k % 19 = 0", '{"activityType":"GetMetadata","activityName":"Get File","output":{"itemName":"x_{k}.dat",'
     '"size":1}}'),
    ("k % 3 = 0", '{"activityType":"GetMetadata","activityName":"Other","output":{"itemName":"f_{k}.dat",'
     '"size":2}}'),
)


def _activity_text(text: str):
    k, s = F.col("k").cast("string"), F.col("s").cast("string")
    return F.replace(F.replace(F.lit(text), F.lit("{k}"), k), F.lit("{s}"), s)


@_once
def copy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole report for each run but every 23rd: what is right, each kind of
    mismatch, and malformed documents."""
    runs = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("bigint").alias("s")).where("k % 23 <> 0")
    acts = [F.when(F.expr(cond), _activity_text(text)) for cond, text in REPORT_ACTIVITIES]
    doc = F.concat(F.lit('{"value":['), F.concat_ws(",", *acts), F.lit("]}"))
    bad = None
    for mod, rest, text in BAD_REPORTS:
        cond = F.col("k") % mod == rest
        value = F.lit(text).cast("string")
        bad = F.when(cond, value) if bad is None else bad.when(cond, value)
    return runs.select(F.col("k").alias("run_id"), bad.otherwise(doc).alias("doc"))


@_once
def ctl_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("file_id"),
        F.when(eid % 25 == 0, "H|short")
        .otherwise(
            F.concat_ws(
                "|", F.lit("H"), F.col("event_type"), F.col("user_id").cast("string"),
                F.lit("a"), F.lit("b"),
                F.when(eid % 30 == 1, "n/a").otherwise(eid.cast("string")),
            )
        )
        .alias("line"),
    )


@_once
def dt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    d = _date_text(F.col("o_orderdate"))
    return o.select(
        ok.alias("k"),
        F.when(ok % 5 == 0, d)
        .when(ok % 5 == 1, F.replace(d, F.lit("-"), F.lit("")))
        .when(ok % 5 == 2, "1999-02-30")
        .when(ok % 5 == 3, "20011301")
        .otherwise("1998-3-7")
        .alias("bsns_dt"),
    )


# ---------------------------------------------------------------------------
# The same tables as portable SQL, for the DuckDB oracle.

_PREFIX_SQL = (
    "case {k} % 4 when 0 then 'pi' when 1 then 'pt' when 2 then 'po' else 'px' end"
)

SQL = {
    "job_log": f"""
select o_orderkey as log_no,
       concat({_PREFIX_SQL.format(k='o_custkey')}, '_', cast(o_custkey as string)) as job_nm,
       cast(cast(o_orderdate as date) as string) as dl_data_dt,
       case when o_orderkey % 3 = 0 then 'MONO_A' else 'MONO_B' end as monoline,
       case when o_orderkey % 50 = 0 then null
            when o_orderstatus = 'F' then 'SUCCESS'
            when o_orderstatus = 'O' then 'RUNNING'
            else 'TRIGGER-RUNNING' end as job_sts,
       o_orderpriority as rmrk
from orders""",
    "job_config": "\nunion all\n".join(f"""
select concat({_PREFIX_SQL.format(k='c_custkey')}, '_', cast(c_custkey as string)) as job_nm,
       case when c_custkey % 15 = 0 then null else c_mktsegment end as trgt_tbl_nm,
       case c_custkey % 10 when 7 then 'N' when 8 then 'y' when 9 then null else 'Y' end as actv_flag,
       case when c_custkey % 8 = 2 then 'cosmos_db' else 'file' end as expt_data_type,
       case when c_custkey % 16 = 10 then 'not json'
            when c_custkey % 80 = 2 then '{{''trgt_container_nm'':''quoted''}}'
            when c_custkey % 80 = 18 then '{{"trgt_container_nm": null}}'
            when c_custkey % 80 = 34 then concat('{{"trgt_container_nm":"two', chr(10), 'lines"}}')
            when c_custkey % 160 = 50 then '{{"container":"other"}}'
            when c_custkey % 8 = 2 then concat('{{"trgt_container_nm":"cont_', cast(c_custkey as string), '"}}')
            else null end as expt_file_ppty,
       case when c_custkey % 12 = 6 then null
            else concat('OUT_', cast(c_custkey as string), '.csv') end as expt_file_nm_fmt,
       case c_custkey % 4 when 0 then '/mnt/in/' when 1 then concat('C:', chr(92), 'in', chr(92))
                          when 2 then '/mnt/in' else null end as src_path,
       case c_custkey % 6 when 0 then 'WEEKEND' when 1 then 'holiday' when 2 then 'NULL'
                          when 3 then '' else 'HOLIDAY' end as hldy_type,
       concat(case c_custkey % 5 when 0 then 'CardX' when 1 then 'card2' when 2 then 'AUTOX'
                                 when 3 then 'dl' else 'misc' end, '_db') as db_nm
from customer{where}""" for where in ("", "\nwhere c_custkey % 100 = 0")),
    "allowed_values": """
select 'expt_file_nm_fmt' as column_name, concat('OUT_', cast(c_custkey as string), '.CSV') as allowed_value
from customer where c_custkey % 3 <> 0
union all select 'expt_file_nm_fmt', concat('OUT_', cast(c_custkey as string), '.csv') from customer where c_custkey % 6 = 1
union all select distinct 'trgt_tbl_nm', c_mktsegment from customer where c_mktsegment <> 'BUILDING'
union all select * from (values ('hldy_type', 'WEEKEND'), ('hldy_type', 'HOLIDAY'), ('other', 'x'), ('hldy_type', null)) t""",
    "area_doc": "select c_custkey as k, case " + " ".join(
        f"when c_custkey % {m} = {r} then "
        + ("null" if t is None else "replace('" + t.replace("'", "''") + "', '{k}', cast(c_custkey as string))")
        for m, r, t in AREA_DOCS) + " end as doc from customer",
    "hldy": """
select distinct cast(cast(o_orderdate as date) as string) as dt_en
from orders where o_orderkey % 40 = 0""",
    "run_date": """
select log_no, case when log_no % 41 = 0 then '1998-02-30' when log_no % 43 = 0 then '' when log_no % 47 = 0 then null
                    when log_no % 53 = 0 then 'someday' else dl_data_dt end as dl_data_dt
from job_log""",
    "manifest_sent": """
select o_custkey as batch_id,
       concat('f_', cast(o_orderkey as string), '.dat') as file_nm,
       cast(floor(o_totalprice) as bigint) as file_size
from orders""",
    "manifest_recv": """
select o_custkey as batch_id,
       concat(case when o_orderkey % 77 = 0 then 'x_' else 'f_' end, cast(o_orderkey as string), '.dat') as file_nm,
       cast(floor(o_totalprice) as bigint) + case when o_orderkey % 33 = 0 then 1 else 0 end as file_size
from orders where o_orderkey % 20 <> 0""",
    "ctl_listing": """
select o_orderkey as run_id, concat('c_', cast(o_orderkey as string), '.ctl') as file_nm,
       cast(64 as bigint) as file_size
from orders where o_orderkey % 4 = 1""",
    "activity_run": """
select l_orderkey as run_id, l_linenumber as activity_seq, l_partkey as activity_id,
       case when l_returnflag = 'N' then
         concat('{"activityType":"GetMetadata","activityName":"Get File","output":{"itemName":"f_',
                cast(l_orderkey as string), '.dat","size":', cast(cast(floor(l_extendedprice) as bigint) as string), '}}')
       when l_partkey % 40 = 0 then '{"activityType":"Copy","activityName":"Copy File"}'
       else
         concat('{"activityType":"Copy","activityName":"Copy File","output":{"filesRead":',
                cast(cast(l_quantity as bigint) as string), ',"filesWritten":',
                cast(cast(l_quantity as bigint) - case when l_partkey % 50 = 1 then 1 else 0 end as string),
                ',"dataRead":', cast(cast(floor(l_extendedprice) as bigint) as string), ',"dataWritten":',
                cast(cast(floor(l_extendedprice) as bigint) - case when l_partkey % 50 = 2 then 1 else 0 end as string),
                '}}') end as doc
from lineitem""",
    "activity_report": """
select run_id, concat('{"runId":"r","value":[', string_agg(doc, ',' order by activity_seq, activity_id), ']}') as doc
from activity_run group by run_id""",
    "copy_report": "select k as run_id, case "
    + " ".join(f"when k % {m} = {r} then " + ("null" if t is None else "'" + t.replace("'", "''") + "'")
               for m, r, t in BAD_REPORTS)
    + """ else concat('{"value":[', concat_ws(',', """
    + ", ".join(f"case when {c} then replace(replace('{t}', '{{k}}', cast(k as string)), "
                f"'{{s}}', cast(s as string)) end" for c, t in REPORT_ACTIVITIES)
    + """), ']}') end as doc
from (select o_orderkey as k, cast(floor(o_totalprice) as bigint) as s from orders) o where k % 23 <> 0""",
    "ctl_line": """
select event_id as file_id,
       case when event_id % 25 = 0 then 'H|short'
            else concat_ws('|', 'H', event_type, cast(user_id as string), 'a', 'b',
                           case when event_id % 30 = 1 then 'n/a' else cast(event_id as string) end) end as line
from events""",
    "dt_text": """
select o_orderkey as k,
       case o_orderkey % 5
         when 0 then cast(cast(o_orderdate as date) as string)
         when 1 then replace(cast(cast(o_orderdate as date) as string), '-', '')
         when 2 then '1999-02-30'
         when 3 then '20011301'
         else '1998-3-7' end as bsns_dt
from orders""",
}

BUILDERS = {
    "job_log": job_log,
    "job_config": job_config,
    "allowed_values": allowed_values,
    "area_doc": area_doc,
    "hldy": hldy,
    "run_date": run_date,
    "manifest_sent": manifest_sent,
    "manifest_recv": manifest_recv,
    "ctl_listing": ctl_listing,
    "activity_run": activity_run,
    "activity_report": activity_report,
    "copy_report": copy_report,
    "ctl_line": ctl_line,
    "dt_text": dt_text,
}


def with_fixtures(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix an oracle query with the fixture CTEs it names, then ``extra``
    CTEs (name -> SQL) that may use them."""
    parts = [(n, SQL[n]) for n in names] + list((extra or {}).items())
    ctes = ",\n".join(f"{n} as ({sql}\n)" for n, sql in parts)
    return f"with {ctes}\n{body}"
