"""The query catalogue: one Spark query per operator, each
reading the driver's tables at ``sf_dir`` (through the fixtures), and the
equivalent DuckDB SQL.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions import columns as X
from runledger.functions.crypto import (
    create_key_ring, decrypt_columns, decrypt_with_ring, encrypt_columns, encrypt_with_ring, rewrap_columns,
    rotate_key_ring,
)
from runledger.session import cut_lineage
from runledger.operators import calendar, config, ledger, markers, quality, reconcile
from runledger.plans import fixtures as fx
from runledger.sources.config_json import (
    AREA_SCHEMA, checked_documents, flatten_area_text, flatten_dependency_text, register_view,
)
from runledger.sources.control_files import ControlSpec, control_counts_of_lines
from runledger.sources.tables import column_names, read_table, scan
from runledger.streaming import ledger_stream as ls

W = fx.with_fixtures

# Parameters of the catalogue queries (the original took them from an
# environment notebook; here they are plain arguments).
TENANT = "mono_a"
NEW_TENANT = "mono_c"
MARKER_ROOT = "/shared"
MARKER_TS = "20261201_000000"
MAX_MISMATCH = 1
META_ACTIVITY = "Get File"
ARCHIVE_LOCATION = "/arch"
ARCHIVE_PREFIX = "EXPT"
REQUIRED_COLUMNS = ["trgt_tbl_nm", "expt_file_nm_fmt", "src_path", "hldy_type"]
FLAG_COLUMNS = ["actv_flag", "hldy_type"]
PATH_COLUMNS = ["src_path"]
ALLOWED = {"hldy_type": ["WEEKEND", "HOLIDAY"], "expt_data_type": ["FILE", "COSMOS_DB"]}

Q: dict = {}
SQL: dict[str, str] = {}


def query(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


# ===================================================================== A1
@query("active_config_status")
def q_active_config_status(spark: SparkSession, sf: str) -> DataFrame:
    return config.active_config_status(fx.job_config(spark, sf))


_STATUS_SQL = """case when {a}=0 and {i}=0 then 'NOT_FOUND' when {a}=0 then 'INACTIVE_ONLY'
     when {a}>1 then 'DUPLICATE_ACTIVE' else 'OK' end"""
_MESSAGE_SQL = f"""case {{s}} when 'NOT_FOUND' then '{config.MSG_NOT_FOUND}'
     when 'INACTIVE_ONLY' then '{config.MSG_INACTIVE_ONLY}'
     when 'DUPLICATE_ACTIVE' then '{config.MSG_DUPLICATE}' end"""

SQL["active_config_status"] = W(f"""
select job_nm, n_active, n_inactive, n_rows,
       {_STATUS_SQL.format(a='n_active', i='n_inactive')} as status,
       {_MESSAGE_SQL.format(s=_STATUS_SQL.format(a='n_active', i='n_inactive'))} as message
from (select job_nm,
             count(*) filter (where upper(actv_flag) = 'Y') as n_active,
             count(*) filter (where upper(actv_flag) = 'N') as n_inactive,
             count(*) as n_rows
      from job_config group by job_nm) t""", "job_config")


@query("area_config_status")
def q_area_config_status(spark, sf):
    cfg = fx.job_config(spark, sf).where(F.col("trgt_tbl_nm").isNotNull())
    return config.area_config_status(cfg, fx.job_log(spark, sf))


SQL["area_config_status"] = W(f"""
select j.job_nm, coalesce(c.n_rows, 0) as n_rows,
       case when coalesce(c.n_rows, 0) = 0 then 'NOT_FOUND' else 'OK' end as status,
       case when coalesce(c.n_rows, 0) = 0 then '{config.MSG_NOT_FOUND}' end as message
from (select distinct job_nm from job_log) j
left join (select job_nm, count(*) as n_rows from job_config
           where trgt_tbl_nm is not null group by job_nm) c on j.job_nm = c.job_nm""",
    "job_log", "job_config")


# ===================================================================== A2-A4
@query("duplicate_runs")
def q_duplicate_runs(spark, sf):
    return ledger.duplicate_runs(fx.job_log(spark, sf), ["job_nm"])


SQL["duplicate_runs"] = W("""
select job_nm, count(*) filter (where job_sts = 'RUNNING') as n_matching,
       count(*) filter (where job_sts = 'RUNNING') > 0 as is_duplicate
from job_log group by job_nm""", "job_log")


@query("trigger_run_status")
def q_trigger_run_status(spark, sf):
    return ledger.trigger_run_status(fx.job_log(spark, sf), ["job_nm"])


SQL["trigger_run_status"] = W("""
select job_nm, n_trigger, n_other, n_trigger = 1 and n_other = 0 as is_ok
from (select job_nm,
             count(*) filter (where job_sts = 'TRIGGER-RUNNING') as n_trigger,
             count(*) filter (where job_sts <> 'TRIGGER-RUNNING') as n_other
      from job_log group by job_nm) t""", "job_log")


@query("duplicate_updates")
def q_duplicate_updates(spark, sf):
    return ledger.duplicate_updates(fx.job_log(spark, sf), ["monoline", "job_nm", "dl_data_dt"])


SQL["duplicate_updates"] = W("""
select monoline, job_nm, dl_data_dt, count(*) as n_rows
from job_log group by monoline, job_nm, dl_data_dt having count(*) > 1""", "job_log")


# ===================================================================== V1-V5
@query("required_violations")
def q_required_violations(spark, sf):
    return quality.required_violations(fx.job_config(spark, sf), REQUIRED_COLUMNS)


SQL["required_violations"] = W(
    "select column_name, n_rows from (\n"
    + "\nunion all\n".join(
        f"select '{c}' as column_name, count(*) filter (where {c} is null or {c} = '' "
        f"or upper({c}) = 'NULL') as n_rows from job_config"
        for c in REQUIRED_COLUMNS)
    + "\n) t where n_rows > 0", "job_config")


def _report_sql(checks: list[tuple[str, str]]) -> str:
    parts = [
        f"select '{c}' as column_name, cast({c} as string) as bad_value, {reason} as reason "
        f"from job_config" for c, reason in checks
    ]
    return (
        "select column_name, bad_value, reason, count(*) as n_rows from (\n"
        + "\nunion all\n".join(parts)
        + "\n) t where reason is not null group by column_name, bad_value, reason"
    )


@query("flag_violations")
def q_flag_violations(spark, sf):
    return quality.flag_violations(fx.job_config(spark, sf), FLAG_COLUMNS)


SQL["flag_violations"] = W(_report_sql([
    (c, f"""case when {c} is null or {c} = '' then null
          when upper({c}) not in ('Y', 'N') then '{quality.REASON_YN}'
          when {c} not in ('Y', 'N') then '{quality.REASON_UPPER}' end""")
    for c in FLAG_COLUMNS]), "job_config")


@query("path_violations")
def q_path_violations(spark, sf):
    return quality.path_violations(fx.job_config(spark, sf), PATH_COLUMNS)


SQL["path_violations"] = W(_report_sql([
    (c, f"""case when {c} is not null and {c} <> '' and right({c}, 1) not in ('/', chr(92))
          then 'format should end with / or ' || chr(92) end""")
    for c in PATH_COLUMNS]), "job_config")


@query("value_violations")
def q_value_violations(spark, sf):
    return quality.value_violations(fx.job_config(spark, sf), ALLOWED)


def _in_list(vals):
    return ", ".join(f"'{v}'" for v in vals)


SQL["value_violations"] = W(_report_sql([
    (c, f"""case when not coalesce(upper({c}) in ({_in_list(v)}), false) then '{quality.REASON_NOT_IN_LIST}'
          when {c} not in ({_in_list(v)}) then '{quality.REASON_UPPER}' end""")
    for c, v in ALLOWED.items()]), "job_config")


ALLOWED_COLUMNS = ["hldy_type", "trgt_tbl_nm", "expt_file_nm_fmt"]


@query("value_violations_table")
def q_value_violations_table(spark, sf):
    return quality.value_violations_from(fx.job_config(spark, sf), ALLOWED_COLUMNS, fx.allowed_values(spark, sf))


# A list holds the value upper-cased or not at all; one of them may also hold it as it is.
SQL["value_violations_table"] = W(f"""
select column_name, bad_value, reason, count(*) as n_rows from (
  select column_name, bad_value,
    case when not exists (select 1 from allowed_values a where a.column_name = v.column_name
                          and a.allowed_value = upper(v.bad_value)) then '{quality.REASON_NOT_IN_LIST}'
         when not exists (select 1 from allowed_values a where a.column_name = v.column_name
                          and a.allowed_value = v.bad_value) then '{quality.REASON_UPPER}' end as reason
  from ({' union all '.join(f"select '{c}' as column_name, {c} as bad_value from job_config" for c in ALLOWED_COLUMNS)}) v
) r where reason is not null group by all""", "job_config", "allowed_values")


@query("business_dates")
def q_business_dates(spark, sf):
    return quality.business_dates(fx.dt_text(spark, sf), "bsns_dt", key=["k"])


SQL["business_dates"] = W("""
select k, bsns_dt, d as bsns_date, d is not null as is_valid
from (select k, bsns_dt,
             case when contains(bsns_dt, '-') then try_strptime(bsns_dt, '%Y-%m-%d')::date
                  when regexp_matches(bsns_dt, '^[0-9]{8}$') then try_strptime(bsns_dt, '%Y%m%d')::date
             end as d
      from dt_text) t""", "dt_text")


# ===================================================================== J2, V6, X1
@query("holiday_flags")
def q_holiday_flags(spark, sf):
    return calendar.holiday_flags(
        fx.run_date(spark, sf), "dl_data_dt", fx.hldy(spark, sf),
        {"is_hldy_weekend": F.lit(calendar.TYPE_WEEKEND),
         "is_hldy_holiday": F.lit(calendar.TYPE_HOLIDAY)})


SQL["holiday_flags"] = W("""
select l.log_no, l.dl_data_dt, d is not null as is_date, dayname(d) as wkdy_nm,
       case when isodow(d) >= 6 then true end as is_hldy_weekend,
       case when isodow(d) >= 6 or h.dt_en is not null then true end as is_hldy_holiday
from (select log_no, dl_data_dt, try_cast(dl_data_dt as date) as d from run_date) l
left join (select distinct dt_en from hldy) h on l.dl_data_dt = h.dt_en""",
    "job_log", "run_date", "hldy")


# ===================================================================== R1, J1, R2, J6
def _configs(spark, sf):
    cfg = fx.job_config(spark, sf)
    return {"pi": cfg, "pt": cfg, "po": cfg}


@query("route_jobs")
def q_route_jobs(spark, sf):
    return config.route_jobs(fx.job_log(spark, sf), _configs(spark, sf))


_ACTIVE = "upper(actv_flag) = 'Y'"
ROUTE_SQL = f"""
select job_nm,
  case when kind = 'pi' then 'ingt' when kind = 'pt' then 'curated'
       when kind = 'po' then case when status = 'OK' and po_title is not null then 'outbnd' else 'skip' end
       else '' end as zone,
  case when kind in ('pi', 'pt') and status = 'OK' then coalesce(trgt_tbl_nm, '')
       when kind = 'po' and status = 'OK' and po_title is not null then po_title
       else '' end as title_nm,
  case when kind in ('pi', 'pt') and status <> 'OK' then {_MESSAGE_SQL.format(s='status')} end as route_error
from (
  select j.job_nm, j.kind,
         {_STATUS_SQL.format(a='coalesce(c.n_active, 0)', i='coalesce(c.n_inactive, 0)')} as status,
         c.trgt_tbl_nm,
         case when c.expt_data_type = 'cosmos_db'
              then case when json_valid(c.expt_file_ppty)
                        then case when json_exists(c.expt_file_ppty, '$.trgt_container_nm')
                                  then coalesce(json_extract_string(c.expt_file_ppty, '$.trgt_container_nm'), '') end end
              else coalesce(c.expt_file_nm_fmt, '') end as po_title
  from (select distinct job_nm, substr(job_nm, 1, 2) as kind from job_log) j
  left join (
    select job_nm,
           count(*) filter (where {_ACTIVE}) as n_active,
           count(*) filter (where upper(actv_flag) = 'N') as n_inactive,
           max(case when {_ACTIVE} then trgt_tbl_nm end) as trgt_tbl_nm,
           max(case when {_ACTIVE} then expt_data_type end) as expt_data_type,
           max(case when {_ACTIVE} then expt_file_ppty end) as expt_file_ppty,
           max(case when {_ACTIVE} then expt_file_nm_fmt end) as expt_file_nm_fmt
    from job_config group by job_nm) c
  on j.job_nm = c.job_nm and j.kind in ('pi', 'pt', 'po')
) r"""

SQL["route_jobs"] = W(ROUTE_SQL, "job_log", "job_config")


@query("workspace_route")
def q_workspace_route(spark, sf):
    cfg = fx.job_config(spark, sf)
    return cfg.select("job_nm", "db_nm", X.workspace("db_nm").alias("wrkspc"),
                      X.main_source_system("db_nm").alias("dl_main_src_sys"))


def _ws_sql(pick: int) -> str:
    whens = " ".join(f"when contains(lower(db_nm), '{r[0]}') then '{r[1 + pick]}'"
                     for r in X.WORKSPACE_RULES)
    return f"case {whens} else '{X.WORKSPACE_DEFAULT[pick]}' end"


SQL["workspace_route"] = W(f"""
select job_nm, db_nm, {_ws_sql(0)} as wrkspc, {_ws_sql(1)} as dl_main_src_sys
from job_config""", "job_config")


@query("jobs_registered")
def q_jobs_registered(spark, sf):
    reg = fx.job_config(spark, sf).where(F.col("actv_flag") == "Y")
    return config.jobs_registered(fx.job_log(spark, sf), reg)


SQL["jobs_registered"] = W("""
select j.job_nm,
       exists (select 1 from job_config c where c.actv_flag = 'Y' and c.job_nm = j.job_nm)
         as is_registered
from (select distinct job_nm from job_log) j""", "job_log", "job_config")


# ===================================================================== J3, A7
@query("manifest_compare")
def q_manifest_compare(spark, sf):
    return reconcile.compare_listings(fx.manifest_sent(spark, sf), fx.manifest_recv(spark, sf),
                                      ["batch_id", "file_nm"])


def _compare_sql(src: str, tgt: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " and ".join(f"s.{c} = t.{c}" for c in keys)
    sel = ", ".join(f"coalesce(s.{c}, t.{c}) as {c}" for c in keys)
    return f"""
select {sel}, coalesce(s.n_src, 0) as n_src, coalesce(t.n_tgt, 0) as n_tgt, s.src_size, t.tgt_size,
  case when s.n_src is null then '{reconcile.MISSING_IN_SOURCE}'
       when t.n_tgt is null then '{reconcile.MISSING_IN_TARGET}'
       when s.src_size <> s.src_min or t.tgt_size <> t.tgt_min or s.n_src <> t.n_tgt then '{reconcile.DUPLICATE}'
       when s.src_size = t.tgt_size then '{reconcile.MATCH}'
       else '{reconcile.SIZE_MISMATCH}' end as status
from (select {k}, count(*) as n_src, max(file_size) as src_size, min(file_size) as src_min
      from {src} group by {k}) s
full outer join
     (select {k}, count(*) as n_tgt, max(file_size) as tgt_size, min(file_size) as tgt_min
      from {tgt} group by {k}) t
on {on}"""


SQL["manifest_compare"] = W(_compare_sql("manifest_sent", "manifest_recv", ["batch_id", "file_nm"]),
                            "manifest_sent", "manifest_recv")


@query("manifest_totals")
def q_manifest_totals(spark, sf):
    s = reconcile.per_file(fx.manifest_sent(spark, sf), ["batch_id"], tag="src")
    t = reconcile.per_file(fx.manifest_recv(spark, sf), ["batch_id"], tag="tgt")
    return reconcile.compare_totals(s, t, ["batch_id"], "src", "tgt")


def _totals_sql(left: str, right: str, lt: str, rt: str, key: str) -> str:
    cols = []
    for w in ("files", "bytes"):
        lc, rc = f"coalesce(l.{lt}_{w}, 0)", f"coalesce(r.{rt}_{w}, 0)"
        cols += [f"cast({lc} as bigint) as {lt}_{w}", f"cast({rc} as bigint) as {rt}_{w}",
                 f"{lc} = {rc} as {w}_match"]
    return f"""
select coalesce(l.{key}, r.{key}) as {key}, {', '.join(cols)}
from ({left}) l full outer join ({right}) r on l.{key} = r.{key}"""


SQL["manifest_totals"] = W(_totals_sql(
    "select batch_id, count(*) as src_files, cast(sum(file_size) as bigint) as src_bytes "
    "from manifest_sent group by batch_id",
    "select batch_id, count(*) as tgt_files, cast(sum(file_size) as bigint) as tgt_bytes "
    "from manifest_recv group by batch_id", "src", "tgt", "batch_id"),
    "manifest_sent", "manifest_recv")


# ===================================================================== A5, X6, L2
def _activity_order():
    # Line number and part key of the fixture's activities: both far below their bounds.
    return X.pack_order(("activity_seq", 20), ("activity_id", 42))


def _activities(spark, sf):
    return reconcile.parse_activities(fx.activity_run(spark, sf))


@query("activity_totals")
def q_activity_totals(spark, sf):
    return reconcile.copy_totals(_activities(spark, sf), ["run_id"], MAX_MISMATCH, with_data=True,
                                 order=_activity_order())


_ACT_SQL = """
select run_id, activity_seq, activity_id,
       json_extract_string(doc, '$.activityType') as t,
       json_extract_string(doc, '$.activityName') as nm,
       cast(json_extract_string(doc, '$.output.filesRead') as bigint) as fr,
       cast(json_extract_string(doc, '$.output.filesWritten') as bigint) as fw,
       cast(json_extract_string(doc, '$.output.dataRead') as bigint) as dr,
       cast(json_extract_string(doc, '$.output.dataWritten') as bigint) as dw,
       json_extract_string(doc, '$.output.itemName') as item,
       cast(json_extract_string(doc, '$.output.size') as bigint) as sz
from activity_run"""

_COPY_TOTALS_SQL = f"""
select run_id,
  count(*) filter (where t = 'Copy') as n_copy,
  cast(coalesce(sum(case when t = 'Copy' and fr is not null and fw is not null then fw end), 0) as bigint)
    as files_written,
  count(*) filter (where t = 'Copy' and not coalesce(fr = fw and dr = dw, false)) as n_bad,
  cast(coalesce(sum(case when t = 'Copy' and fr = fw and dr is not null then dw end), 0) as bigint)
    as bytes_written,
  arg_max(fw, struct_pack(s := activity_seq, i := activity_id, w := fw))
    filter (where t = 'Copy' and fr is not null and fw is not null) as last_files_written,
  count(*) filter (where t = 'Copy' and not coalesce(fr = fw and dr = dw, false)) > {MAX_MISMATCH}
    as failed
from ({_ACT_SQL}) a group by run_id"""

SQL["activity_totals"] = W(_COPY_TOTALS_SQL, "activity_run")


@query("report_totals")
def q_report_totals(spark, sf):
    """A5 over whole reports, one document per run: equal to the totals of the same
    activities in a document each."""
    acts = reconcile.parse_reports(fx.activity_report(spark, sf))
    return reconcile.copy_totals(acts, ["run_id"], MAX_MISMATCH, with_data=True, order="activity_seq")


SQL["report_totals"] = SQL["activity_totals"]


@query("report_activities")
def q_report_activities(spark, sf):
    """X6 over whole reports, malformed ones included: a row per activity in order."""
    return reconcile.parse_reports(fx.copy_report(spark, sf))


# A report is read if it is an object with a list of objects under "value"; an activity
# must have an activityType.
_REPORT_SQL = """
select run_id, activity_seq, is_malformed,
       json_extract_string(e, '$.activityType') as activity_type, json_extract_string(e, '$.activityName') as activity_name,
       try_cast(json_extract_string(e, '$.output.filesRead') as bigint) as files_read,
       try_cast(json_extract_string(e, '$.output.filesWritten') as bigint) as files_written,
       try_cast(json_extract_string(e, '$.output.dataRead') as bigint) as data_read,
       try_cast(json_extract_string(e, '$.output.dataWritten') as bigint) as data_written,
       json_extract_string(e, '$.output.itemName') as item_name,
       try_cast(json_extract_string(e, '$.output.size') as bigint) as item_size
from (
  select run_id, cast(null as bigint) as activity_seq, not ok as is_malformed, cast(null as json) as e
  from r where not ok or len(acts) = 0
  union all
  select run_id, i - 1, json_extract_string(acts[i], '$.activityType') is null, acts[i]
  from (select run_id, acts, unnest(range(1, len(acts) + 1)) as i from r where ok) u) x"""
_REPORTS_READ_SQL = """
select run_id, ok and len(list_filter(acts, lambda x: json_type(x) <> 'OBJECT')) = 0 as ok, acts
from (select run_id, ok, case when ok then json_extract(doc, '$.value[*]') else [] end as acts
      from (select run_id, doc, case when json_valid(doc) then json_type(doc) = 'OBJECT'
                                     and coalesce(json_type(doc, '$.value') = 'ARRAY', false) else false end as ok
            from copy_report) q) p"""
SQL["report_activities"] = W(_REPORT_SQL, "copy_report", extra={"r": _REPORTS_READ_SQL})


def _listed(spark, sf):
    """Data files and control files of the runs, as one listing."""
    cols = ["run_id", "file_nm", "file_size"]
    return reconcile.union_listings(_blob_by_run(spark, sf).select(*cols),
                                    fx.ctl_listing(spark, sf).select(*cols))


_LISTED_SQL = """
select cast(regexp_extract(file_nm, '^f_([0-9]+)\\.dat$', 1) as bigint) as run_id, file_nm, file_size
from manifest_sent
union all select run_id, file_nm, file_size from ctl_listing"""


@query("activity_file_compare")
def q_activity_file_compare(spark, sf):
    meta = reconcile.last_metadata(_activities(spark, sf), ["run_id"], META_ACTIVITY, _activity_order())
    report = meta.select("run_id", F.col("item_name").alias("file_nm"), F.col("item_size").alias("file_size"))
    return reconcile.compare_listings(report, _listed(spark, sf), ["run_id", "file_nm"])


SQL["activity_file_compare"] = W(_compare_sql("last_meta", "listed", ["run_id", "file_nm"]),
                                 "activity_run", "manifest_sent", "ctl_listing", extra={
    "listed": _LISTED_SQL,
    "a": _ACT_SQL,
    "last_meta": f"""
select run_id, item as file_nm,
       arg_max(sz, struct_pack(s := activity_seq, i := activity_id, z := sz)) as file_size
from a where t = 'GetMetadata' and nm = '{META_ACTIVITY}' and item is not null
group by run_id, item"""})


def _blob_by_run(spark, sf):
    m = fx.manifest_sent(spark, sf)
    run = F.regexp_extract("file_nm", r"^f_([0-9]+)\.dat$", 1).cast("bigint")
    return m.withColumn("run_id", run)


@query("activity_total_compare")
def q_activity_total_compare(spark, sf):
    report = reconcile.copy_totals(_activities(spark, sf), ["run_id"], MAX_MISMATCH).select(
        "run_id", F.col("files_written").alias("report_files"), F.col("bytes_written").alias("report_bytes"))
    blob = reconcile.per_file(_blob_by_run(spark, sf), ["run_id"], tag="blob")
    return reconcile.compare_totals(report, blob, ["run_id"], "report", "blob")


SQL["activity_total_compare"] = W(_totals_sql(
    f"select run_id, files_written as report_files, bytes_written as report_bytes from ({_COPY_TOTALS_SQL}) x",
    "select cast(regexp_extract(file_nm, '^f_([0-9]+)\\.dat$', 1) as bigint) as run_id, "
    "count(*) as blob_files, cast(sum(file_size) as bigint) as blob_bytes from manifest_sent group by 1",
    "report", "blob", "run_id"), "activity_run", "manifest_sent")


# ===================================================================== S6
@query("control_counts")
def q_control_counts(spark, sf):
    return control_counts_of_lines(fx.ctl_line(spark, sf), "line", ControlSpec(), keep=["file_id"])


SQL["control_counts"] = W("""
select file_id, nullif(f, '') as ctl_field,
       case when regexp_matches(f, '^\\s*[+-]?[0-9]+\\s*$') then cast(trim(f) as bigint) end as ctl_count,
       regexp_matches(f, '^\\s*[+-]?[0-9]+\\s*$') as is_valid
from (select file_id, split_part(line, '|', 6) as f from ctl_line) t""", "ctl_line")


# ===================================================================== U1
@query("unique_documents")
def q_unique_documents(spark, sf):
    return ledger.unique_rows(read_table(spark, sf, "documents").select("text", "lang"))


SQL["unique_documents"] = "select distinct text, lang from documents"


# ===================================================================== D1-D9
def _new_runs(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(
        (F.col("event_id") + 1_000_000_000).alias("log_no"),
        F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string")).alias("job_nm"),
        F.col("ts").cast("date").cast("string").alias("dl_data_dt"),
        F.lit(ledger.STS_RUNNING).alias("job_sts"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("rmrk"),
    )


@query("ledger_append")
def q_ledger_append(spark, sf):
    return ledger.append_rows(fx.job_log(spark, sf), _new_runs(spark, sf),
                              ledger.tenant_defaults(NEW_TENANT))


SQL["ledger_append"] = W(f"""
select log_no, job_nm, dl_data_dt, monoline, job_sts, rmrk from job_log
union all
select event_id + 1000000000 as log_no, concat(event_type, '_', cast(user_id as string)) as job_nm,
       cast(cast(ts as date) as string) as dl_data_dt, upper('{NEW_TENANT}') as monoline,
       'RUNNING' as job_sts,
       nullif(case when event_id % 3 = 0 then '' else event_type end, '') as rmrk
from events""", "job_log")

_UPDATE_PRED = "job_sts = 'RUNNING' and dl_data_dt < '1998-01-01'"
_UPDATE_RMRK = "CASE WHEN rmrk LIKE '1%' THEN 'URGENT' ELSE rmrk END"


@query("ledger_update")
def q_ledger_update(spark, sf):
    return ledger.update_rows(
        fx.job_log(spark, sf), F.expr(_UPDATE_PRED),
        {"job_sts": ledger.STS_SUCCESS, "rmrk": F.expr(_UPDATE_RMRK), "dl_data_dt": ""},
        tenant=TENANT)


_HIT = f"coalesce({_UPDATE_PRED} and monoline = upper('{TENANT}'), false)"
SQL["ledger_update"] = W(f"""
select log_no, job_nm, dl_data_dt, monoline,
       case when {_HIT} then 'SUCCESS' else job_sts end as job_sts,
       case when {_HIT} then ({_UPDATE_RMRK}) else rmrk end as rmrk
from job_log""", "job_log")


_UPDATE_ON, _UPDATE_SET = ["job_nm", "dl_data_dt"], ["job_sts", "rmrk"]


def _updates(spark, sf):
    """Updates of every second run, a second one that differs for some, a second one
    that agrees for others, and keys without a run."""
    k = F.col("log_no")
    one = fx.job_log(spark, sf).where(k % 2 == 0).select(
        "log_no", "job_nm", "dl_data_dt", F.when(k % 5 == 0, "").otherwise("FAILED").alias("job_sts"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("seen "), "rmrk")).alias("rmrk"))
    other = one.where(k % 11 == 0).withColumn("job_sts", F.lit("SUCCESS"))
    same = one.where(k % 13 == 0)
    lost = one.where(k % 17 == 0).withColumn("job_nm", F.when(k % 2 == 0, F.concat(F.lit("zz_"), "job_nm")))
    return one.unionByName(other).unionByName(same).unionByName(lost).drop("log_no")


def _keyed(spark, sf):
    return ledger.keyed_updates(fx.job_log(spark, sf), _updates(spark, sf), _UPDATE_ON, _UPDATE_SET, TENANT)


@query("ledger_update_report")
def q_ledger_update_report(spark, sf):
    return _keyed(spark, sf)


_UPDATES_SQL = """
select log_no, job_nm, dl_data_dt, case when log_no % 5 <> 0 then 'FAILED' else '' end as job_sts,
       case when log_no % 7 <> 0 then concat('seen ', rmrk) end as rmrk
from job_log where log_no % 2 = 0"""
_KEYED_CTES = {
    "one": _UPDATES_SQL,
    "u": """
select job_nm, dl_data_dt, nullif(job_sts, '') as job_sts, nullif(rmrk, '') as rmrk from (
  select * from one union all select log_no, job_nm, dl_data_dt, 'SUCCESS', rmrk from one where log_no % 11 = 0
  union all select * from one where log_no % 13 = 0
  union all select log_no, case when log_no % 2 = 0 then concat('zz_', job_nm) end, dl_data_dt, job_sts, rmrk
  from one where log_no % 17 = 0) x""",
    "keyed": f"""
select u.job_nm, u.dl_data_dt, count(*) as n_updates, max(coalesce(l.n, 0))::bigint as n_rows,
       case when max(l.n) is null then 'NOT_FOUND'
            when count(distinct job_sts) > 1 or count(distinct rmrk) > 1 then 'CONFLICTING_UPDATES'
            when max(l.n) > 1 then 'DUPLICATE_ROWS' else 'OK' end as status,
       max(job_sts) as job_sts, max(rmrk) as rmrk
from u left join (select job_nm, dl_data_dt, count(*) as n from job_log where monoline = upper('{TENANT}')
                  group by job_nm, dl_data_dt) l on l.job_nm = u.job_nm and l.dl_data_dt = u.dl_data_dt
group by u.job_nm, u.dl_data_dt"""}

SQL["ledger_update_report"] = W("select * from keyed", "job_log", extra=_KEYED_CTES)


@query("ledger_bulk_update")
def q_ledger_bulk_update(spark, sf):
    return ledger.apply_updates(fx.job_log(spark, sf), _keyed(spark, sf), _UPDATE_ON, _UPDATE_SET, TENANT)


SQL["ledger_bulk_update"] = W(f"""
select l.log_no, l.job_nm, l.dl_data_dt, l.monoline,
       case when l.monoline = upper('{TENANT}') then coalesce(k.job_sts, l.job_sts) else l.job_sts end as job_sts,
       case when l.monoline = upper('{TENANT}') then coalesce(k.rmrk, l.rmrk) else l.rmrk end as rmrk
from job_log l left join keyed k on k.job_nm = l.job_nm and k.dl_data_dt = l.dl_data_dt and k.status = 'OK'""",
    "job_log", extra=_KEYED_CTES)


@query("ledger_delete")
def q_ledger_delete(spark, sf):
    log = ledger.delete_where(fx.job_log(spark, sf), F.col("job_sts") == ledger.STS_TRIGGER_RUNNING)
    inactive = fx.job_config(spark, sf).where(F.upper("actv_flag") == "N")
    return ledger.delete_keys(log, inactive, ["job_nm"])


SQL["ledger_delete"] = W("""
select * from job_log l
where not coalesce(job_sts = 'TRIGGER-RUNNING', false)
  and not exists (select 1 from job_config c where upper(c.actv_flag) = 'N' and c.job_nm = l.job_nm)""",
    "job_log", "job_config")


# ===================================================================== D10-D13, X9
def _routed_log(spark, sf):
    return config.attach_routes(fx.job_log(spark, sf), _configs(spark, sf))


def _markers(routed):
    return markers.success_markers(routed, MARKER_ROOT, F.lit(MARKER_TS), F.col("monoline"))


@query("success_markers")
def q_success_markers(spark, sf):
    return _markers(_routed_log(spark, sf))


_D8 = "replace(l.dl_data_dt, '-', '')"
_MARKER_NAME = f"concat(lower(r.title_nm), '.', l.job_nm, '.', {_D8}, '.', '{MARKER_TS}', '.success')"
_MARKERS_SQL = f"""
select l.monoline as tenant, l.job_nm, l.dl_data_dt, r.zone, {_D8} as folder_dt, {_MARKER_NAME} as file_nm,
       concat('{MARKER_ROOT}/', l.monoline, '/evtg/', r.zone, '/', {_D8}, '/', {_MARKER_NAME}) as marker_path
from job_log l join route r on l.job_nm = r.job_nm
where l.job_sts = 'SUCCESS' and r.zone <> '' and r.zone <> 'skip' and r.title_nm <> ''"""

SQL["success_markers"] = W(_MARKERS_SQL, "job_log", "job_config", extra={"route": ROUTE_SQL})


@query("stale_markers")
def q_stale_markers(spark, sf):
    routed = _routed_log(spark, sf)
    existing = _markers(routed).select("tenant", "zone", "folder_dt", "file_nm").distinct()
    new_runs = routed.where(~F.col("job_sts").eqNullSafe(ledger.STS_SUCCESS))
    return markers.stale_markers(existing, markers.invalidation_keys(new_runs, F.col("monoline")))


SQL["stale_markers"] = W("""
select tenant, zone, folder_dt, file_nm from m
where exists (select 1 from k where k.tenant = m.tenant and k.zone = m.zone and k.folder_dt = m.folder_dt
                                and contains(m.file_nm, k.mkey))""", "job_log", "job_config", extra={
    "route": ROUTE_SQL,
    "m": f"select distinct tenant, zone, folder_dt, file_nm from ({_MARKERS_SQL}) x",
    "k": """
select distinct n.monoline as tenant, r.zone, replace(n.dl_data_dt, '-', '') as folder_dt,
       concat(lower(r.title_nm), '.', n.job_nm, '.', replace(n.dl_data_dt, '-', '')) as mkey
from job_log n join route r on n.job_nm = r.job_nm
where n.job_sts is distinct from 'SUCCESS'
  and r.zone <> '' and r.zone <> 'skip' and r.route_error is null"""})


# ===================================================================== X10
def _predicate_text():
    quoted = F.concat(F.lit("WHERE job_nm ='"), F.col("job_nm"), F.lit("' AND dl_data_dt ='"),
                      F.col("dl_data_dt"), F.lit("'"))
    spaced = F.concat(F.lit("WHERE job_nm = '"), F.col("job_nm"), F.lit("' AND dl_data_dt ='"),
                      F.col("dl_data_dt"), F.lit("'"))
    return F.when(F.col("job_sts").isNull(), spaced).otherwise(quoted)


@query("predicate_keys")
def q_predicate_keys(spark, sf):
    t = fx.job_log(spark, sf).select("log_no", _predicate_text().alias("pred_text"))
    return t.select("log_no", "pred_text",
                    X.predicate_value("pred_text", "job_nm").alias("job_nm_ext"),
                    X.predicate_value("pred_text", "dl_data_dt").alias("dl_data_dt_ext"))


SQL["predicate_keys"] = W("""
select log_no, pred_text,
       nullif(regexp_extract(pred_text, 'job_nm =''(.*?)''', 1), '') as job_nm_ext,
       nullif(regexp_extract(pred_text, 'dl_data_dt =''(.*?)''', 1), '') as dl_data_dt_ext
from (select log_no,
             case when job_sts is null
                  then concat('WHERE job_nm = ''', job_nm, ''' AND dl_data_dt =''', dl_data_dt, '''')
                  else concat('WHERE job_nm =''', job_nm, ''' AND dl_data_dt =''', dl_data_dt, '''')
             end as pred_text
      from job_log) t""", "job_log")


# ===================================================================== X2-X5
@query("log_lines")
def q_log_lines(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(
        "event_id",
        X.time_text("ts", "date").alias("ts_date"),
        X.time_text("ts", "datetime").alias("ts_datetime"),
        X.time_text("ts", "datetimelog").alias("ts_log"),
        X.time_text("ts", "other").alias("ts_other"),
        X.log_line("INFO", F.concat(F.col("event_type"), F.lit(" by "),
                                    X.none_to_empty(F.col("user_id"))), "ts").alias("line"),
        X.info_lines([("event_type", F.col("event_type")),
                      ("user", F.when(F.col("event_type") == "view", "").otherwise(
                          F.col("user_id").cast("string")))], "ts").alias("info"),
    )


_TS_SQL = "left(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 23)"
SQL["log_lines"] = f"""
select event_id,
       strftime(ts, '%Y-%m-%d') as ts_date,
       {_TS_SQL} as ts_datetime,
       strftime(ts, '%Y%m%d_%H%M%S') as ts_log,
       '' as ts_other,
       concat('[', {_TS_SQL}, '] [INFO] ', event_type, ' by ', coalesce(cast(user_id as string), '')) as line,
       concat('[', {_TS_SQL}, '] [INFO] event_type: ', coalesce(nullif(event_type, ''), 'NULL'), chr(10),
              '[', {_TS_SQL}, '] [INFO] user: ',
              coalesce(nullif(case when event_type = 'view' then '' else cast(user_id as string) end, ''),
                       'NULL')) as info
from events"""


# ===================================================================== X13, D5
_ARCHIVE_COLUMNS = ["adb_run_id", "adb_job_id", "nb_path", "adb_root_run_id", "root_job_id",
                    "root_job_strt_dt", "run_log", "html_file_lctn", "log_dt", "log_dttm",
                    "monoline", "expt_sts"]


@query("archive_rows")
def q_archive_rows(spark, sf):
    o = read_table(spark, sf, "orders")
    runs = o.select(
        F.col("o_orderkey").cast("string").alias("adb_run_id"),
        F.col("o_custkey").cast("string").alias("adb_job_id"),
        F.concat(F.lit("/nb/"), F.col("o_orderpriority")).alias("nb_path"),
        F.col("o_custkey").cast("string").alias("adb_root_run_id"),
        F.concat(F.lit("J"), F.col("o_custkey").cast("string")).alias("root_job_id"),
        X.time_text("o_orderdate", "date").alias("root_job_strt_dt"),
        F.when(F.col("o_orderstatus") == "P", "")
        .otherwise(F.concat(F.lit("run/"), F.col("o_orderkey").cast("string"))).alias("run_log"),
        X.html_file_path(F.lit(ARCHIVE_LOCATION), F.lit(ARCHIVE_PREFIX), F.col("o_custkey"),
                         F.col("o_custkey"), F.col("o_orderkey")).alias("html_file_lctn"),
        X.time_text("o_orderdate", "date").alias("log_dt"),
        X.time_text("o_orderdate", "datetime").alias("log_dttm"),
        F.upper(F.lit(TENANT)).alias("monoline"),
        F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("").alias("expt_sts"),
    )
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _ARCHIVE_COLUMNS])
    return ledger.align_to(runs, schema, ledger.ARCHIVE_DEFAULTS)


SQL["archive_rows"] = f"""
select cast(o_orderkey as string) as adb_run_id, cast(o_custkey as string) as adb_job_id,
       concat('/nb/', o_orderpriority) as nb_path, cast(o_custkey as string) as adb_root_run_id,
       concat('J', cast(o_custkey as string)) as root_job_id,
       strftime(o_orderdate, '%Y-%m-%d') as root_job_strt_dt,
       case when o_orderstatus = 'P' then null else concat('run/', cast(o_orderkey as string)) end as run_log,
       concat('{ARCHIVE_LOCATION}/', '{ARCHIVE_PREFIX}', '_', cast(o_custkey as string), '_',
              cast(o_custkey as string), '_', cast(o_orderkey as string), '.HTML') as html_file_lctn,
       strftime(o_orderdate, '%Y-%m-%d') as log_dt,
       left(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), 23) as log_dttm,
       upper('{TENANT}') as monoline,
       case when o_orderstatus = 'F' then 'DONE' else 'NOT STARTED' end as expt_sts
from orders"""


# ===================================================================== X7
def _view_doc():
    return F.concat(F.lit('{"views":[{"content":"'), F.col("event_type"), F.lit('"}]}'))


@query("json_view_content")
def q_json_view_content(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", X.json_path("props", "$.k").alias("k"),
                    X.html_view_content(_view_doc()).alias("content"))


SQL["json_view_content"] = """
select event_id, json_extract_string(props, '$.k') as k,
       json_extract_string(concat('{"views":[{"content":"', event_type, '"}]}'), '$.views[0].content')
         as content
from events"""


# ===================================================================== X8
@query("base64_roundtrip")
def q_base64_roundtrip(spark, sf):
    d = read_table(spark, sf, "documents")
    b64 = X.b64_encode("text")
    return d.select("doc_id", b64.alias("b64"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"),
                    (X.b64_decode(b64) == F.col("text")).alias("roundtrip_ok"))


SQL["base64_roundtrip"] = """
select doc_id, base64(encode(text)) as b64, cast(octet_length(encode(text)) as bigint) as n_bytes,
       decode(from_base64(base64(encode(text)))) = text as roundtrip_ok
from documents"""


# ===================================================================== S2-S5
@query("config_json_flatten")
def q_config_json_flatten(spark, sf):
    cfg = fx.job_config(spark, sf)

    def job(kind, seq):
        return F.struct(F.lit(kind).alias("job_type"), F.col("job_nm"),
                        F.lit(seq).cast("bigint").alias("job_seq"),
                        F.col("hldy_type").alias("job_hldy_flag"))

    jobs = (
        F.when(F.col("actv_flag").isNull(), F.array().cast("array<struct<job_type:string,"
                                                             "job_nm:string,job_seq:bigint,"
                                                             "job_hldy_flag:string>>"))
        .when(F.col("expt_data_type") == config.EXPORT_TO_CONTAINER, F.array(job("ingest", 1), job("export", 2)))
        .otherwise(F.array(job("ingest", 1)))
    )
    docs = cfg.select(F.to_json(F.struct(F.col("db_nm").alias("area_nm"), jobs.alias("job")))
                      .alias("doc"))
    return flatten_area_text(docs, "doc")


SQL["config_json_flatten"] = W("""
select db_nm as area_nm, 'ingest' as job_type, job_nm, cast(1 as bigint) as job_seq,
       hldy_type as job_hldy_flag
from job_config where actv_flag is not null
union all
select db_nm, 'export', job_nm, cast(2 as bigint), hldy_type
from job_config where actv_flag is not null and expt_data_type = 'cosmos_db'""", "job_config")


@query("config_json_quarantine")
def q_config_json_quarantine(spark, sf):
    """How many objects each document gave; a document that cannot be read gives none
    and does not end the job."""
    good, bad = checked_documents(fx.area_doc(spark, sf), "doc", AREA_SCHEMA)
    loaded = good.groupBy("k").agg(F.count(F.lit(1)).alias("n_objects"),
                                   F.sum(F.coalesce(F.size("job"), F.lit(0))).alias("n_jobs"))
    return loaded.withColumn("status", F.lit("LOADED")).unionByName(bad.select(
        "k", F.lit(0).cast("bigint").alias("n_objects"), F.lit(0).cast("bigint").alias("n_jobs"),
        F.lit("QUARANTINED").alias("status")))


SQL["config_json_quarantine"] = W("""
select k, case when ok then len(objs) else 0 end::bigint as n_objects,
       case when ok then list_sum(list_transform(objs, lambda o: coalesce(json_array_length(o, '$.job'), 0))) else 0 end::bigint
         as n_jobs, case when ok then 'LOADED' else 'QUARANTINED' end as status
from (select k, objs, coalesce(len(objs) > 0 and len(list_filter(objs, lambda o: json_type(o) <> 'OBJECT')) = 0, false) as ok
      from (select k, case when doc is null or not json_valid(doc) then null
                           when json_type(doc) = 'ARRAY' then json_extract(doc, '$[*]')
                           when json_type(doc) = 'OBJECT' then [doc::json] end as objs
            from area_doc) p) q""", "area_doc")


# ===================================================================== X11, X12
@query("run_ids")
def q_run_ids(spark, sf):
    o = read_table(spark, sf, "orders")
    prefix = F.when(F.col("o_orderstatus") == "F", "JOB").otherwise("")
    ids = o.select("o_orderkey", X.run_id(prefix).alias("run_id"), X.exec_user().alias("exec_usr"))
    return ids.select(
        "o_orderkey", F.substring_index("run_id", "_", 1).alias("prefix"),
        F.col("run_id").rlike("^(JOB|MANUAL)_[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("is_run_id"),
        F.col("exec_usr").isNotNull().alias("has_user"))


SQL["run_ids"] = """
select o_orderkey, case when o_orderstatus = 'F' then 'JOB' else 'MANUAL' end as prefix,
       true as is_run_id, true as has_user
from orders"""


# ===================================================================== E1, E2
def _names(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", "c_name")


@query("encrypt_roundtrip")
def q_encrypt_roundtrip(spark, sf):
    key = secrets.token_bytes(32)
    both = _names(spark, sf).withColumn("enc", F.col("c_name"))
    return _opened(encrypt_columns(both, ["enc"], key), key, secrets.token_bytes(32))


def _opened(enc, key, other):
    """What a key and another key make of column ``enc`` beside the plain name."""
    shown = enc.withColumn("cipher_len", F.length("enc")).withColumn(
        "is_changed", F.col("enc") != F.col("c_name")).withColumn("has_breaks", F.col("enc").rlike("[\r\n]"))
    out = decrypt_columns(shown.withColumn("shut", F.col("enc")), ["enc"], key)
    out = decrypt_columns(out, ["shut"], other)
    return out.select("c_custkey", "c_name", F.col("enc").alias("opened"), "is_changed", "has_breaks",
                      F.col("shut").isNull().alias("shut_to_other_key"), "cipher_len")


# AES-GCM adds 12 bytes of nonce and 16 of tag; base64 makes 4 characters of 3 bytes.
_ENCRYPT_SQL = """
select c_custkey, c_name, c_name as opened, true as is_changed, false as has_breaks,
       true as shut_to_other_key,
       cast(4 * ((octet_length(encode(c_name)) + 28 + 2) // 3) as integer) as cipher_len
from customer"""
SQL["encrypt_roundtrip"] = _ENCRYPT_SQL


@query("rewrap_roundtrip")
def q_rewrap_roundtrip(spark, sf):
    old, new = secrets.token_bytes(32), secrets.token_bytes(16)
    enc = encrypt_columns(_names(spark, sf).withColumn("enc", F.col("c_name")), ["enc"], old)
    return _opened(rewrap_columns(enc, ["enc"], old, new), new, old)


SQL["rewrap_roundtrip"] = _ENCRYPT_SQL


@query("envelope_rotation")
def q_envelope_rotation(spark, sf):
    """Names under the data key of their nation; the ring is rotated, the names stay."""
    old, new = secrets.token_bytes(32), secrets.token_bytes(32)
    ring = create_key_ring(read_table(spark, sf, "nation"), old, "n_nationkey")
    names = read_table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("key_id"))
    # Ciphertexts have random nonces: they are drawn once and kept.
    kept = cut_lineage(encrypt_with_ring(names.withColumn("enc", F.col("c_name")), ["enc"], ring, old))
    rotated = cut_lineage(rotate_key_ring(ring, old, new))
    shown = kept.withColumns({c: F.col("enc") for c in ("opened", "by_old_wrap", "by_old_ring")}).withColumn(
        "is_changed", F.col("enc") != F.col("c_name"))
    out = decrypt_with_ring(shown, ["opened"], rotated, new)
    out = decrypt_with_ring(out, ["by_old_wrap"], rotated, old)
    out = decrypt_with_ring(out, ["by_old_ring"], ring, new)
    return out.select("c_custkey", "key_id", "c_name", "opened", "is_changed", F.length("enc").alias("cipher_len"),
                      F.col("by_old_wrap").isNull().alias("shut_to_old_wrap"),
                      F.col("by_old_ring").isNull().alias("old_ring_is_shut"))


SQL["envelope_rotation"] = """
select c_custkey, c_nationkey as key_id, c_name, c_name as opened, true as is_changed,
       cast(4 * ((octet_length(encode(c_name)) + 28 + 2) // 3) as integer) as cipher_len,
       true as shut_to_old_wrap, true as old_ring_is_shut
from customer"""


# ===================================================================== A2 + A3 as a stream
@query("stream_run_status")
def q_stream_run_status(spark, sf):
    path = os.path.join(sf, "orders.parquet")
    schema = read_table(spark, sf, "orders").schema
    # A table written as a folder of files streams from that folder; a single
    # file streams from its folder with a name filter.
    if os.path.isdir(path):
        source = ls.read_event_stream(spark, path, schema)
    else:
        source = ls.read_event_stream(spark, sf, schema, name_glob=os.path.basename(path))
    status = ls.run_status_stream(fx.job_log_of(source))
    out = ls.stream_location(spark, "run-status-snapshot")
    ls.write_snapshot(status, out).awaitTermination()
    return ls.read_snapshot(spark, out, status.schema)


SQL["stream_run_status"] = W("""
select job_nm, n_running, n_trigger, n_other, n_running > 0 as is_duplicate,
       n_trigger = 1 and n_other = 0 as trigger_ok
from (select job_nm,
             count(*) filter (where job_sts = 'RUNNING') as n_running,
             count(*) filter (where job_sts = 'TRIGGER-RUNNING') as n_trigger,
             count(*) filter (where job_sts <> 'TRIGGER-RUNNING') as n_other
      from job_log group by job_nm) t""", "job_log")


# ===================================================================== J4 count check (L2)
@query("activity_last_copy_count")
def q_activity_last_copy_count(spark, sf):
    """Per run: files written by the last Copy (by sequence) against the
    number of files listed for the run; no Copy reporting counts -> NULL."""
    last = reconcile.copy_totals(_activities(spark, sf), ["run_id"], MAX_MISMATCH, with_data=False,
                                 order=_activity_order()).select(
        "run_id", "last_files_written", "failed")
    blob = reconcile.listing_totals(_blob_by_run(spark, sf), ["run_id"], tag="blob").select(
        "run_id", "blob_files")
    j = last.join(blob, "run_id", "full_outer")
    return j.select("run_id", "last_files_written", F.coalesce("blob_files", F.lit(0)).alias("blob_files"),
                    (F.col("last_files_written") == F.coalesce("blob_files", F.lit(0))).alias("count_match"),
                    "failed")


SQL["activity_last_copy_count"] = W(f"""
select coalesce(l.run_id, b.run_id) as run_id, l.last_files_written,
       coalesce(b.blob_files, 0) as blob_files,
       l.last_files_written = coalesce(b.blob_files, 0) as count_match, l.failed
from (select run_id,
             arg_max(fw, struct_pack(s := activity_seq, i := activity_id, w := fw))
               filter (where t = 'Copy' and fr is not null and fw is not null) as last_files_written,
             count(*) filter (where t = 'Copy' and not coalesce(fr = fw, false)) > {MAX_MISMATCH} as failed
      from a group by run_id) l
full outer join (select cast(regexp_extract(file_nm, '^f_([0-9]+)\\.dat$', 1) as bigint) as run_id,
                        count(*) as blob_files
                 from manifest_sent group by 1) b
on l.run_id = b.run_id""", "activity_run", "manifest_sent", extra={"a": _ACT_SQL})


# ===================================================================== J4, J5 + U2: a verdict per run
def _copied(spark, sf):
    """Listed files of the runs (every 29th run lists none): data, control."""
    listed = F.col("run_id") % 29 != 0
    cols = ["run_id", "file_nm", "file_size"]
    return (_blob_by_run(spark, sf).where(listed).select(*cols), fx.ctl_listing(spark, sf).where(listed).select(*cols))


def _verdicts(spark, sf, rule):
    data, control = _copied(spark, sf)
    acts = reconcile.parse_reports(fx.copy_report(spark, sf))
    facts = reconcile.copy_facts(acts, ["run_id"], META_ACTIVITY, "activity_seq", data, control)
    return reconcile.run_verdicts(facts, ["run_id"], rule, MAX_MISMATCH)


# The checks as they were written: Copies are counted up, a failing one is retried
# MAX_MISMATCH times; a dictionary keeps the last size of each name; every listed
# name is looked up in it.
_CHECK_SQL = {
    "r": _REPORTS_READ_SQL,
    "a": _REPORT_SQL,
    "data": f"""select run_id, file_nm, file_size from ({_LISTED_SQL}) l where file_nm like 'f%' and run_id % 29 <> 0""",
    "control": "select run_id, file_nm, file_size from ctl_listing where run_id % 29 <> 0",
    "both_lists": "select * from data union all select * from control",
    "copies": """
select run_id, activity_seq, files_read as fr, files_written as fw, data_read as dr, data_written as dw
from a where activity_type = 'Copy'""",
    "said": f"""
select run_id, item_name, item_size from a
where activity_type = 'GetMetadata' and activity_name = '{META_ACTIVITY}'
qualify row_number() over (partition by run_id, item_name order by activity_seq desc) = 1""",
    "faults": f"""
select run_id, count(*) filter (where is_malformed or (activity_type = 'GetMetadata' and activity_name = '{META_ACTIVITY}'
         and (item_name is null or item_size is null))) as n from a group by run_id""",
    "runs": "select run_id from copy_report union select run_id from data union select run_id from control",
}


def _verdict_sql(bad: str, copied: str, listed: str, wrong: str, counted: str) -> str:
    return W(f"""
select runs.run_id, coalesce(faults.n, 0)::bigint as n_malformed,
  (select count(*) from copies c where c.run_id = runs.run_id and ({bad}))::bigint as n_bad,
  ({copied})::bigint as copied, ({listed})::bigint as listed, ({wrong})::bigint as n_wrong_files,
  case when faults.n is null then 'NOT_REPORTED' when faults.n > 0 then 'MALFORMED'
       when (select count(*) from copies c where c.run_id = runs.run_id and ({bad})) > {MAX_MISMATCH} then 'MISMATCH'
       when ({copied}) is distinct from ({listed}) then '{counted}' when ({wrong}) > 0 then 'SIZE' else 'OK' end as verdict
from runs left join faults on faults.run_id = runs.run_id""", "copy_report", "manifest_sent", "ctl_listing",
             extra=_CHECK_SQL)


def _wrong_sql(listing: str) -> str:
    return (f"select count(*) from {listing} l left join said s on s.run_id = l.run_id and s.item_name = l.file_nm "
            "where l.run_id = runs.run_id and s.item_size is distinct from l.file_size")


@query("activity_run_verdict")
def q_activity_run_verdict(spark, sf):
    return _verdicts(spark, sf, reconcile.TOTAL_FILES)


SQL["activity_run_verdict"] = _verdict_sql(
    "fr is null or fw is null or fr <> fw",
    "select coalesce(sum(fw), 0) from copies c where c.run_id = runs.run_id and fr is not null and fw is not null",
    "select count(*) from both_lists l where l.run_id = runs.run_id", _wrong_sql("both_lists"), "COUNT")


@query("activity_last_copy_verdict")
def q_activity_last_copy_verdict(spark, sf):
    return _verdicts(spark, sf, reconcile.LAST_COPY)


SQL["activity_last_copy_verdict"] = _verdict_sql(
    "fr is null or fw is null or fr <> fw",
    "select arg_max(fw, activity_seq) from copies c where c.run_id = runs.run_id and fr is not null and fw is not null",
    "select count(*) from data l where l.run_id = runs.run_id", _wrong_sql("data"), "COUNT")


@query("activity_bytes_verdict")
def q_activity_bytes_verdict(spark, sf):
    return _verdicts(spark, sf, reconcile.TOTAL_BYTES)


SQL["activity_bytes_verdict"] = _verdict_sql(
    "fr is null or fw is null or fr <> fw or dr is null or dw is null or dr <> dw",
    "select coalesce(sum(dw), 0) from copies c where c.run_id = runs.run_id and fr = fw and dr is not null",
    "select coalesce(sum(file_size), 0) from both_lists l where l.run_id = runs.run_id", "0", "SIZE")


# ===================================================================== S4: dependencies of job documents
@query("dependency_flatten")
def q_dependency_flatten(spark, sf):
    pending = F.struct(
        F.lit("TABLE").alias("pndng_type"), F.col("db_nm").alias("pndng_db"),
        F.col("trgt_tbl_nm").alias("pndng_tbl"), F.col("job_nm").alias("pndng_job_nm"),
        F.col("actv_flag").alias("alw_zero_rec_flag"), F.col("src_path").alias("script_chck_dpdc"))
    docs = fx.job_config(spark, sf).select(F.to_json(F.struct(
        F.concat(F.lit("after_"), F.col("job_nm")).alias("job_nm"),
        F.when(F.col("hldy_type") != "NULL", F.array(pending)).alias("pndng_job"))).alias("doc"))
    return flatten_dependency_text(docs, "doc")


SQL["dependency_flatten"] = W("""
select concat('after_', job_nm) as job_nm, 'TABLE' as pndng_type, db_nm as pndng_db, trgt_tbl_nm as pndng_tbl,
       job_nm as pndng_job_nm, actv_flag as alw_zero_rec_flag, src_path as script_chck_dpdc
from job_config where hldy_type <> 'NULL'""", "job_config")


# ===================================================================== S1 + S5: a view, read by name
@query("config_view_scan")
def q_config_view_scan(spark, sf):
    view = register_view(q_config_json_flatten(spark, sf), "cmmn_area")
    out = scan(spark, view, F.col("job_type") == "export")
    return out.withColumn("n_columns", F.lit(len(column_names(spark, view))))


SQL["config_view_scan"] = W("""
select db_nm as area_nm, 'export' as job_type, job_nm, cast(2 as bigint) as job_seq,
       hldy_type as job_hldy_flag, 5 as n_columns
from job_config where actv_flag is not null and expt_data_type = 'cosmos_db'""", "job_config")


# ===================================================================== D2, D4, D7: ledgers without tenant
def _dsr_log(spark, sf):
    return fx.job_log(spark, sf).drop("monoline")


@query("dsr_append")
def q_dsr_append(spark, sf):
    rows = _new_runs(spark, sf).withColumn(
        "rmrk", F.when(F.col("rmrk") != "", F.concat(F.lit("it's '"), F.col("rmrk"), F.lit("'"))))
    return ledger.append_rows(_dsr_log(spark, sf), rows, swap_quotes=True)


SQL["dsr_append"] = W("""
select log_no, job_nm, dl_data_dt, job_sts, rmrk from job_log
union all
select event_id + 1000000000, concat(event_type, '_', cast(user_id as string)), cast(cast(ts as date) as string),
       'RUNNING', case when event_id % 3 <> 0 then concat('it"s "', event_type, '"') end
from events""", "job_log")


@query("dsr_update")
def q_dsr_update(spark, sf):
    return ledger.update_rows(_dsr_log(spark, sf), F.expr(_UPDATE_PRED),
                              {"job_sts": ledger.STS_SUCCESS, "rmrk": F.expr(_UPDATE_RMRK)})


_DSR_HIT = f"coalesce({_UPDATE_PRED}, false)"
SQL["dsr_update"] = W(f"""
select log_no, job_nm, dl_data_dt, case when {_DSR_HIT} then 'SUCCESS' else job_sts end as job_sts,
       case when {_DSR_HIT} then ({_UPDATE_RMRK}) else rmrk end as rmrk
from job_log""", "job_log")
