"""Drop-in entry points with the original call shapes.

Callers of the per-job helpers pass a table name, a ``WHERE ...`` text and
dicts of values, and expect an exception when a check fails.  ``DropIn``
keeps those call shapes and runs each on the whole-table operators: every
check is one aggregate (not one count or collect per column or per flag),
every write goes through the aligned, partition-aware sinks.  What the
original read from environment globals (configuration database, tenant) is
given to the constructor.

The predicate text is parsed by Spark as an *expression* (``F.expr``), so it
can filter but cannot smuggle in another statement.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import config, ledger, markers, quality, reconcile
from runledger.session import cut_lineage
from runledger.sources.control_files import ControlSpec, read_control_files
from runledger.sources.manifests import list_files

# The texts and prefixes of the exceptions that callers match on.
SYSTEM_ERROR, VALUE_ERROR, EXCEPTION = "[System Error] ", "[Value Error] ", "[Exception] "
MSG_DUPLICATE_RUN = "Duplicate running found"
MSG_NULL_VALUE = "Null value in configuration found"


def predicate(where_cond: str | None) -> Column:
    """``"WHERE job_nm = 'x' AND ..."`` (or without WHERE) -> Column."""
    text = (where_cond or "").strip()
    if text[:5].upper() == "WHERE":
        text = text[5:]
    return F.expr(text) if text.strip() else F.lit(True)


class DropIn:
    def __init__(self, spark: SparkSession, config_db: str, tenant: str | None = None,
                 max_copy_mismatch: int = 0, marker_table: str | None = None,
                 route_tables: Mapping[str, str] | None = None, marker_root: str = ""):
        """``marker_table`` + ``route_tables`` (prefix -> configuration table
        name, e.g. ``{"pi": "tbl_ingt_job", ...}``) turn on the marker hooks:
        an insert removes the markers its runs invalidate (D12), an update to
        SUCCESS writes markers for the rows it touched (D13)."""
        self.spark = spark
        self.db = config_db
        self.tenant = tenant
        self.max_copy_mismatch = max_copy_mismatch
        self.marker_table = marker_table
        self.route_tables = dict(route_tables or {})
        self.marker_root = marker_root

    def _hooks_on(self) -> bool:
        return bool(self.marker_table and self.route_tables)

    def _routed(self, runs: DataFrame) -> DataFrame:
        cfgs = {p: self.spark.table(self._table(t)) for p, t in self.route_tables.items()}
        return config.attach_routes(runs, cfgs)

    def _tenant_of(self, rows: DataFrame) -> Column:
        own = F.upper(F.lit(self.tenant or ""))
        return F.coalesce(F.col("monoline"), own) if "monoline" in rows.columns else own

    def _after_insert(self, rows: DataFrame) -> None:
        if self._hooks_on() and {"job_nm", "dl_data_dt"} <= set(rows.columns):
            keep = [c for c in ("job_nm", "dl_data_dt", "monoline") if c in rows.columns]
            keys = markers.invalidation_keys(self._routed(rows.select(*keep)), self._tenant_of(rows))
            markers.remove_stale_markers(self.spark, self._table(self.marker_table), keys)

    def _table(self, tbl_nm: str) -> str:
        return f"{self.db}.{tbl_nm}" if self.db else tbl_nm

    def _rows(self, tbl_nm: str, values) -> DataFrame:
        rows = [values] if isinstance(values, Mapping) else list(values)
        cols = sorted({k for r in rows for k in r})
        # Falsy values (None, '', 0, False) are left out of an insert, so they are NULL.
        data = [tuple(str(r[c]) if r.get(c) else None for c in cols) for r in rows]
        return self.spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in cols))

    # ------------------------------------------------------------ A1
    def get_config(self, tbl_nm: str, where_cond: str, tbl_area: bool = False) -> DataFrame:
        """Rows of the configuration matching the predicate; raises when no
        active row / an inactive one only / several active rows (area mode:
        only when nothing matches).  One aggregate."""
        df = self.spark.table(self._table(tbl_nm)).where(predicate(where_cond))
        if tbl_area:
            if df.limit(1).count() == 0:
                raise SystemError(SYSTEM_ERROR + config.MSG_NOT_FOUND, f"{tbl_nm}, {where_cond}")
            return df
        r = df.agg(F.count_if(F.upper("actv_flag") == "Y").alias("y"),
                   F.count_if(F.upper("actv_flag") == "N").alias("n")).collect()[0]
        if r.y == 0:
            msg = config.MSG_NOT_FOUND if r.n == 0 else config.MSG_INACTIVE_ONLY
            raise SystemError(SYSTEM_ERROR + msg, f"{tbl_nm}, {where_cond}")
        if r.y > 1:
            raise SystemError(SYSTEM_ERROR + config.MSG_DUPLICATE, f"{tbl_nm}, {where_cond}")
        return df

    # ------------------------------------------------------------ A2, A3
    def chck_dup_job(self, tbl_nm: str, where_cond: str, flag=None) -> None:
        df = self.spark.table(self._table(tbl_nm)).where(predicate(where_cond))
        s = F.col("job_sts")
        r = df.agg(F.count(F.lit(1)).alias("all"),
                   F.count_if(s == ledger.STS_TRIGGER_RUNNING).alias("trig"),
                   F.count_if(s != ledger.STS_TRIGGER_RUNNING).alias("other")).collect()[0]
        dup = r.all > 0 if not flag else not (r.trig == 1 and r.other == 0)
        if dup:
            raise SystemError(SYSTEM_ERROR + MSG_DUPLICATE_RUN, f"{tbl_nm}, {where_cond}")

    # ------------------------------------------------------------ V1-V4
    def vld_config(self, df_conf: DataFrame, list_col: Sequence[str]) -> None:
        bad = [r.column_name for r in quality.required_violations(df_conf, list_col).collect()]
        if bad:
            raise ValueError(VALUE_ERROR + MSG_NULL_VALUE, ", ".join(sorted(bad)))

    def vld_flag_config(self, df_conf: DataFrame, list_col: Sequence[str]) -> None:
        quality.assert_clean(quality.flag_violations(df_conf, list_col))

    def vld_path_config(self, df_conf: DataFrame, list_col: Sequence[str]) -> None:
        quality.assert_clean(quality.path_violations(df_conf, list_col))

    def vld_val_config(self, df_conf: DataFrame, dict_col_list: Mapping[str, Sequence[str]] | DataFrame) -> None:
        """V4; the lists may also be a table of column_name and allowed_value."""
        if isinstance(dict_col_list, DataFrame):
            named = {r[0] for r in dict_col_list.select("column_name").distinct().collect()}  # columns of df_conf
            report = quality.value_violations_from(df_conf, [c for c in df_conf.columns if c in named], dict_col_list)
        else:
            report = quality.value_violations(df_conf, dict_col_list)
        quality.assert_clean(report)

    # ------------------------------------------------------------ D1-D9
    def insert_log(self, tbl_nm: str, dict_values, partition=None, multi_values: bool = False) -> None:
        """D3: aligned append; ``monoline`` defaults to the upper-cased tenant;
        with ``multi_values`` single quotes become double quotes."""
        defaults = ledger.tenant_defaults(self.tenant) if self.tenant else None
        rows = self._rows(tbl_nm, dict_values)
        ledger.write_append(self.spark, self._table(tbl_nm), rows, defaults, swap_quotes=multi_values)
        if not multi_values:
            self._after_insert(rows)

    def insert_dsr_log(self, tbl_nm: str, dict_values, partition=None, multi_values: bool = False) -> None:
        """As ``insert_log`` without the tenant column."""
        rows = self._rows(tbl_nm, dict_values)
        ledger.write_append(self.spark, self._table(tbl_nm), rows, swap_quotes=multi_values)
        if not multi_values:
            self._after_insert(rows)

    def insert_log_job_configuration(self, tbl_nm: str, dict_values, multi_values: bool = False) -> None:
        """Rows of a configuration log in the table's column order, absent and falsy
        values NULL; no tenant column is filled in and no marker is touched."""
        ledger.write_append(self.spark, self._table(tbl_nm), self._rows(tbl_nm, dict_values), swap_quotes=multi_values)

    def update_log_bulk(self, tbl_nm: str, updates: DataFrame, on: Sequence[str], assign: Sequence[str],
                        vld_dup_flag: str = "N") -> DataFrame:
        """D6 (+ A4, D13) for a table of updates, own tenant only; the status of each key.
        Rows that are set to SUCCESS get their markers."""
        report = ledger.write_updates(self.spark, self._table(tbl_nm), updates, on, assign, self.tenant,
                                      guard=str(vld_dup_flag).upper() == "Y")
        if self._hooks_on() and "job_sts" in assign:
            done = report.where((F.col("status") == ledger.UPDATE_OK) & (F.col("job_sts") == ledger.STS_SUCCESS))
            table = self.spark.table(self._table(tbl_nm))
            if self.tenant and "monoline" in table.columns:
                table = table.where(ledger.tenant_predicate(self.tenant))
            self._write_success_markers(table.join(done.select(*on), list(on), "left_semi"))
        return report

    def insr_arch_nb_log(self, dict_values) -> None:
        """``expt_sts`` defaults to NOT STARTED."""
        ledger.write_append(self.spark, self._table("tbl_arch_nb_log"),
                            self._rows("tbl_arch_nb_log", dict_values), ledger.ARCHIVE_DEFAULTS)

    def _assignments(self, dict_upd: Mapping[str, object]) -> dict:
        # A value containing CASE WHEN is a raw expression, anything else a literal.
        return {k: F.expr(str(v)) if v and "CASE WHEN" in str(v) else v for k, v in dict_upd.items()}

    def update_log(self, tbl_nm: str, where_cond: str, dict_upd: Mapping[str, object],
                   vld_dup_flag: str = "N") -> None:
        """D6 (+ A4 guard with ``vld_dup_flag='Y'``), own tenant only."""
        pred = predicate(where_cond)
        if self.tenant:
            pred = pred & ledger.tenant_predicate(self.tenant)
        self._update(tbl_nm, pred, dict_upd, vld_dup_flag)

    def _update(self, tbl_nm: str, pred: Column, dict_upd: Mapping[str, object], vld_dup_flag: str) -> None:
        table = self.spark.table(self._table(tbl_nm))
        if str(vld_dup_flag).upper() == "Y":
            ledger.assert_no_duplicate_update(table, pred)
        touched = None
        if self._hooks_on() and dict_upd.get("job_sts") == ledger.STS_SUCCESS:
            # Captured before the update rewrites the rows the predicate names.
            touched = cut_lineage(table.where(F.coalesce(pred, F.lit(False)))
                                  .select("job_nm", "dl_data_dt", *(["monoline"] if "monoline" in table.columns else [])))
        ledger.write_update(self.spark, self._table(tbl_nm), pred, self._assignments(dict_upd))
        if touched is not None:
            self._write_success_markers(touched)

    def _write_success_markers(self, touched: DataFrame) -> None:
        """Markers of runs that an update has set to SUCCESS."""
        ts = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
        new = markers.markers_after_update(self._routed(touched), F.lit(True), {"job_sts": ledger.STS_SUCCESS},
                                           self.marker_root, ts, self._tenant_of(touched))
        markers.write_markers(self.spark, self._table(self.marker_table), new)

    def update_dsr_log(self, tbl_nm: str, where_cond: str, dict_upd: Mapping[str, object],
                       vld_dup_flag: str = "N") -> None:
        """As ``update_log`` without the tenant predicate."""
        self._update(tbl_nm, predicate(where_cond), dict_upd, vld_dup_flag)

    def cleanup_log(self, tbl_nm: str, dict_value: Mapping[str, str]) -> None:
        """Delete every row of the job."""
        ledger.write_delete(self.spark, self._table(tbl_nm), F.col("job_nm") == dict_value["job_nm"])

    def cleanup_dsr_log(self, tbl_nm: str, where_cond: str) -> None:
        """Delete by predicate (a NULL predicate keeps the row)."""
        ledger.write_delete(self.spark, self._table(tbl_nm), predicate(where_cond))

    # ------------------------------------------------------------ S6, J3
    def read_ctl_file(self, ctl_file_path: str, dict_spec: Mapping[str, str]) -> int:
        """The count of the control file; raises when it is not an integer or
        when the path names several files."""
        spec = ControlSpec.from_dict(dict(dict_spec))
        found = read_control_files(self.spark, ctl_file_path, spec)
        n = found.count()
        if n > 1:
            raise ValueError(f"{n} control files match {ctl_file_path}; name one")
        rows = found.collect()
        if not rows or rows[0].ctl_count is None:
            field = rows[0].ctl_field if rows else None
            raise ValueError(f"the count of {ctl_file_path} (field {spec.position}) is no whole number: {field}")
        return rows[0].ctl_count

    def vld_copy_file(self, orig_file_list: Sequence[str], land_file_list: Sequence[str]) -> None:
        """J3 + A7: same number of files, and every file the same size on both
        sides (compared by base name; empty and hidden files count as any other)."""
        src = list_files(self.spark, list(orig_file_list)).select("file_nm", "file_size")
        tgt = list_files(self.spark, list(land_file_list)).select("file_nm", "file_size")
        n_src, n_tgt = src.count(), tgt.count()
        if not n_src == n_tgt == len(orig_file_list) == len(land_file_list):
            raise RuntimeError(EXCEPTION + "the sides do not hold as many files as were named",
                               {"named": (len(orig_file_list), len(land_file_list)), "found": (n_src, n_tgt)})
        bad = (reconcile.compare_listings(src, tgt, ["file_nm"])
               .where(F.col("status") != reconcile.MATCH).collect())
        if bad:
            raise RuntimeError(EXCEPTION + "files differ between the sides",
                               [r.asDict() for r in bad])

    # ------------------------------------------------------------ J4, J5, A5
    def _vld_copy(self, report: str, adf_actv_nm: str, data: Sequence[str], control: Sequence[str], rule: str) -> None:
        def listed(paths):
            return list_files(self.spark, list(paths)).select(F.lit(1).alias("run_id"), "file_nm", "file_size")

        acts = reconcile.parse_reports(self.spark.createDataFrame([(1, report)], "run_id int, doc string"))
        facts = reconcile.copy_facts(acts, ["run_id"], adf_actv_nm, "activity_seq", listed(data), listed(control))
        found = reconcile.run_verdicts(facts, ["run_id"], rule, self.max_copy_mismatch).collect()[0]
        if found.verdict != "OK":
            raise RuntimeError(EXCEPTION + f"copy check: {found.verdict}", found.asDict())

    def vld_adf_copy_file(self, report: str, adf_actv_nm: str, list_blob_file: Sequence[str]) -> None:
        """The run's report (the document that the copy service returns, in place of
        the id it was fetched by) against the data files, by the last Copy."""
        self._vld_copy(report, adf_actv_nm, list_blob_file, [], reconcile.LAST_COPY)

    def vld_adf_copy_file_outbnd(self, report: str, adf_actv_nm: str, list_blob_file: Sequence[str],
                                 list_blob_ctl_file: Sequence[str]) -> None:
        """All Copies of the report against data and control files."""
        self._vld_copy(report, adf_actv_nm, list_blob_file, list_blob_ctl_file, reconcile.TOTAL_FILES)

    def vld_adf_copy_file_outbnd_total(self, report: str, adf_actv_nm: str, list_blob_file: Sequence[str],
                                       list_blob_ctl_file: Sequence[str]) -> None:
        """A5 + A6: the bytes of all Copies against those of data and control files."""
        self._vld_copy(report, adf_actv_nm, list_blob_file, list_blob_ctl_file, reconcile.TOTAL_BYTES)
