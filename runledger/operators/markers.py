"""Success markers.

A marker is an empty file whose name is the record:
``<root>/<tenant>/evtg/<zone>/<yyyymmdd>/<lower(title)>.<job>.<yyyymmdd>.<ts>.success``.
Here markers are rows (zone, folder date, file name, path) that a caller can
append to a marker table or turn into files.

Stale-marker matching (D11) is "file name contains ``title.job.yyyymmdd``"
within the same tenant, zone and date folder.  A substring test between two sets is a
pairwise comparison; to keep it a hash join, both sides get an exact equi-key,
the whole job:

    A key is ``T.J.D`` (T = lower title, may be empty or hold dots, J = job, may
    hold dots, D = the folder's date).  J stands between two dots, so where the key
    occurs in a file name, J is a run of whole dot-components, the text after it
    starts with D, and the text before it ends in T.

So each file name yields the runs of components that end just before a ``D``
(a name has few components), and is joined on (tenant, zone, date, job); the only
test left is that the text before ends in the title.  Keys are de-duplicated first,
so a folder's markers meet only keys of their own job, also where all jobs of
a folder end in the same component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.columns import (
    compact_date, marker_file_name, marker_folder,
)
from runledger.operators.config import ZONE_SKIP
from runledger.operators.ledger import (
    STS_SUCCESS, clustered, create_ledger, rewrite_partitions,
)


def success_markers(routed_runs: DataFrame, root: str, ts_text: Column, tenant: Column,
                    key: str = "job_nm", date_col: str = "dl_data_dt",
                    status_col: str = "job_sts") -> DataFrame:
    """D10 + D13: one marker per run that reached SUCCESS and routes to a
    zone other than '' and ``skip`` with a non-empty title.  ``routed_runs``
    carries ``zone`` and ``title_nm`` (``config.attach_routes``)."""
    ok = routed_runs.where(
        (F.col(status_col) == STS_SUCCESS)
        & (F.col("zone") != "") & (F.col("zone") != ZONE_SKIP) & (F.col("title_nm") != "")
    )
    name = marker_file_name(F.col("title_nm"), F.col(key), F.col(date_col), ts_text)
    folder = marker_folder(F.lit(root), tenant, F.col("zone"), F.col(date_col))
    return ok.select(
        tenant.alias("tenant"), F.col(key), F.col(date_col), F.col("zone"),
        compact_date(F.col(date_col)).alias("folder_dt"),
        name.alias("file_nm"),
        F.concat(folder, name).alias("marker_path"),
    )


def markers_after_update(routed_runs: DataFrame, predicate: Column, assignments: dict,
                         root: str, ts_text: Column, tenant: Column, **kw) -> DataFrame:
    """D13 as a hook on an update: when the update sets ``job_sts`` to
    SUCCESS, every run it touches gets its marker.  (The original pulled one
    job and date out of the predicate text; here the touched rows say it.)"""
    if assignments.get("job_sts") != STS_SUCCESS:
        return routed_runs.limit(0).select(
            *[F.lit(None).cast("string").alias(c) for c in
              ("tenant", "job_nm", "dl_data_dt", "zone", "folder_dt", "file_nm", "marker_path")])
    hit = routed_runs.where(F.coalesce(predicate, F.lit(False)))
    # Several runs of a job and date write one and the same file.
    return success_markers(hit.withColumn("job_sts", F.lit(STS_SUCCESS)), root, ts_text, tenant,
                           **kw).distinct()


def invalidation_keys(routed_new_runs: DataFrame, tenant: Column, key: str = "job_nm",
                      date_col: str = "dl_data_dt") -> DataFrame:
    """A new run invalidates its job's earlier markers of that date, those
    of its own tenant only (a tenant's markers lie in a folder of its own).

    Zone must be neither '' nor ``skip``; the title may be empty (then the key
    starts with ``.`` and matches any title of the job and date).  Routes
    with an error are left out.  One row per distinct key.
    """
    r = routed_new_runs.where(
        (F.col("zone") != "") & (F.col("zone") != ZONE_SKIP) & F.col("route_error").isNull()
    )
    return r.select(
        tenant.alias("tenant"), "zone",
        compact_date(F.col(date_col)).alias("folder_dt"),
        F.col(key).alias("_job"), F.lower("title_nm").alias("_title"),
    ).distinct()


def _job_places(file_nm: Column, folder_dt: Column) -> Column:
    """Runs of whole dot-components that end before a text starting with the date
    and do not begin the name: (``_job``, ``_before``: the text before the run's dot)."""
    comps = F.split(file_nm, r"\.", -1)
    n = F.size(comps)

    def text(first, count):
        return F.array_join(F.slice(comps, first, count), ".")

    dated = F.filter(F.sequence(F.lit(3), n), lambda i: text(i, n - i + 1).startswith(folder_dt))
    runs = F.flatten(F.transform(dated, lambda i: F.transform(F.sequence(F.lit(2), i - 1), lambda j: F.struct(
        text(j, i - j).alias("_job"), text(F.lit(1), j - 1).alias("_before")))))
    return F.array_distinct(F.when(n >= 3, runs))


def _met(markers: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides and the equi-join condition of the stale-marker match."""
    cand = markers.withColumn("_p", F.explode(_job_places(F.col("file_nm"), F.col("folder_dt")))).select(
        *markers.columns, "_p._job", "_p._before")
    # The keys are derived from runs (not a stored dimension), so no count is
    # spent on them up front: AQE broadcasts them when their measured size is
    # small, else keeps the shuffle join and splits a hot job's partition.
    k = keys.select("tenant", "zone", "folder_dt", "_job", "_title")
    equal = ((cand["tenant"] == k["tenant"]) & (cand["zone"] == k["zone"])
             & (cand["folder_dt"] == k["folder_dt"]) & (cand["_job"] == k["_job"]))
    return cand, k, equal


def stale_markers(markers: DataFrame, keys: DataFrame) -> DataFrame:
    """The markers a new run removes (same tenant, zone and date folder,
    file name contains the run's key).  ``markers`` needs tenant, zone,
    folder_dt, file_nm (one row per file); ``keys`` comes from ``invalidation_keys``."""
    cand, k, equal = _met(markers, keys)
    hit = cand.join(k, equal & cand["_before"].endswith(k["_title"]), "left_semi").drop("_job", "_before")
    # A name can match through two places; report it once.
    return hit.dropDuplicates([*MARKER_PARTITIONS, "file_nm"])


def remaining_markers(markers: DataFrame, keys: DataFrame) -> DataFrame:
    """D11, the other half: markers that survive the new runs."""
    names = [*MARKER_PARTITIONS, "file_nm"]
    return markers.join(stale_markers(markers, keys).select(*names), names, "left_anti")


# ------------------------------------------------------------------ marker table
MARKER_PARTITIONS = ("tenant", "zone", "folder_dt")
MARKER_COLUMNS = ("job_nm", "dl_data_dt", "file_nm", "marker_path", *MARKER_PARTITIONS)


def create_marker_table(spark, name: str) -> None:
    """D10 sink: markers as rows of a table partitioned by tenant, zone and date folder."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MARKER_COLUMNS])
    create_ledger(spark, name, schema, MARKER_PARTITIONS)


def write_markers(spark, name: str, new_markers: DataFrame) -> None:
    """Append markers (from ``success_markers``)."""
    clustered(new_markers.select(*MARKER_COLUMNS), MARKER_PARTITIONS).write.insertInto(name)


def remove_stale_markers(spark, name: str, keys: DataFrame) -> None:
    """D11 + D12 persisted: drop the markers the new runs' keys invalidate,
    rewriting only the (tenant, zone, date folder) partitions the keys name
    (a key whose folder has no marker names none)."""
    named = keys.select(*MARKER_PARTITIONS).distinct()
    here = spark.table(name).select(*MARKER_PARTITIONS).distinct()
    rewrite_partitions(spark, name, here.join(named, list(MARKER_PARTITIONS), "left_semi"),
                       lambda df: remaining_markers(df, keys))
