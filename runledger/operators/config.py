"""Configuration lookups.

The original checked one job per call: two counts over the filtered table,
then a ``collect()[0]`` for the fields.  Here every job is checked in one
aggregate, and routing joins the distinct jobs to one pre-aggregated row per
configured job, so the join is one-to-one whatever the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.columns import container_name, none_to_empty
from runledger.plans.strategy import bounded_broadcast

# Configuration is one row per configured job: small next to any run table.
CONFIG_MAX_BROADCAST_ROWS = 2_000_000

# The status messages of the configuration lookup.
MSG_NOT_FOUND = "Configuration not found"
MSG_INACTIVE_ONLY = "Active configuration not found (Inactive found)"
MSG_DUPLICATE = "Duplicate active configuration found"

STATUS_MESSAGES = {
    "NOT_FOUND": MSG_NOT_FOUND,
    "INACTIVE_ONLY": MSG_INACTIVE_ONLY,
    "DUPLICATE_ACTIVE": MSG_DUPLICATE,
    "OK": None,
}

# Job-name prefix -> zone; the skip zone; the export type whose
# title is a container name read from the JSON properties.
ROUTE_ZONES = {"pi": "ingt", "pt": "curated", "po": "outbnd"}
ZONE_SKIP = "skip"
EXPORT_TO_CONTAINER = "cosmos_db"
ROUTE_FIELDS = ["trgt_tbl_nm", "expt_data_type", "expt_file_ppty", "expt_file_nm_fmt"]


def _is_active(flag: str) -> Column:
    return F.upper(F.col(flag)) == "Y"


def _is_inactive(flag: str) -> Column:
    return F.upper(F.col(flag)) == "N"


def status_of(n_active: Column, n_inactive: Column) -> Column:
    return (
        F.when((n_active == 0) & (n_inactive == 0), "NOT_FOUND")
        .when(n_active == 0, "INACTIVE_ONLY")
        .when(n_active > 1, "DUPLICATE_ACTIVE")
        .otherwise("OK")
    )


def message_of(status: Column) -> Column:
    expr = None
    for code, msg in STATUS_MESSAGES.items():
        if msg is None:
            continue
        expr = F.when(status == code, msg) if expr is None else expr.when(status == code, msg)
    return expr


def config_counts(config: DataFrame, keys: Sequence[str], flag: str = "actv_flag",
                  fields: Sequence[str] = ()) -> DataFrame:
    """One row per key: active / inactive / all rows, and each field of the
    active row (any aggregate over active rows is that row when there is one)."""
    aggs = [
        F.count_if(_is_active(flag)).alias("n_active"),
        F.count_if(_is_inactive(flag)).alias("n_inactive"),
        F.count(F.lit(1)).alias("n_rows"),
    ] + [F.max(F.when(_is_active(flag), F.col(f))).alias(f) for f in fields]
    return config.groupBy(*keys).agg(*aggs)


def active_config_status(config: DataFrame, keys: Sequence[str] = ("job_nm",),
                         flag: str = "actv_flag", requested: DataFrame | None = None) -> DataFrame:
    """A1: verdict per key.  With ``requested``, keys absent from the
    configuration are reported as NOT_FOUND."""
    keys = list(keys)
    counts = config_counts(config, keys, flag)
    if requested is not None:
        counts = (
            requested.select(*keys).distinct()
            .join(bounded_broadcast(counts, CONFIG_MAX_BROADCAST_ROWS, bound_by=[config],
                                    bound_columns=keys), keys, "left")
            .select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                             for c in ("n_active", "n_inactive", "n_rows")])
        )
    status = status_of(F.col("n_active"), F.col("n_inactive"))
    return counts.withColumn("status", status).withColumn("message", message_of(F.col("status")))


def area_config_status(config: DataFrame, requested: DataFrame,
                       keys: Sequence[str] = ("job_nm",)) -> DataFrame:
    """A1, area mode: only 'not found' when a requested key has no row."""
    keys = list(keys)
    counts = config.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = bounded_broadcast(counts, CONFIG_MAX_BROADCAST_ROWS, bound_by=[config], bound_columns=keys)
    out = requested.select(*keys).distinct().join(counts, keys, "left")
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    return out.select(
        *keys,
        n.alias("n_rows"),
        F.when(n == 0, "NOT_FOUND").otherwise("OK").alias("status"),
        F.when(n == 0, MSG_NOT_FOUND).alias("message"),
    )


def jobs_registered(jobs: DataFrame, registry: DataFrame, key: str = "job_nm") -> DataFrame:
    """Does each job name exist in the registry (flag form of a semi join)."""
    names = registry.select(key).distinct().withColumn("_hit", F.lit(True))
    names = bounded_broadcast(names, CONFIG_MAX_BROADCAST_ROWS, bound_by=[registry], bound_columns=[key])
    return (
        jobs.select(key).distinct()
        .join(names, key, "left")
        .select(key, F.coalesce(F.col("_hit"), F.lit(False)).alias("is_registered"))
    )


def _route_config(configs: Mapping[str, DataFrame], key: str, flag: str) -> DataFrame:
    """One row per (job, prefix): the prefix-tagged rows of every distinct
    configuration table (each scanned once, its prefixes taken from the key) in
    one union, then one aggregate (one shuffle)."""
    fields = {
        "pi": ["trgt_tbl_nm"],
        "pt": ["trgt_tbl_nm"],
        "po": ["expt_data_type", "expt_file_ppty", "expt_file_nm_fmt"],
    }
    all_fields = ROUTE_FIELDS
    tables: dict[int, tuple[DataFrame, list[str]]] = {}
    for prefix, cfg in configs.items():
        tables.setdefault(id(cfg), (cfg, []))[1].append(prefix)
    tagged = None
    for cfg, prefixes in tables.values():
        kind = F.substring(F.col(key), 1, 2)
        part = cfg.where(kind.isin(*prefixes)).select(
            key, kind.alias("_kind"), flag,
            *[F.when(kind.isin(*(p for p in prefixes if f in fields[p])), F.col(f)).alias(f)
              if any(f in fields[p] for p in prefixes) else F.lit(None).cast("string").alias(f)
              for f in all_fields])
        tagged = part if tagged is None else tagged.unionByName(part)
    return config_counts(tagged, [key, "_kind"], flag, all_fields).drop("n_rows")


def attach_routes(df: DataFrame, configs: Mapping[str, DataFrame], key: str = "job_nm",
                  flag: str = "actv_flag") -> DataFrame:
    """R1 + J1: add ``zone``, ``title_nm`` and ``route_error`` to every row.

    ``configs`` maps a prefix (``pi``, ``pt``, ``po``) to its configuration
    table.  Rules:

    * ``pi``/``pt``: zone ``ingt``/``curated``; title is the active row's
      target table ('' when NULL).  A missing, inactive-only or duplicate
      configuration leaves title '' and fills ``route_error``.  (The
      original read the fields from the first of *all* the job's rows, in no
      order, which may be an inactive one; the active row is meant.)
    * ``po``: zone ``outbnd``; title is the container name from the JSON
      properties when the export type is ``cosmos_db``, else the file-name
      format ('' when NULL).  Any failure (bad configuration, malformed JSON,
      missing key) gives zone ``skip`` and title ''.
    * any other prefix: zone '' and title ''.

    The configuration side is one row per (job, prefix), so the left join
    never multiplies rows.  It is broadcast when a bounded count shows it
    small (the run table is then never shuffled, and a hot job costs
    nothing); beyond the bound it is a shuffle join whose skewed partitions
    AQE splits.
    """
    # Each prefix keeps a disjoint part of its table, so a table shared by
    # several prefixes bounds the aggregate once.
    inputs = list({id(c): c for c in configs.values()}.values())
    cfg_all = bounded_broadcast(_route_config(configs, key, flag), CONFIG_MAX_BROADCAST_ROWS,
                                bound_by=inputs, bound_columns=[key, flag, *ROUTE_FIELDS])
    j = df.withColumn("_kind", F.substring(F.col(key), 1, 2))
    r = j.join(cfg_all, [key, "_kind"], "left")
    status = status_of(F.coalesce(F.col("n_active"), F.lit(0)),
                       F.coalesce(F.col("n_inactive"), F.lit(0)))
    ok = status == "OK"
    kind = F.col("_kind")
    po_title = F.when(F.col("expt_data_type") == EXPORT_TO_CONTAINER,
                      container_name("expt_file_ppty")).otherwise(none_to_empty("expt_file_nm_fmt"))
    po_ok = ok & po_title.isNotNull()
    zone = (
        F.when(kind == "pi", ROUTE_ZONES["pi"])
        .when(kind == "pt", ROUTE_ZONES["pt"])
        .when(kind == "po", F.when(po_ok, ROUTE_ZONES["po"]).otherwise(ZONE_SKIP))
        .otherwise("")
    )
    title = (
        F.when(kind.isin("pi", "pt") & ok, none_to_empty("trgt_tbl_nm"))
        .when((kind == "po") & po_ok, po_title)
        .otherwise("")
    )
    err = F.when(kind.isin("pi", "pt") & ~ok, message_of(status))
    return r.select(*[F.col(c) for c in df.columns], zone.alias("zone"), title.alias("title_nm"),
                    err.alias("route_error"))


def route_jobs(jobs: DataFrame, configs: Mapping[str, DataFrame], key: str = "job_nm",
               flag: str = "actv_flag") -> DataFrame:
    """One routing row per distinct job name of ``jobs``."""
    return attach_routes(jobs.select(key).distinct(), configs, key, flag)
