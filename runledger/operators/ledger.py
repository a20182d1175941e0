"""The job-run ledger: checks (A2-A4), append (D1-D5), update (D6, D7),
delete (D8, D9), de-duplication (U1), and their parquet sinks.

Transformations take and return DataFrames; values are bound as Columns,
never pasted into SQL text, so there is nothing to escape or inject.  Row
level DML on plain parquet is done by rewriting only the touched partitions
with dynamic partition overwrite (see ``rewrite_partitions``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.plans.strategy import bounded_broadcast
from runledger.session import cut_lineage

# Job statuses the checks look for, and the ledger layout.
STS_RUNNING = "RUNNING"
STS_TRIGGER_RUNNING = "TRIGGER-RUNNING"
STS_SUCCESS = "SUCCESS"
LEDGER_PARTITIONS = ("monoline", "dl_data_dt", "job_nm")
DSR_PARTITIONS = ("dl_data_dt", "job_nm")
ARCHIVE_DEFAULTS = {"expt_sts": "NOT STARTED"}
PARTITION_BATCH = 500


# ------------------------------------------------------------------ A2-A4
def duplicate_runs(log: DataFrame, keys: Sequence[str], status_col: str = "job_sts",
                   statuses: Sequence[str] = (STS_RUNNING,)) -> DataFrame:
    """A2: per key, how many runs are in one of ``statuses``; any -> duplicate."""
    n = F.count_if(F.col(status_col).isin(*statuses)).alias("n_matching")
    return (
        log.groupBy(*keys).agg(n)
        .withColumn("is_duplicate", F.col("n_matching") > 0)
    )


def trigger_run_status(log: DataFrame, keys: Sequence[str], status_col: str = "job_sts") -> DataFrame:
    """A3: fine only with exactly one TRIGGER-RUNNING and no other non-NULL status."""
    s = F.col(status_col)
    return (
        log.groupBy(*keys)
        .agg(F.count_if(s == STS_TRIGGER_RUNNING).alias("n_trigger"),
             F.count_if(s != STS_TRIGGER_RUNNING).alias("n_other"))
        .withColumn("is_ok", (F.col("n_trigger") == 1) & (F.col("n_other") == 0))
    )


def duplicate_updates(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A4: keys an update would hit more than once."""
    return (
        log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


# ------------------------------------------------------------------ D1-D5
def align_to(rows: DataFrame, schema: T.StructType, defaults: Mapping[str, Column | str] | None = None,
             swap_quotes: bool = False) -> DataFrame:
    """New rows in the target's column order and types.

    A column the rows lack becomes its default or NULL; falsy text (NULL or
    '') becomes NULL and then takes the default.  ``swap_quotes`` turns single
    quotes into double quotes in text, as the multi-row insert did.  Numeric
    zero is kept (only text is 'falsy' here).
    """
    defaults = dict(defaults or {})
    have = set(rows.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            v = F.col(f.name)
            if isinstance(rows.schema[f.name].dataType, T.StringType):
                v = F.nullif(v, F.lit(""))
                if swap_quotes:
                    v = F.translate(v, "'", '"')
        else:
            v = F.lit(None)
        if f.name in defaults:
            d = defaults[f.name]
            v = F.coalesce(v, d if isinstance(d, Column) else F.lit(d))
        cols.append(v.cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def tenant_defaults(tenant: str) -> dict[str, Column]:
    """D3: ``monoline`` is the upper-cased tenant when a row has none."""
    return {"monoline": F.upper(F.lit(tenant))}


def append_rows(ledger: DataFrame, rows: DataFrame, defaults: Mapping[str, Column | str] | None = None,
                swap_quotes: bool = False) -> DataFrame:
    """The ledger after an append, as a DataFrame (the sink is ``write_append``)."""
    return ledger.unionByName(align_to(rows, ledger.schema, defaults, swap_quotes))


# ------------------------------------------------------------------ D6-D9
def _assignment(v) -> Column | None:
    """A Column is a raw expression; a falsy value is dropped; others are literals."""
    if isinstance(v, Column):
        return v
    if not v:
        return None
    return F.lit(str(v))


def tenant_predicate(tenant: str, column: str = "monoline") -> Column:
    """An update only touches rows of its own tenant."""
    return F.col(column) == F.upper(F.lit(tenant))


def update_rows(df: DataFrame, predicate: Column, assignments: Mapping[str, object],
                tenant: str | None = None) -> DataFrame:
    """``SET c = v WHERE predicate``; rows where it is NULL are untouched."""
    pred = predicate if tenant is None else predicate & tenant_predicate(tenant)
    hit = F.coalesce(pred, F.lit(False))
    sets = {c: _assignment(v) for c, v in assignments.items()}
    sets = {c: v for c, v in sets.items() if v is not None}
    return df.select(*[
        F.when(hit, sets[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in sets else F.col(c)
        for c in df.columns
    ])


# Statuses of a key in a table of updates.
UPDATE_OK, UPDATE_NOT_FOUND = "OK", "NOT_FOUND"
UPDATE_CONFLICT, UPDATE_DUPLICATE_ROWS = "CONFLICTING_UPDATES", "DUPLICATE_ROWS"


def keyed_updates(ledger: DataFrame, updates: DataFrame, on: Sequence[str], assign: Sequence[str],
                  tenant: str | None = None, guard: bool = True) -> DataFrame:
    """D6/D7 + A4 in bulk: what a table of updates does to each of its keys.

    ``updates`` has the key columns ``on`` and the columns ``assign`` to set (a falsy
    text sets nothing, as in ``update_rows``).  Per key: ``n_updates``, ``n_rows`` (of
    the ledger; with ``tenant`` of that tenant), the value of each column, and a status:

    * ``NOT_FOUND``: no row has the key (a NULL in a key equals nothing);
    * ``CONFLICTING_UPDATES``: updates of the key set a column to different values,
      so the result would hang on an order that a table does not have (equal ones are one);
    * ``DUPLICATE_ROWS``: with ``guard``, the key has several rows (A4);
    * ``OK``.

    Ledger keys and updates are tagged, unioned and reduced by one aggregate: one
    shuffle, pre-aggregated in every task, no join, so a key that holds a third of
    the ledger sends one row per task.
    """
    on, assign = list(on), list(assign)
    pred = F.lit(True) if tenant is None else F.coalesce(tenant_predicate(tenant), F.lit(False))
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in on])
    values = [F.nullif(F.col(c).cast("string"), F.lit("")).cast(ledger.schema[c].dataType).alias(c) for c in assign]
    rows = ledger.where(pred & known).select(
        *on, *[F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in assign], F.lit(0).alias("_update"))
    both = rows.unionByName(updates.select(*[F.col(k).cast(ledger.schema[k].dataType).alias(k) for k in on],
                                           *values, F.lit(1).alias("_update")))
    g = both.groupBy(*on).agg(
        F.sum("_update").alias("n_updates"), F.count_if(F.col("_update") == 0).alias("n_rows"),
        *[F.max(c).alias(c) for c in assign], *[F.min(c).alias(f"_min_{c}") for c in assign])
    conflict = reduce(lambda x, y: x | y, [F.coalesce(F.col(c) != F.col(f"_min_{c}"), F.lit(False)) for c in assign])
    status = F.when(F.col("n_rows") == 0, UPDATE_NOT_FOUND).when(conflict, UPDATE_CONFLICT)
    if guard:
        status = status.when(F.col("n_rows") > 1, UPDATE_DUPLICATE_ROWS)
    return g.where(F.col("n_updates") > 0).select(
        *on, "n_updates", "n_rows", status.otherwise(UPDATE_OK).alias("status"), *assign)


def apply_updates(ledger: DataFrame, keyed: DataFrame, on: Sequence[str], assign: Sequence[str],
                  tenant: str | None = None) -> DataFrame:
    """The ledger after the updates of the keys whose status is OK (``keyed_updates``:
    one row per key, so the join never multiplies rows).  A column without a value
    is left as it is, and so are rows of other tenants."""
    on, assign = list(on), list(assign)
    new = keyed.where(F.col("status") == UPDATE_OK).select(*on, *[F.col(c).alias(f"_new_{c}") for c in assign])
    hit = F.lit(True) if tenant is None else F.coalesce(tenant_predicate(tenant), F.lit(False))
    out = ledger.join(new, on, "left")
    return out.select(*[
        F.when(hit, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in assign else F.col(c)
        for c in ledger.columns])


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """A row whose predicate is NULL is kept, as in SQL DELETE."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] = ("job_nm",),
                max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Drop every row of the given jobs (anti join against the key set;
    the key set is broadcast when a bounded count shows it small)."""
    k = bounded_broadcast(keys.select(*on).distinct(), max_broadcast_rows, bound_by=[keys.select(*on)])
    return df.join(k, list(on), "left_anti")


def unique_rows(df: DataFrame) -> DataFrame:
    """Distinct rows (NULLs equal each other); no order is kept."""
    return df.distinct()


# ------------------------------------------------------------------ sinks
def create_ledger(spark: SparkSession, name: str, schema: T.StructType,
                  partitions: Sequence[str] = LEDGER_PARTITIONS) -> None:
    """A managed, partitioned parquet table (partition columns last)."""
    empty = spark.createDataFrame([], schema)
    order = [f.name for f in schema.fields if f.name not in partitions] + list(partitions)
    empty.select(*order).write.format("parquet").partitionBy(*partitions).saveAsTable(name)


def table_partitions(spark: SparkSession, name: str) -> list[str]:
    """The partition columns of a table, as the catalog has them."""
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def clustered(df: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of a partition next to each other before a partitioned write, so a
    write makes files by data, not tasks x partitions; AQE splits a partition
    that holds much of the data over several tasks."""
    return df.hint("rebalance", *(F.col(p) for p in partitions)) if partitions else df


def write_append(spark: SparkSession, name: str, rows: DataFrame,
                 defaults: Mapping[str, Column | str] | None = None, swap_quotes: bool = False) -> None:
    """Append rows aligned to the table (position-based insert)."""
    aligned = align_to(rows, spark.table(name).schema, defaults, swap_quotes)
    clustered(aligned, table_partitions(spark, name)).write.insertInto(name)


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    """Overwrite only the partitions written, within the block."""
    option = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "dynamic")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(option)
        else:
            spark.conf.set(option, before)


def _named(row, parts: Sequence[str]) -> Column:
    """The rows of one partition; a NULL value names the NULL partition."""
    tests = [F.col(p).isNull() if row[p] is None else F.col(p) == F.lit(row[p]) for p in parts]
    return reduce(lambda x, y: x & y, tests)


def rewrite_partitions(spark: SparkSession, name: str, touched: Column | DataFrame, change) -> None:
    """Persist a row-level change by rewriting only the partitions it touches.

    ``touched`` selects the rows the change may alter (a predicate), or is a
    DataFrame with the partition columns of what it may alter; ``change`` maps
    a DataFrame of the table to its new content and must not move rows between
    partitions.  The layout is what the catalog says.  A table without
    partitions is rewritten as a whole.

    The touched partitions (NULL ones included) are kept in the shared
    checkpoint folder and taken ``PARTITION_BATCH`` at a time.  A batch is
    named by literal values, so the scan lists only its folders whatever the
    predicate is about.  Its new rows are checkpointed (the write replaces the
    files being read) and overwrite those partitions; partitions that the
    change emptied are dropped by name, since an overwrite never sees them.
    """
    parts = table_partitions(spark, name)
    table = spark.table(name)
    if not parts:
        cut_lineage(change(table).select(*table.columns)).write.insertInto(name, overwrite=True)
        return
    if isinstance(touched, DataFrame):
        keys = touched.select(*parts).distinct()
    else:
        keys = table.where(F.coalesce(touched, F.lit(False))).select(*parts).distinct()
    keys = cut_lineage(keys).toLocalIterator()
    while batch := list(islice(keys, PARTITION_BATCH)):
        scope = table.where(reduce(lambda x, y: x | y, [_named(r, parts) for r in batch]))
        new = cut_lineage(change(scope).select(*table.columns))
        with _dynamic_overwrite(spark):
            clustered(new, parts).write.insertInto(name, overwrite=True)
        left = {tuple(r) for r in new.select(*parts).distinct().collect()}   # at most the batch
        gone = [r for r in batch if tuple(r) not in left]
        if gone:
            specs = ", ".join("PARTITION (" + ", ".join(
                f"{p} = " + ("null" if r[p] is None else f"'{_sql_text(r[p])}'") for p in parts) + ")"
                for r in gone)
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")
        spark.catalog.refreshTable(name)


def _sql_text(v) -> str:
    return str(v).replace("\\", "\\\\").replace("'", "\\'")


def write_update(spark: SparkSession, name: str, predicate: Column, assignments: Mapping[str, object],
                 tenant: str | None = None) -> None:
    """D6/D7 persisted; the assignments may not change partition columns
    (falsy assignments are dropped first, as in ``update_rows``)."""
    effective = {k for k, v in assignments.items() if _assignment(v) is not None}
    moved = effective & set(table_partitions(spark, name))
    if moved:
        raise ValueError(f"update may not change partition columns: {sorted(moved)}")
    pred = predicate if tenant is None else predicate & tenant_predicate(tenant)
    rewrite_partitions(spark, name, pred, lambda df: update_rows(df, pred, assignments))


def write_updates(spark: SparkSession, name: str, updates: DataFrame, on: Sequence[str], assign: Sequence[str],
                  tenant: str | None = None, guard: bool = True) -> DataFrame:
    """D6/D7 + A4 persisted for a table of updates; returns the report of
    ``keyed_updates``.  Keys that are not OK change nothing.  The report is
    checkpointed first (the write replaces the files it was counted from), and the
    partitions to rewrite come from it where the key holds the partition columns,
    so the ledger is then read in those partitions only."""
    parts = table_partitions(spark, name)
    moved = set(assign) & (set(parts) | set(on))
    if moved:
        raise ValueError(f"update may not change key or partition columns: {sorted(moved)}")
    table = spark.table(name)
    report = cut_lineage(keyed_updates(table, updates, on, assign, tenant, guard))
    ok = report.where(F.col("status") == UPDATE_OK)
    if not ok.isEmpty():
        if set(parts) <= set(on):
            touched = ok.select(*parts)
        else:
            touched = table.join(ok.select(*on), list(on), "left_semi").select(*parts)
        rewrite_partitions(spark, name, touched, lambda df: apply_updates(df, report, on, assign, tenant))
    return report


def write_delete(spark: SparkSession, name: str, predicate: Column) -> None:
    """D8/D9 persisted."""
    rewrite_partitions(spark, name, predicate, lambda df: delete_where(df, predicate))


def assert_no_duplicate_update(log: DataFrame, predicate: Column) -> None:
    """A4 guard before an update: raise when it would hit more than one row."""
    n = log.agg(F.count_if(predicate).alias("n")).first().n
    if n > 1:
        raise RuntimeError("[System Error] Duplicate updating log found")
