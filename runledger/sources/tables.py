"""Table scans.

Every reader returns a lazy DataFrame; filters and projections applied later
reach the parquet scan (``PushedFilters`` / ``ReadSchema`` in the plan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from runledger.plans.strategy import ensure_parallelism
from runledger.session import table_path

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str,
               spread_by: Sequence[str] | None = None, spread: int | None = None) -> DataFrame:
    """One of the driver's parquet tables.

    With ``spread`` the rows are dealt into that many partitions by a hash of
    the row-identity columns ``spread_by``: for CPU-heavy work over a small
    file that is read as one split.  Off unless asked for.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    return df if spread is None else ensure_parallelism(df, spread_by or [], spread)


def scan(spark: SparkSession, name: str, where: Column | None = None) -> DataFrame:
    """A catalog table by name, optionally filtered by a Column predicate.

    The predicate is a Column, never SQL text glued from values, so it cannot
    be injected into and Catalyst can push it to the scan.
    """
    df = spark.table(name)
    return df if where is None else df.where(where)


def column_names(spark: SparkSession, name: str) -> list[str]:
    """Column order of a catalog table (metadata only, no job)."""
    return spark.table(name).columns
