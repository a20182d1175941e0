"""Join-strategy helpers.

Broadcasting is only ever done behind a size check.  Two forms:

* ``bounded_broadcast``: for a side that is small by nature (holiday
  calendar, per-job configuration aggregate, job registry, key lists), count
  and size it or the inputs that bound it; broadcast when within the bound, otherwise return the DataFrame unchanged
  so Spark plans a shuffle join.  The large side (the run ledger) is then
  never shuffled for a lookup.
* sides derived from the large tables themselves (keys computed from runs)
  carry no hint and get no up-front count: AQE measures them at run time and
  switches to a broadcast join only below
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``; above it the
  sort-merge join stays, with skewed partitions split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def _row_bytes(df: DataFrame):
    """Bytes of a row: text and binary by length, nested values by the length
    of their JSON text, everything else as 8 bytes."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("bigint")


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                      bound_by: Sequence[DataFrame] | None = None,
                      max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
                      bound_columns: Sequence[str] | None = None) -> DataFrame:
    """Broadcast ``df`` only when it provably has at most ``max_rows`` rows
    and ``max_bytes`` bytes of data.

    The proof is one aggregate (each task sends one row) that counts rows and
    sums their byte sizes, either over ``df`` itself or, with ``bound_by``,
    over inputs that bound it (an aggregate has no more rows, and no more bytes
    of its input columns, than its input), which avoids computing ``df`` twice.
    Only the columns that the side's values come from are read:
    ``bound_columns``, or else those that ``df`` has.  Otherwise ``df`` is
    returned unhinted and Spark plans a shuffle join.
    """
    sources = [df] if bound_by is None else list(bound_by)
    wanted = df.columns if bound_columns is None else bound_columns
    rows = size = 0
    for src in sources:
        keep = [c for c in wanted if c in src.columns]
        measured = src.select(*keep) if keep else src
        extra = 8 * len(df.columns)  # fixed-width room for counters and tags
        r = measured.agg(F.count(F.lit(1)).alias("n"),
                         F.sum(_row_bytes(measured) + F.lit(extra)).alias("b")).collect()[0]
        rows += r.n
        size += r.b or 0
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def ensure_parallelism(df: DataFrame, keys: Sequence[str], partitions: int) -> DataFrame:
    """Spread rows over ``partitions`` tasks by a hash of ``keys``.

    For CPU-heavy work per row (JSON parsing, encoding) over a small file that
    Spark reads as one split.  It is a full shuffle and its caller asks for it;
    nothing is decided from the cluster's size.  ``keys`` should identify rows
    (unique or nearly so), never a grouping key: a hot group would land in one
    task.
    """
    return df.repartition(partitions, *keys)
