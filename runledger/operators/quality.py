"""Configuration checks (V1-V5), re-aimed from 'one column, one collect' to
one pass over the whole table.

Every check returns a violation report instead of raising at the first bad
value.  The per-value checks (V2-V4) share one shape:

    column_name | bad_value | reason | n_rows

built by turning each checked column into (name, value, reason) entries,
keeping the bad ones and counting them with a partial (map-side) aggregate,
so the shuffle carries one row per distinct bad value per task, never the
table.  ``assert_clean`` turns any report into an exception on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.columns import ColumnOrName, _c
from runledger.plans.strategy import bounded_broadcast

# The reasons, worded as the original messages.
REASON_YN = "format should be Y or N"
REASON_UPPER = "format should be upper case"
REASON_PATH = "format should end with / or \\"
REASON_NOT_IN_LIST = "is not in list"


def is_falsy(df: DataFrame, name: str) -> Column:
    """NULL, empty text, the text NULL in any case, 0 or false, by column type."""
    c = F.col(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "") | (F.upper(c) == "NULL")
    if isinstance(dtype, T.NumericType):
        return c.isNull() | (c == 0)
    if isinstance(dtype, T.BooleanType):
        return c.isNull() | ~c
    return c.isNull()


def is_blank(c: Column) -> Column:
    """NULL or empty text: the values the per-value checks skip."""
    return c.isNull() | (c.cast("string") == "")


# ------------------------------------------------------------------ V1
def required_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V1: columns that hold a falsy value in any row, with the number of rows.

    One aggregate over the table (one scan, one tiny shuffle) for all columns.
    """
    counts = df.agg(
        *[F.count_if(is_falsy(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("n_rows"))
            for i, c in enumerate(columns)
        ]
    )
    return (
        counts.select(F.explode(entries).alias("v"))
        .select("v.column_name", "v.n_rows")
        .where(F.col("n_rows") > 0)
    )


# ------------------------------------------------------------------ V2-V4
def _value_report(df: DataFrame, checks: Iterable[tuple[str, Column]]) -> DataFrame:
    """(column_name, value, reason) per row and checked column; keep reasons."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(name).cast("string").alias("bad_value"),
                reason.alias("reason"),
            )
            for name, reason in checks
        ]
    )
    return (
        df.select(F.explode(entries).alias("v"))
        .select("v.column_name", "v.bad_value", "v.reason")
        .where(F.col("reason").isNotNull())
        .groupBy("column_name", "bad_value", "reason")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def flag_reason(c: ColumnOrName) -> Column:
    """NULL when fine or blank; else why the Y/N flag is wrong."""
    v = _c(c).cast("string")
    return (
        F.when(is_blank(v), F.lit(None).cast("string"))
        .when(~F.upper(v).isin("Y", "N"), REASON_YN)
        .when(~v.isin("Y", "N"), REASON_UPPER)
    )


def flag_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V2: Y/N flag columns; blank values are skipped."""
    return _value_report(df, [(c, flag_reason(c)) for c in columns])


def path_reason(c: ColumnOrName) -> Column:
    v = _c(c).cast("string")
    last = F.substring(v, -1, 1)
    return F.when(~is_blank(v) & ~last.isin("/", "\\"), REASON_PATH)


def path_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V3: path columns must end in ``/`` or ``\\``; blank values are skipped.

    Every row is checked (the original looked at the first row only).
    """
    return _value_report(df, [(c, path_reason(c)) for c in columns])


def value_reason(c: ColumnOrName, allowed: Sequence[str]) -> Column:
    """Allowed-value rule.  The list holds the upper-case spellings:

    * upper-cased value not in the list -> 'is not in list' (so with a
      lower-case list even an exact value is reported; NULL is not in list);
    * upper-cased value in the list but the value itself not -> 'format
      should be upper case';
    * otherwise fine.

    The lists are configuration-sized, so they stay literal ``IN`` lists
    inside the generated code.
    """
    v = _c(c).cast("string")
    allowed = list(allowed)
    return (
        F.when(~F.coalesce(F.upper(v).isin(*allowed), F.lit(False)), REASON_NOT_IN_LIST)
        .when(~v.isin(*allowed), REASON_UPPER)
    )


def value_violations(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """V4: each column against its list of allowed values."""
    return _value_report(df, [(c, value_reason(c, vals)) for c, vals in allowed.items()])


def value_violations_from(df: DataFrame, columns: Sequence[str], allowed: DataFrame) -> DataFrame:
    """V4 with the lists in a table: ``allowed`` has column_name and allowed_value.

    The same report as ``value_violations`` with those lists, for lists of any
    length.  Checked columns are unpivoted and counted first, so the lists meet each
    distinct value once; two one-to-one joins then look the value up as it is and
    upper-cased.  The lists are broadcast within a checked bound, else both sides are
    shuffled by (column, value).  A NULL value equals nothing in a list.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("bad_value"))
                        for c in columns])
    found = (df.select(F.explode(entries).alias("v")).select("v.column_name", "v.bad_value")
             .groupBy("column_name", "bad_value").agg(F.count(F.lit(1)).alias("n_rows")))
    lists = allowed.where(F.col("column_name").isin(*columns)).select(
        "column_name", F.col("allowed_value").cast("string").alias("_value")).distinct()
    lists = bounded_broadcast(lists, bound_by=[allowed], bound_columns=["column_name", "allowed_value"])
    # Both look-ups join the same list by the same columns, so Spark broadcasts it once.
    out = found.withColumn("_upper", F.upper("bad_value"))
    for at, value in (("_up", "_upper"), ("_as", "bad_value")):
        named = lists.select(F.col("column_name").alias(f"{at}_c"), F.col("_value").alias(f"{at}_v"))
        out = out.join(named, (out["column_name"] == named[f"{at}_c"]) & (out[value] == named[f"{at}_v"]), "left")
    reason = F.when(F.col("_up_v").isNull(), REASON_NOT_IN_LIST).when(F.col("_as_v").isNull(), REASON_UPPER)
    return out.select("column_name", "bad_value", reason.alias("reason"), "n_rows").where(F.col("reason").isNotNull())


# ------------------------------------------------------------------ V5
def business_date(c: ColumnOrName) -> Column:
    """Business date text -> DATE, or NULL when invalid.

    With a ``-``: year-month-day, one- or two-digit month and day.  Without:
    exactly eight digits ``yyyyMMdd``.
    """
    v = _c(c)
    return (
        F.when(v.contains("-"), F.try_to_date(v, "yyyy-M-d"))
        .when(v.rlike("^[0-9]{8}$"), F.try_to_date(v, "yyyyMMdd"))
    )


def business_dates(df: DataFrame, column: str, key: Sequence[str] = ()) -> DataFrame:
    d = business_date(column)
    return df.select(*key, F.col(column), d.alias("bsns_date"), d.isNotNull().alias("is_valid"))


# ------------------------------------------------------------------ raising
def assert_clean(report: DataFrame, what: str = "configuration") -> None:
    """Raise ValueError with every violation.  The report has one row for each
    distinct (column, value, rule), counted, so its size is that of the
    configuration's bad values, not of its rows."""
    rows = report.collect()
    if rows:
        raise ValueError(f"[Value Error] Incorrect value found in {what}", [r.asDict() for r in rows])
