"""Holiday check.

The calendar is a list of dates, small by nature (a few hundred rows a year),
so it is broadcast behind a bounded count: the run table is never shuffled
for this join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.columns import ColumnOrName, _c, weekday_name
from runledger.plans.strategy import bounded_broadcast

# The holiday types the check knows (exact case).
TYPE_WEEKEND = "WEEKEND"
TYPE_HOLIDAY = "HOLIDAY"

CALENDAR_MAX_ROWS = 1_000_000


def is_weekend(d: ColumnOrName) -> Column:
    return F.dayofweek(_c(d)).isin(1, 7)  # Sunday = 1, Saturday = 7


def holiday_flag(hldy_type: ColumnOrName, date_text: ColumnOrName, in_calendar: Column) -> Column:
    """True when a holiday, NULL otherwise (never False).

    WEEKEND: Saturday or Sunday.  HOLIDAY: Saturday, Sunday or in the
    calendar.  Any other text, lower case included: never.  A text that is no
    date is no weekend (``holiday_flags`` reports it as ``is_date``).
    """
    t = _c(hldy_type)
    wk = is_weekend(F.try_to_date(_c(date_text)))
    return F.when((t.isin(TYPE_WEEKEND, TYPE_HOLIDAY) & wk) | ((t == TYPE_HOLIDAY) & in_calendar),
                  F.lit(True))


def with_calendar(df: DataFrame, date_col: str, calendar: DataFrame,
                  calendar_col: str = "dt_en") -> DataFrame:
    """Add ``in_calendar`` (boolean) by a left join on the date text."""
    cal = (
        calendar.select(F.col(calendar_col).alias("_cal_dt")).distinct()
        .withColumn("_in_cal", F.lit(True))
    )
    cal = bounded_broadcast(cal, CALENDAR_MAX_ROWS, bound_by=[calendar],
                            bound_columns=[calendar_col])
    return (
        df.join(cal, df[date_col] == cal["_cal_dt"], "left")
        .withColumn("in_calendar", F.coalesce(F.col("_in_cal"), F.lit(False)))
        .drop("_cal_dt", "_in_cal")
    )


def holiday_flags(df: DataFrame, date_col: str, calendar: DataFrame,
                  types: dict[str, ColumnOrName], calendar_col: str = "dt_en") -> DataFrame:
    """Validity of the date, weekday name (NULL if it is no date) plus one holiday flag per entry of ``types``
    (output column -> holiday type: a column name or a Column such as
    ``F.lit("HOLIDAY")``)."""
    out = with_calendar(df, date_col, calendar, calendar_col)
    cols = [F.try_to_date(F.col(date_col)).isNotNull().alias("is_date"),
            weekday_name(F.try_to_date(F.col(date_col))).alias("wkdy_nm")]
    for name, t in types.items():
        cols.append(holiday_flag(_c(t), date_col, F.col("in_calendar")).alias(name))
    return out.select(*df.columns, *cols)
