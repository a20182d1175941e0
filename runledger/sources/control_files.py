"""Control-file source.

A control file is a small delimited file whose data line carries a row count
at a given field.  All control files of a glob are read in one job, one row
per file (``wholetext``), and the count is taken with CSV parsing rules
(quotes respected, short lines padded with NULL), then guarded by a strict
integer pattern before the cast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.sources.manifests import list_files

# Python's int() accepts surrounding blanks and a sign; nothing else here.
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"


@dataclass(frozen=True)
class ControlSpec:
    """Header flag, delimiter and 1-based count position; defaults: no
    header, ``|``, 6."""

    header: bool = False
    delimiter: str = "|"
    position: int = 6

    def __post_init__(self):
        if not self.delimiter:
            raise ValueError("control delimiter must not be empty")
        if int(self.position) < 1:
            raise ValueError("control count position starts at 1")

    @classmethod
    def from_dict(cls, spec: dict) -> "ControlSpec":
        """Codes as stored in job configuration: ctl_header '0'/'1',
        ctl_delimiter, ctl_cnt_pstn.  A missing or unknown header code means
        no header; a missing delimiter or position takes the default."""
        header = {"0": False, "1": True}.get(str(spec.get("ctl_header")), False)
        delim = spec.get("ctl_delimiter") or "|"
        pos = spec.get("ctl_cnt_pstn") or 6
        try:
            pos = int(pos)
        except (TypeError, ValueError) as e:
            raise ValueError(f"Control position is not an integer: {spec}") from e
        return cls(header, delim, pos)


def field_at(line: Column, spec: ControlSpec) -> Column:
    """Field ``spec.position`` (1-based) of a delimited line, CSV rules."""
    n = spec.position
    schema = ", ".join(f"c{i} string" for i in range(n))
    parsed = F.from_csv(line, schema, {"sep": spec.delimiter, "mode": "PERMISSIVE"})
    return parsed[f"c{n - 1}"]


def guarded_count(text: Column) -> Column:
    """Text -> bigint when it is an integer, else NULL."""
    return F.when(text.rlike(INTEGER_PATTERN), F.trim(text).try_cast("bigint"))


def control_counts_of_lines(df: DataFrame, line_col: str, spec: ControlSpec = ControlSpec(),
                            keep=()) -> DataFrame:
    """S6 over a column that already holds each file's data line."""
    raw = field_at(F.col(line_col), spec)
    cnt = guarded_count(raw)
    return df.select(*keep, raw.alias("ctl_field"), cnt.alias("ctl_count"),
                     cnt.isNotNull().alias("is_valid"))


def plain_path(path: Column) -> Column:
    """The path as it was given: the metadata column holds it URL-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_control_files(spark: SparkSession, glob: str, spec: ControlSpec = ControlSpec(),
                       empty_files: bool = True) -> DataFrame:
    """S6 over files: one row per file with its count (NULL when not an integer, or
    when the file holds no byte: Spark's scan skips those, ``list_files`` has them;
    without ``empty_files`` they are left out, for stores that it cannot open)."""
    files = spark.read.text(glob, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value"))
    # blank lines are skipped, as the CSV reader does
    lines = F.filter(F.split(F.col("value"), r"\r?\n"), lambda x: F.trim(x) != "")
    data_line = F.get(lines, F.lit(1 if spec.header else 0))
    found = files.select("path", data_line.alias("line"))
    if empty_files:
        empty = list_files(spark, glob).where(F.col("file_size") == 0)
        found = found.unionByName(empty.select("path", F.lit(None).cast("string").alias("line")))
    return control_counts_of_lines(found, "line", spec, keep=("path",))
