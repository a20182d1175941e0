"""Scalar Column functions.

Each function takes Columns and returns a Column built from built-in Spark
SQL functions only, so it runs inside whole-stage codegen with no Python in
the task.  Where the original worked on one Python value on the driver, the
same rule is applied here to a whole column.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- X1, X2
def weekday_name(d: ColumnOrName) -> Column:
    """Full English weekday name of a date (``Saturday``)."""
    return F.date_format(_c(d), "EEEE")


# The three text forms of a timestamp used by the job logs.
TIME_FORMATS = {
    "date": "yyyy-MM-dd",
    "datetime": "yyyy-MM-dd HH:mm:ss.SSS",
    "datetimelog": "yyyyMMdd_HHmmss",
}


def time_text(ts: ColumnOrName | None = None, kind: str = "datetime") -> Column:
    """Timestamp as text; milliseconds are cut, not rounded; unknown kind -> ''."""
    ts = F.current_timestamp() if ts is None else _c(ts)
    fmt = TIME_FORMATS.get(kind)
    return F.lit("") if fmt is None else F.date_format(ts, fmt)


# ---------------------------------------------------------------- X3, X4, X5
def log_line(level: ColumnOrName, msg: ColumnOrName, ts: ColumnOrName | None = None) -> Column:
    """``[yyyy-MM-dd HH:mm:ss.SSS] [LEVEL] message``."""
    lvl = F.lit(level) if isinstance(level, str) else level
    return F.concat(F.lit("["), time_text(ts, "datetime"), F.lit("] ["), lvl, F.lit("] "), _c(msg))


def falsy_to_null(c: ColumnOrName) -> Column:
    """Text that is NULL or empty becomes NULL (the 'falsy' rule for text)."""
    return F.nullif(_c(c).cast("string"), F.lit(""))


def info_lines(pairs: list[tuple[str, ColumnOrName]], ts: ColumnOrName | None = None) -> Column:
    """One ``[ts] [INFO] key: value`` line per pair, joined by newlines.

    A NULL or empty value is shown as ``NULL``.
    """
    lines = [
        log_line(
            "INFO",
            F.concat(F.lit(f"{k}: "), F.coalesce(falsy_to_null(v), F.lit("NULL"))),
            ts,
        )
        for k, v in pairs
    ]
    return F.array_join(F.array(*lines), "\n")


def none_to_empty(c: ColumnOrName) -> Column:
    """NULL -> '' and everything else to text."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


# ---------------------------------------------------------------- X7
# The JSON reader is lenient unless told otherwise: it takes single quotes, raw
# control characters in strings, and stops at the end of the first value.
STRICT_JSON = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowUnquotedControlChars": "false",
               "allowUnquotedFieldNames": "false", "allowComments": "false"}
_JSON_SPACE = " \t\r\n"


def _closed(t: Column, open_: str, close: str) -> tuple[Column, Column]:
    """The text as the first element of an array, and the mark that must come out as
    the second one: a value cut short or followed by more text breaks the pair.
    The mark depends on the text, so no text can hold its own."""
    mark = F.hex(F.xxhash64(t))
    return F.concat(F.lit("["), t, F.lit("," + open_ + '"'), mark, F.lit('"' + close + "]")), mark


def is_json(c: ColumnOrName) -> Column:
    """Is the text one whole, strictly written JSON value?  NULL -> false."""
    t = F.btrim(_c(c), F.lit(_JSON_SPACE))
    text, mark = _closed(t, "", "")
    pair = F.from_json(text, "array<string>", STRICT_JSON)
    whole = F.transform(F.array(pair), lambda p: (F.size(p) == 2) & (F.get(p, F.lit(1)) == mark))
    return F.coalesce(F.get(whole, F.lit(0)), F.lit(False))


def is_json_object(c: ColumnOrName) -> Column:
    """Is the text one whole, strictly written JSON object?  NULL -> false."""
    return F.coalesce(F.btrim(_c(c), F.lit(_JSON_SPACE)).startswith("{"), F.lit(False)) & is_json(c)


def strict_object(c: ColumnOrName, fields: str) -> Column:
    """``array<struct<ok, doc>>`` of one element: is the text one whole, strictly
    written JSON object, and its ``fields`` (DDL).  One parse; meant for ``inline``,
    which as a generator keeps the optimizer from parsing once per field used."""
    t = F.btrim(_c(c), F.lit(_JSON_SPACE))
    text, mark = _closed(t, '{"_end":', "}")
    pair = F.from_json(text, f"array<struct<{fields}, _end: string>>", STRICT_JSON)
    return F.transform(F.array(pair), lambda p: F.struct(
        F.coalesce((F.size(p) == 2) & (F.get(p, F.lit(1))["_end"] == mark) & t.startswith("{"), F.lit(False)).alias("ok"),
        F.get(p, F.lit(0)).alias("doc")))


def json_path(c: ColumnOrName, path: str) -> Column:
    """A JSON path out of a text column; malformed JSON or a missing key -> NULL."""
    return F.when(is_json(c), F.get_json_object(_c(c), path))


def container_name(expt_file_ppty: ColumnOrName) -> Column:
    """The container of a valid properties object (of a repeated key the last
    value counts); '' for a JSON null; anything else -> NULL."""
    c = _c(expt_file_ppty)
    parsed = F.from_json(c, "trgt_container_nm string", STRICT_JSON)["trgt_container_nm"]
    named = F.array_contains(F.json_object_keys(c), "trgt_container_nm")
    return F.when(is_json_object(c) & named, F.coalesce(parsed, F.lit("")))


def html_view_content(doc: ColumnOrName) -> Column:
    return json_path(doc, "$.views[0].content")


# ---------------------------------------------------------------- L2
_SPAN, _HALF = Decimal(1 << 64), Decimal(1 << 63)


def pack_order(*parts: tuple[ColumnOrName, int]) -> Column:
    """Order columns with known bounds as one long, the first one highest: each part
    is (column, bits) with values from 0 to 2**bits - 1; 62 bits in all."""
    if sum(bits for _, bits in parts) > 62:
        raise ValueError("the order columns need more than 62 bits")
    out = None
    for c, bits in parts:
        c = _c(c).cast("bigint")
        out = c if out is None else F.shiftleft(out, bits).bitwiseOR(c)
    return out


def last_value(order: ColumnOrName, value: ColumnOrName) -> Column:
    """Aggregate input for the last value: ``unpack_value(max(last_value(...)))`` is the
    value of the highest order, of ties the larger.  Order (0 to 2**62 - 1) and value
    (any bigint) share one decimal, a fixed-width buffer, so the aggregate hashes
    where ``max_by`` over a struct has to sort.  NULL in either -> NULL, skipped."""
    o = _c(order).cast("decimal(19,0)") * F.lit(_SPAN)
    return (o + (_c(value).cast("decimal(20,0)") + F.lit(_HALF))).cast("decimal(38,0)")


def unpack_value(packed: Column) -> Column:
    return (packed % F.lit(_SPAN) - F.lit(_HALF)).cast("bigint")


# ---------------------------------------------------------------- X8
def b64_encode(c: ColumnOrName, charset: str = "UTF-8") -> Column:
    """Base64 of the text's bytes in ``charset``, one line.

    Spark's ``base64`` may break long output into 76-character lines; the
    breaks are removed so the text equals a plain single-line encoder's.
    """
    return F.translate(F.base64(F.encode(_c(c), charset)), "\r\n", "")


def b64_decode(c: ColumnOrName, charset: str = "UTF-8") -> Column:
    return F.decode(F.unbase64(_c(c)), charset)


# ---------------------------------------------------------------- X9
def compact_date(d: ColumnOrName) -> Column:
    """``yyyy-MM-dd`` text -> ``yyyyMMdd`` text."""
    return F.replace(_c(d).cast("string"), F.lit("-"), F.lit(""))


def marker_file_name(title: ColumnOrName, job_nm: ColumnOrName, data_dt: ColumnOrName,
                     ts_text: ColumnOrName) -> Column:
    """``lower(title).job.yyyymmdd.ts.success``; NULL in, NULL out."""
    return F.concat(
        F.lower(_c(title)), F.lit("."), _c(job_nm), F.lit("."), compact_date(data_dt),
        F.lit("."), _c(ts_text), F.lit(".success"),
    )


def marker_match_key(title: ColumnOrName, job_nm: ColumnOrName, data_dt: ColumnOrName) -> Column:
    """``lower(title).job.yyyymmdd``; an empty title gives ``.job.yyyymmdd``."""
    return F.concat(F.lower(_c(title)), F.lit("."), _c(job_nm), F.lit("."), compact_date(data_dt))


def marker_folder(root: ColumnOrName, tenant: ColumnOrName, zone: ColumnOrName,
                  data_dt: ColumnOrName) -> Column:
    """``<root>/<tenant>/evtg/<zone>/<yyyymmdd>/``."""
    return F.concat(
        _c(root), F.lit("/"), _c(tenant), F.lit("/evtg/"), _c(zone), F.lit("/"),
        compact_date(data_dt), F.lit("/"),
    )


# ---------------------------------------------------------------- X10
def predicate_value(text: ColumnOrName, column_name: str) -> Column:
    """First ``<column_name> ='value'`` in a logged predicate, else NULL.

    Exactly one space before ``=`` and none after, as the logs are written.
    """
    pattern = re.escape(column_name) + " ='(.*?)'"
    return F.nullif(F.regexp_extract(_c(text), pattern, 1), F.lit(""))


# ---------------------------------------------------------------- X11, X12
def run_id(prefix: ColumnOrName | None = None) -> Column:
    """``<prefix>_<uuid>``; prefix ``MANUAL`` when NULL or empty."""
    p = F.lit(None).cast("string") if prefix is None else _c(prefix)
    return F.concat(F.coalesce(falsy_to_null(p), F.lit("MANUAL")), F.lit("_"), F.expr("uuid()"))


def exec_user() -> Column:
    return F.coalesce(F.expr("current_user()"), F.lit(""))


# ---------------------------------------------------------------- X13
def html_file_path(location: ColumnOrName, prefix: ColumnOrName, root_run_id: ColumnOrName,
                   job_id: ColumnOrName, run_id_: ColumnOrName) -> Column:
    """``<location>/<prefix>_<root run>_<job>_<run>.HTML``."""
    return F.concat(
        _c(location), F.lit("/"), _c(prefix), F.lit("_"), _c(root_run_id).cast("string"),
        F.lit("_"), _c(job_id).cast("string"), F.lit("_"), _c(run_id_).cast("string"),
        F.lit(".HTML"),
    )


# ---------------------------------------------------------------- R2
# Database-name fragment -> (workspace, main source system),
# first hit wins in this order; no hit -> OTHERX / MOBIUS.
WORKSPACE_RULES = [
    ("cardx", "CARDX", "MOBIUS"),
    ("card2", "CARDX", "MOBIUS"),
    ("autox", "AUTOX", "MOBIUS"),
    ("dl", "SCB", "RM"),
]
WORKSPACE_DEFAULT = ("OTHERX", "MOBIUS")


def _first_hit(db: Column, pick: int) -> Column:
    low = F.lower(db)
    expr = None
    for frag, *vals in WORKSPACE_RULES:
        cond = low.contains(frag)
        expr = F.when(cond, vals[pick]) if expr is None else expr.when(cond, vals[pick])
    return expr.otherwise(WORKSPACE_DEFAULT[pick])


def workspace(db_nm: ColumnOrName) -> Column:
    return _first_hit(_c(db_nm), 0)


def main_source_system(db_nm: ColumnOrName) -> Column:
    return _first_hit(_c(db_nm), 1)
