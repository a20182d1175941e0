"""Copy reconciliation.

The original fetched one run's activity report and listed files one by one
on the driver.  Here the reports are a table of JSON documents, one per run
(``parse_reports``) or one per activity (``parse_activities``), and the file
listings are tables of (name, size).  The checks become one parse per document
and partial aggregates per run or per file over tagged unions of both sides:
no join, so no pair explosion when a name repeats, and a NULL run is a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.columns import (
    ColumnOrName, _c, is_json_object, last_value, strict_object, unpack_value,
)

# The fields of one activity in a copy service's run report.
ACTIVITY_FIELDS = ["activityType", "activityName", "output"]
OUTPUT_FIELDS = ["filesRead", "filesWritten", "dataRead", "dataWritten", "itemName", "size"]
OUTPUT_COLUMNS = ["files_read", "files_written", "data_read", "data_written", "item_name", "item_size"]
OUTPUT_NUMERIC = {"files_read", "files_written", "data_read", "data_written", "item_size"}

# Activity types and file statuses.
COPY = "Copy"
GET_METADATA = "GetMetadata"
MATCH, SIZE_MISMATCH = "MATCH", "SIZE_MISMATCH"
MISSING_IN_SOURCE, MISSING_IN_TARGET = "MISSING_IN_SOURCE", "MISSING_IN_TARGET"
DUPLICATE = "DUPLICATE"


# A whole run report: an object with the activities in order under ``value``.
REPORT_FIELDS = "value: array<struct<" + ", ".join(f"{f}: string" for f in ACTIVITY_FIELDS) + ">>"


def is_malformed(doc: Column) -> Column:
    """Text that is no strictly written JSON object, or one with more text after it."""
    return ~is_json_object(doc)


def _numbers(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).try_cast("bigint").alias(c) if c in OUTPUT_NUMERIC else F.col(c)
                              for c in OUTPUT_COLUMNS])


def parse_reports(df: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Whole run reports, one document per run -> one row per activity.

    ``activity_seq`` is the place in the document's ``value`` list, so the order
    of activities needs no column of its own.  Each document is parsed once, and
    each ``output`` object once more for its fields.  A document that is no whole,
    strict JSON object with a list of objects under ``value`` gives one row with
    ``is_malformed``; so does an activity without ``activityType``.  An empty list
    gives one row without activity, so the run still counts as reported.
    """
    keep = [c for c in df.columns if c != doc_col]
    docs = df.select(*keep, F.inline(strict_object(doc_col, REPORT_FIELDS)).alias("_ok", "_doc"))
    good = F.col("_ok") & F.col("_doc.value").isNotNull()
    # One generator over a value that is NULL for a bad document and empty for a
    # report without activities; both leave one row.
    each = docs.select(*keep, good.alias("_good"), F.posexplode_outer(F.when(good, F.col("_doc.value")))
                       .alias("activity_seq", "_a"))
    bad = ~F.col("_good") | (F.col("activity_seq").isNotNull() & F.col("_a.activityType").isNull())
    top = [*keep, "activity_seq", "is_malformed", "activity_type", "activity_name"]
    flat = each.select(
        *keep, F.col("activity_seq").cast("bigint").alias("activity_seq"), bad.alias("is_malformed"),
        F.col("_a.activityType").alias("activity_type"), F.col("_a.activityName").alias("activity_name"),
        F.col("_a.output").alias("_output"))
    return _numbers(flat.select(*top, F.json_tuple(F.col("_output"), *OUTPUT_FIELDS).alias(*OUTPUT_COLUMNS)), top)


def parse_activities(df: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Flatten JSON documents of one activity each; malformed text -> NULL fields.

    ``json_tuple`` parses each document once (and its ``output`` object once),
    and as a generator it keeps later filters on the parsed fields above the
    parse.  A ``from_json`` struct would be split by the optimizer into one
    parse per field used, and filters on it pushed down and parsed again.
    """
    keep = [c for c in df.columns if c != doc_col]
    top = df.select(*keep, is_malformed(F.col(doc_col)).alias("is_malformed"),
                    F.json_tuple(F.col(doc_col), *ACTIVITY_FIELDS)
                    .alias("activity_type", "activity_name", "_output"))
    out = top.select(*keep, "is_malformed", "activity_type", "activity_name",
                     F.json_tuple(F.col("_output"), *OUTPUT_FIELDS).alias(*OUTPUT_COLUMNS))
    return _numbers(out, [*keep, "is_malformed", "activity_type", "activity_name"])


def _copy_is_bad(with_data: bool) -> Column:
    ok = F.col("files_read") == F.col("files_written")
    if with_data:
        ok = ok & (F.col("data_read") == F.col("data_written"))
    return ~F.coalesce(ok, F.lit(False))


def copy_totals(acts: DataFrame, run_key: Sequence[str], max_mismatch: int,
                with_data: bool = True, order: ColumnOrName | None = None) -> DataFrame:
    """A5 (+ L2): per run, over the Copy activities.

    * ``files_written``: sum of files written of every Copy that reports both
      counts (mismatched ones included, as they were added before the check);
    * ``bytes_written`` (``with_data``): sum of data written of the Copies
      whose file counts agree and that report data read;
    * ``n_bad``: Copies with a missing count or read <> written (and, with
      ``with_data``, data read <> data written);
    * ``failed``: ``n_bad > max_mismatch`` (the run fails on mismatch number
      ``max_mismatch + 1``, in any order);
    * ``last_files_written`` (when ``order`` is given): files written of the
      last Copy that reported both counts, by ``order`` (ties: the larger).

    ``order`` is one whole number (``activity_seq`` of a report, or several
    columns put together by ``pack_order``), which keeps this a hash aggregate.
    """
    is_copy = F.col("activity_type") == COPY
    fr, fw = F.col("files_read"), F.col("files_written")
    counted = is_copy & fr.isNotNull() & fw.isNotNull()
    aggs = [
        F.count_if(is_copy).alias("n_copy"),
        F.coalesce(F.sum(F.when(counted, fw)), F.lit(0)).cast("bigint").alias("files_written"),
        F.count_if(is_copy & _copy_is_bad(with_data)).alias("n_bad"),
    ]
    if with_data:
        add_bytes = is_copy & (fr == fw) & F.col("data_read").isNotNull()
        aggs.append(F.coalesce(F.sum(F.when(add_bytes, F.col("data_written"))), F.lit(0))
                    .cast("bigint").alias("bytes_written"))
    if order is not None:
        last = F.max(F.when(counted, last_value(order, fw)))
        aggs.append(unpack_value(last).alias("last_files_written"))
    out = acts.groupBy(*run_key).agg(*aggs)
    return out.withColumn("failed", F.col("n_bad") > F.lit(max_mismatch))


def _is_metadata(activity_name: str) -> Column:
    return F.coalesce((F.col("activity_type") == GET_METADATA) & (F.col("activity_name") == activity_name),
                      F.lit(False))


def last_metadata(acts: DataFrame, run_key: Sequence[str], activity_name: str,
                  order: ColumnOrName) -> DataFrame:
    """L2 + X6: per run and item name, the size of the last matching
    GetMetadata activity by ``order`` (later ones overwrite earlier ones; one that
    reports no size is passed over)."""
    return (
        acts.where(_is_metadata(activity_name) & F.col("item_name").isNotNull())
        .groupBy(*run_key, "item_name")
        .agg(unpack_value(F.max(last_value(order, "item_size"))).alias("item_size"))
    )


def union_listings(*listings: DataFrame) -> DataFrame:
    """Data-file and control-file listings as one listing."""
    out = listings[0]
    for extra in listings[1:]:
        out = out.unionByName(extra)
    return out


def compare_listings(source: DataFrame, target: DataFrame, keys: Sequence[str],
                     size: str = "file_size") -> DataFrame:
    """Per file, source size against target size, and how often each
    side lists it.

    Status: MISSING_IN_SOURCE / MISSING_IN_TARGET / DUPLICATE (a side lists
    the name with different sizes, or the sides list it a different number of
    times) / SIZE_MISMATCH / MATCH.  Both listings are tagged, unioned and
    reduced by one aggregate: one shuffle, pre-aggregated in every task, no
    join.
    """
    keys = list(keys)
    both = source.select(*keys, F.col(size).alias("_size"), F.lit(True).alias("_src")).unionByName(
        target.select(*keys, F.col(size).alias("_size"), F.lit(False).alias("_src")))
    src = F.when(F.col("_src"), F.col("_size"))
    tgt = F.when(~F.col("_src"), F.col("_size"))
    g = both.groupBy(*keys).agg(
        F.count_if("_src").alias("n_src"), F.count_if(~F.col("_src")).alias("n_tgt"),
        F.max(src).alias("src_size"), F.max(tgt).alias("tgt_size"),
        F.min(src).alias("_src_min"), F.min(tgt).alias("_tgt_min"))
    dup = ((F.col("src_size") != F.col("_src_min")) | (F.col("tgt_size") != F.col("_tgt_min"))
           | (F.col("n_src") != F.col("n_tgt")))
    status = (
        F.when(F.col("n_src") == 0, MISSING_IN_SOURCE)
        .when(F.col("n_tgt") == 0, MISSING_IN_TARGET)
        .when(dup, DUPLICATE)
        .when(F.col("src_size") == F.col("tgt_size"), MATCH)
        .otherwise(SIZE_MISMATCH)
    )
    return g.select(*keys, "n_src", "n_tgt", "src_size", "tgt_size", status.alias("status"))


def listing_totals(df: DataFrame, key: Sequence[str], size: str = "file_size",
                   tag: str = "src") -> DataFrame:
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias(f"{tag}_files"),
        F.sum(size).cast("bigint").alias(f"{tag}_bytes"),
    )


def compare_totals(left: DataFrame, right: DataFrame, key: Sequence[str],
                   left_tag: str, right_tag: str) -> DataFrame:
    """Per key, number of files and bytes on both sides.

    A key missing on one side counts as zero there.  The sides hold any number
    of rows per key with ``<tag>_files`` and ``<tag>_bytes`` (totals, or one row
    per file); they are unioned and summed by one aggregate, without a join.
    """
    key = list(key)
    zero = F.lit(0).cast("bigint")

    def side(df, own, other):
        return df.select(*key, *[F.col(f"{own}_{w}").cast("bigint").alias(f"{own}_{w}") for w in ("files", "bytes")],
                         *[zero.alias(f"{other}_{w}") for w in ("files", "bytes")])

    both = side(left, left_tag, right_tag).unionByName(side(right, right_tag, left_tag))
    names = [f"{t}_{w}" for w in ("files", "bytes") for t in (left_tag, right_tag)]
    g = both.groupBy(*key).agg(*[F.coalesce(F.sum(n), zero).cast("bigint").alias(n) for n in names])
    cols = []
    for w in ("files", "bytes"):
        lc, rc = F.col(f"{left_tag}_{w}"), F.col(f"{right_tag}_{w}")
        cols += [lc, rc, (lc == rc).alias(f"{w}_match")]
    return g.select(*key, *cols)


def per_file(df: DataFrame, key: Sequence[str], size: str = "file_size", tag: str = "src") -> DataFrame:
    """A listing as summands of ``compare_totals``: one row per file."""
    return df.select(*key, F.lit(1).cast("bigint").alias(f"{tag}_files"), F.col(size).alias(f"{tag}_bytes"))


# ------------------------------------------------------------------ verdicts
# The copy checks of the original, by what they compare.
LAST_COPY, TOTAL_FILES, TOTAL_BYTES = "LAST_COPY", "TOTAL_FILES", "TOTAL_BYTES"
_DATA, _CONTROL = "data", "control"


def copy_facts(acts: DataFrame, run_key: Sequence[str], activity_name: str, order: ColumnOrName,
               data_files: DataFrame, control_files: DataFrame | None = None,
               listing_order: ColumnOrName | None = None) -> DataFrame:
    """One row per run with all that the copy checks compare.

    ``acts`` comes from ``parse_reports`` or ``parse_activities``; the listings have
    the run key, file_nm and file_size.  A file listed more than once counts as often
    as it is listed; its size is that of the last listing (control files after data
    files, by ``listing_order`` within each; of ties the larger).

    Activities and listed files are tagged and unioned, then reduced twice: by run and
    file, then by run.  Both steps pre-aggregate in every task, so a run with a third
    of all rows sends one row per task and file.
    """
    run_key = list(run_key)
    null = F.lit(None)
    nothing = {"_order": null.cast("bigint"), "_size": null.cast("bigint"), "_meta": F.lit(False),
               "_copy": F.lit(False), "_bad": F.lit(False),
               **{c: null.cast("bigint") for c in ("files_read", "files_written", "data_read", "data_written")}}
    meta = _is_metadata(activity_name)
    # A wanted GetMetadata without a name or a size stops the original.
    bad = F.col("is_malformed") | (meta & (F.col("item_name").isNull() | F.col("item_size").isNull()))

    def tagged(df, tag, item, **own):
        cols = {**nothing, **own}
        return df.select(*run_key, F.lit(tag).alias("_tag"), item.alias("_item"),
                         *[v.alias(k) for k, v in cols.items()])

    rows = tagged(acts, "report", F.when(meta, F.col("item_name")), _order=_c(order).cast("bigint"),
                  _size=F.col("item_size"), _meta=meta & F.col("item_name").isNotNull(),
                  _copy=F.coalesce(F.col("activity_type") == COPY, F.lit(False)), _bad=bad,
                  **{c: F.col(c) for c in ("files_read", "files_written", "data_read", "data_written")})
    at = F.lit(0) if listing_order is None else _c(listing_order)
    for tag, listing in ((_DATA, data_files), (_CONTROL, control_files)):
        if listing is not None:
            rows = rows.unionByName(tagged(listing, tag, F.col("file_nm"), _order=at.cast("bigint"),
                                           _size=F.col("file_size").cast("bigint")))

    fr, fw, dw = F.col("files_read"), F.col("files_written"), F.col("data_written")
    copy, tag = F.col("_copy"), F.col("_tag")
    counted = copy & fr.isNotNull() & fw.isNotNull()
    last = last_value("_order", "_size")
    per_file = rows.groupBy(*run_key, "_item").agg(
        F.count_if(tag == "report").alias("n_reported"),
        F.count_if(F.col("_bad")).alias("n_malformed"),
        F.count_if(copy & _copy_is_bad(False)).alias("n_bad_files"),
        F.count_if(copy & _copy_is_bad(True)).alias("n_bad_data"),
        F.sum(F.when(counted, fw)).alias("files_written"),
        F.sum(F.when(copy & (fr == fw) & F.col("data_read").isNotNull(), dw)).alias("bytes_written"),
        F.max(F.when(counted, last_value("_order", fw))).alias("_last_copy"),
        F.count_if(tag == _DATA).alias("data_files"), F.count_if(tag == _CONTROL).alias("control_files"),
        F.sum(F.when(tag.isin(_DATA, _CONTROL), F.col("_size"))).alias("listed_bytes"),
        F.max(F.when(F.col("_meta"), last)).alias("_said"),
        F.max(F.when(tag == _DATA, last)).alias("_data"), F.max(F.when(tag == _CONTROL, last)).alias("_control"))
    said, data = unpack_value(F.col("_said")), unpack_value(F.col("_data"))
    any_ = unpack_value(F.coalesce("_control", "_data"))

    def differs(size, listed):
        return listed & ~F.coalesce(said == size, F.lit(False))

    zero = F.lit(0).cast("bigint")
    return per_file.groupBy(*run_key).agg(
        *[F.sum(c).alias(c) for c in ("n_reported", "n_malformed", "n_bad_files", "n_bad_data")],
        *[F.coalesce(F.sum(c), zero).cast("bigint").alias(c) for c in ("files_written", "bytes_written")],
        unpack_value(F.max("_last_copy")).alias("last_files_written"),
        *[F.sum(c).alias(c) for c in ("data_files", "control_files")],
        F.coalesce(F.sum("listed_bytes"), zero).cast("bigint").alias("listed_bytes"),
        F.count_if(differs(data, F.col("data_files") > 0)).alias("n_wrong_data"),
        F.count_if(differs(any_, (F.col("data_files") > 0) | (F.col("control_files") > 0))).alias("n_wrong_files"))


def run_verdicts(facts: DataFrame, run_key: Sequence[str], rule: str, max_mismatch: int) -> DataFrame:
    """J4 + J5: one verdict per run from ``copy_facts``, by the first check that fails.

    1. ``NOT_REPORTED``: the run is listed, but has no report;
    2. ``MALFORMED``: a document, activity or wanted GetMetadata cannot be read;
    3. ``MISMATCH``: more than ``max_mismatch`` Copies read and wrote different numbers
       of files (``TOTAL_BYTES``: or amounts of data), or do not say;
    4. ``COUNT``: the report's number of files is not the number listed;
    5. ``SIZE``: a listed file has another size in the report, or is not in it; or the
       bytes differ.  Files that only the report names do not matter;
    6. ``OK``.

    ``rule`` says what is compared: ``LAST_COPY`` the files of the last Copy that
    reported both counts with the data files (no such Copy: ``COUNT``), then each data
    file; ``TOTAL_FILES`` the files of all Copies with data and control files, then
    each of those; ``TOTAL_BYTES`` the bytes written with the bytes listed, no names.
    """
    if rule not in (LAST_COPY, TOTAL_FILES, TOTAL_BYTES):
        raise ValueError(f"unknown rule {rule}")
    every = F.col("data_files") + F.col("control_files")
    n_bad, copied, listed, n_wrong = {
        LAST_COPY: ("n_bad_files", F.col("last_files_written"), F.col("data_files"), F.col("n_wrong_data")),
        TOTAL_FILES: ("n_bad_files", F.col("files_written"), every, F.col("n_wrong_files")),
        TOTAL_BYTES: ("n_bad_data", F.col("bytes_written"), F.col("listed_bytes"), F.lit(0).cast("bigint")),
    }[rule]
    equal = F.coalesce(copied == listed, F.lit(False))
    verdict = (
        F.when(F.col("n_reported") == 0, "NOT_REPORTED")
        .when(F.col("n_malformed") > 0, "MALFORMED")
        .when(F.col(n_bad) > max_mismatch, "MISMATCH")
        .when(~equal, "SIZE" if rule == TOTAL_BYTES else "COUNT")
        .when(n_wrong > 0, "SIZE")
        .otherwise("OK"))
    return facts.select(*run_key, "n_malformed", F.col(n_bad).alias("n_bad"), copied.alias("copied"),
                        listed.alias("listed"), n_wrong.alias("n_wrong_files"), verdict.alias("verdict"))
