"""Configuration JSON sources.

Configuration files are multi-line JSON documents, one object per file.
Reading them with a fixed schema avoids a schema-inference pass over every
file; nested job lists are flattened with ``explode`` (an area with an empty
or NULL list disappears, as before).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.columns import STRICT_JSON, is_json
from runledger.sources.control_files import plain_path
from runledger.sources.manifests import list_files

_S = T.StringType()

AREA_JOB = T.StructType([
    T.StructField("job_type", _S), T.StructField("job_nm", _S),
    T.StructField("job_seq", T.LongType()), T.StructField("job_hldy_flag", _S),
])
AREA_SCHEMA = T.StructType([
    T.StructField("area_nm", _S), T.StructField("job", T.ArrayType(AREA_JOB)),
])

PENDING_JOB = T.StructType([
    T.StructField("pndng_type", _S), T.StructField("pndng_db", _S),
    T.StructField("pndng_tbl", _S), T.StructField("pndng_job_nm", _S),
    T.StructField("alw_zero_rec_flag", _S), T.StructField("script_chck_dpdc", _S),
])
DEPENDENCY_SCHEMA = T.StructType([
    T.StructField("job_nm", _S), T.StructField("pndng_job", T.ArrayType(PENDING_JOB)),
])

# The configuration folders and their view names are json_<name>.
CONFIG_NAMES = ["cmmn_area", "cmmn_dpdc", "ingt_job", "tnfm_job", "outbnd_job",
                "schm_sync_config", "delta_hskp_config"]


def read_config_json(spark: SparkSession, glob: str, schema: T.StructType | None = None) -> DataFrame:
    """Multi-line JSON files; with ``schema`` no inference pass is made."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(glob)


def checked_documents(df: DataFrame, doc_col: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S2 with a quarantine: ``(good, bad)`` of a table with a JSON document per row.

    A document is one JSON object or a list of them, strictly written and whole.
    ``good`` has a row per object (the other columns and the fields of ``schema``);
    ``bad`` the rows whose document is anything else (an empty or NULL one, a cut one,
    one with more text after it, a list that holds something else), as they are.
    """
    keep = [c for c in df.columns if c != doc_col]
    c = F.btrim(F.col(doc_col), F.lit(" \t\r\n"))
    # An object is read as a list of one; what the reader cannot take at all is NULL.
    objects = F.from_json(c, T.ArrayType(schema), STRICT_JSON)
    parsed = df.withColumn("_objects", F.when(is_json(doc_col) & (c.startswith("{") | c.startswith("[")), objects))
    fine = F.col("_objects").isNotNull() & ~F.exists("_objects", lambda o: o.isNull())
    good = parsed.where(fine).select(*keep, F.inline("_objects"))
    bad = parsed.where(~F.coalesce(fine, F.lit(False))).select(*df.columns)
    return good, bad


def read_config_checked(spark: SparkSession, glob: str, schema: T.StructType,
                        empty_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """S2 with a quarantine over files: ``good`` has ``path`` and the fields of
    ``schema``, ``bad`` the ``path`` and ``text`` of each file that cannot be read
    (with ``empty_files`` also those without a byte, see ``list_files`` for the stores).
    One bad file does not end the job."""
    files = spark.read.text(glob, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    if empty_files:
        files = files.unionByName(list_files(spark, glob).where(F.col("file_size") == 0)
                                  .select("path", F.lit("").alias("text")))
    return checked_documents(files, "text", schema)


def flatten_area(df: DataFrame) -> DataFrame:
    """S3: one row per job of an area."""
    return df.select("area_nm", F.explode("job").alias("j")).select(
        "area_nm", "j.job_type", "j.job_nm", "j.job_seq", "j.job_hldy_flag")


def flatten_dependency(df: DataFrame) -> DataFrame:
    """One row per pending job of a job."""
    return df.select("job_nm", F.explode("pndng_job").alias("p")).select(
        "job_nm", "p.pndng_type", "p.pndng_db", "p.pndng_tbl", "p.pndng_job_nm",
        "p.alw_zero_rec_flag", "p.script_chck_dpdc")


def flatten_area_text(df: DataFrame, text_col: str = "doc") -> DataFrame:
    """S2 + S3 over a text column of area documents already in a table.

    ``json_tuple`` reads each document's top level once (the job list comes
    back as JSON text), and the list is parsed once inside ``explode``.  A
    ``from_json`` struct would be parsed again for every field used.
    """
    top = df.select(F.json_tuple(F.col(text_col), "area_nm", "job").alias("area_nm", "_job"))
    jobs = top.select("area_nm", F.explode(F.from_json("_job", T.ArrayType(AREA_JOB))).alias("j"))
    return jobs.select("area_nm", "j.job_type", "j.job_nm", "j.job_seq", "j.job_hldy_flag")


def flatten_dependency_text(df: DataFrame, text_col: str = "doc") -> DataFrame:
    """S2 + S4 over a text column of dependency documents already in a table."""
    top = df.select(F.json_tuple(F.col(text_col), "job_nm", "pndng_job").alias("job_nm", "_pending"))
    jobs = top.select("job_nm", F.explode(F.from_json("_pending", T.ArrayType(PENDING_JOB))).alias("p"))
    return jobs.select("job_nm", "p.pndng_type", "p.pndng_db", "p.pndng_tbl", "p.pndng_job_nm",
                       "p.alw_zero_rec_flag", "p.script_chck_dpdc")


def register_view(df: DataFrame, name: str) -> str:
    """``json_<name>`` for a flattened configuration; the view's name."""
    view = f"json_{name}"
    df.createOrReplaceTempView(view)
    return view


def create_config_views(spark: SparkSession, root: str, names=CONFIG_NAMES) -> dict[str, str]:
    """Register ``json_<name>`` for each configuration folder under root.

    A folder without files is reported as missing (returned with status
    'missing') instead of failing the whole set.
    """
    status = {}
    for name in names:
        glob = f"{root.rstrip('/')}/{name}/*.json"
        try:
            if name == "cmmn_area":
                df = flatten_area(read_config_json(spark, glob, AREA_SCHEMA))
            elif name == "cmmn_dpdc":
                df = flatten_dependency(read_config_json(spark, glob, DEPENDENCY_SCHEMA))
            else:
                df = read_config_json(spark, glob)
            register_view(df, name)
            status[name] = "created"
        except Exception as e:  # noqa: BLE001 - a missing folder only warns
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                status[name] = "missing"
            else:
                raise
    return status
