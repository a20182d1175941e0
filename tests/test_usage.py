"""The README usage example, run on the fixtures."""

import uuid

from pyspark.sql import functions as F

from runledger.operators import calendar, config, ledger, markers, quality
from runledger.plans import fixtures as fx
from runledger.session import configure


def test_readme_example(spark, sf):
    configure(spark)
    log = fx.job_log(spark, sf)
    c = fx.job_config(spark, sf)
    cfg = {"pi": c, "pt": c, "po": c}
    assert quality.flag_violations(cfg["pi"], ["actv_flag"]).count() > 0
    status = config.active_config_status(cfg["pi"], requested=log)
    assert status.count() == log.select("job_nm").distinct().count()
    routed = config.attach_routes(log, cfg)
    assert routed.count() == log.count()
    new_markers = markers.success_markers(
        routed, "/shared", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), F.col("monoline"))
    assert new_markers.count() > 0
    hol = calendar.holiday_flags(log, "dl_data_dt", fx.hldy(spark, sf), {"is_hldy": F.lit("HOLIDAY")})
    assert hol.where("is_hldy").count() > 0
    # The ledger layout has one partition per (tenant, date, job): a slice of
    # the log keeps this sink check short (the sinks have their own tests).
    part = log.where(F.col("log_no") < 200)
    name = f"usage_{uuid.uuid4().hex[:8]}"
    ledger.create_ledger(spark, name, log.schema)
    ledger.write_append(spark, name, part)
    ledger.write_update(spark, name, F.col("job_sts") == "RUNNING", {"job_sts": "FAILED"}, tenant="mono_a")
    t = spark.table(name)
    assert t.where((F.col("monoline") == "MONO_A") & (F.col("job_sts") == "RUNNING")).count() == 0
    assert t.where((F.col("monoline") == "MONO_B") & (F.col("job_sts") == "RUNNING")).count() > 0
    assert t.count() == part.count()
    spark.sql(f"DROP TABLE {name}")
