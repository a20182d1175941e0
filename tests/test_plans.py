"""Plan tests: the physical plans have the shape the design relies on."""

from pyspark.sql import functions as F

from runledger.operators import calendar, quality
from runledger.plans import catalog, fixtures as fx
from runledger.sources.tables import read_table


def plan(df, capsys, mode="formatted"):
    df.explain(mode)
    return capsys.readouterr().out


def tree(p):
    """The operator tree of a formatted plan (without the node details)."""
    return p.split("\n\n(1)")[0]


def test_calendar_join_is_broadcast(spark, sf, capsys):
    runs = fx.job_log(spark, sf).select("log_no", "dl_data_dt")
    p = plan(calendar.holiday_flags(runs, "dl_data_dt", fx.hldy(spark, sf),
                                    {"h": F.lit("HOLIDAY")}), capsys)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_required_check_is_one_scan_one_aggregate(spark, sf, capsys):
    cust = read_table(spark, sf, "customer")
    p = plan(quality.required_violations(cust, ["c_name", "c_mktsegment", "c_acctbal"]), capsys)
    assert tree(p).count("Scan parquet") == 1
    assert tree(p).count("Exchange") <= 1


def test_value_checks_are_one_scan(spark, sf, capsys):
    p = plan(catalog.Q["value_violations"](spark, sf), capsys)
    # job_config is a union of two scans of customer; the checks add none.
    assert tree(p).count("Scan parquet") == 2


def test_column_pruning_and_pushdown_reach_scan(spark, sf, capsys):
    o = read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    p = plan(o, capsys)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_activity_documents_parsed_once_after_spread(spark, sf, capsys):
    p = plan(catalog.Q["activity_file_compare"](spark, sf), capsys)
    assert "from_json" not in p
    assert p.count("json_tuple") >= 2  # one per level, each once
    # The parse (Generate) sits above the spreading exchange, not in the scan stage.
    scan_stage = p.split("Scan parquet")[1].split("\n(")[0]
    assert "json_tuple" not in scan_stage


def test_listing_compare_is_one_to_one(spark, sf, capsys):
    p = plan(catalog.Q["manifest_compare"](spark, sf), capsys)
    # both listings in one aggregate: a partial and a final step, one shuffle, no join
    assert tree(p).count("HashAggregate") == 2 and "Join" not in p and tree(p).count("Exchange") == 1
    p = plan(catalog.Q["manifest_totals"](spark, sf), capsys)
    assert tree(p).count("Exchange") == 1 and "Join" not in p


def test_stale_markers_join_has_equi_keys(spark, sf, capsys):
    p = plan(catalog.Q["stale_markers"](spark, sf), capsys)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "LeftSemi" in p


def test_no_python_udfs_in_catalogue(spark, sf, capsys):
    for name, q in catalog.Q.items():
        p = plan(q(spark, sf), capsys, "simple")
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_no_cross_joins_in_catalogue(spark, sf, capsys):
    for name, q in catalog.Q.items():
        p = plan(q(spark, sf), capsys, "simple")
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_bounded_broadcast_checks_rows_and_bytes(spark):
    from runledger.plans.strategy import bounded_broadcast
    small = spark.createDataFrame([("a" * 10, 1)], "s string, n int")
    big_text = spark.createDataFrame([("a" * 5000, 1)], "s string, n int")
    many = spark.range(50).toDF("n")
    # Within both bounds: a broadcast-hinted DataFrame; beyond either: the input unchanged.
    assert bounded_broadcast(small, 10, max_bytes=1000) is not small
    assert bounded_broadcast(big_text, 10, max_bytes=1000) is big_text
    assert bounded_broadcast(many, 10) is many
    # The bound may come from inputs: an aggregate of ``many`` is bounded by it.
    agg = many.groupBy((many.n % 3).alias("k")).count()
    assert bounded_broadcast(agg, 10, bound_by=[many]) is agg
    assert bounded_broadcast(agg, 100, bound_by=[many]) is not agg


def test_area_documents_parsed_once(spark, sf, capsys):
    p = plan(catalog.Q["config_json_flatten"](spark, sf), capsys, "extended")
    phys = p.split("== Physical Plan ==")[1]
    assert phys.count("json_tuple(") == 1 and phys.count("from_json(") == 1


def test_no_single_task_count_before_a_broadcast(spark, capsys):
    from pyspark.sql import functions as F

    from runledger.plans import strategy

    seen = []
    df = spark.range(1000).select(F.col("id"), F.col("id").cast("string").alias("wide"))

    class Spy(type(df)):
        def agg(self, *cols):
            out = super().agg(*cols)
            out.explain()
            seen.append(capsys.readouterr().out)
            return out

    df.__class__ = Spy
    strategy.bounded_broadcast(df.select("id"), 10, bound_by=[df])
    strategy.bounded_broadcast(df, 10)
    assert all("GlobalLimit" not in s and "LocalLimit" not in s for s in seen)


def test_routing_scans_each_config_table_once(spark, sf, capsys):
    p = plan(catalog.Q["route_jobs"](spark, sf), capsys)
    # customer twice (the fixture's union), the ledger once
    assert tree(p).count("Scan parquet") == 3
