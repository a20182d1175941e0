"""Every catalogue query against its DuckDB oracle at sf0.001 (the driver
repeats this at sf0.01)."""

import pytest

import __spark_entry__ as entry
from runledger.plans import catalog
from tests.oracle import compare

ORACLE = catalog.SQL
QUERIES = catalog.Q


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf, con, name):
    diff = compare(QUERIES[name](spark, sf), con, ORACLE[name])
    assert diff is None, diff


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == set()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_nm", "zone", "title_nm", "route_error"]
    assert df.count() > 0


def test_run_ids_differ(spark, sf):
    from pyspark.sql import functions as F

    from runledger.functions import columns as X

    ids = spark.range(1000).select(X.run_id(F.lit("JOB")).alias("x")).collect()
    assert len({r.x for r in ids}) == 1000
