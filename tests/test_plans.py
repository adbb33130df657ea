"""Plan-shape checks: the properties the design relies on at scale."""

from pyspark.sql import functions as F

from tsfold.operators import extract as X
from tsfold.plans.catalog import queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _physical(df) -> str:
    # the final plan once AQE is done (forces execution of the small test)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_has_one_exchange(fixture_files):
    """Files are shuffled once by file key; windows and the per-statement
    aggregate reuse that partitioning."""
    p = _plan(X.statements(fixture_files))
    assert p.count("Exchange hashpartitioning") == 1, p
    assert "UnboundedFollowing" not in p  # only O(n) running frames


def test_scan_prunes_columns(spark):
    df = queries()["normalize_events"](spark, "/root/testdata/sf0.001")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in p
    assert "props" not in p  # the unused JSON column is never read


def test_filter_pushed_to_scan(spark):
    from tsfold.sources.tables import table
    df = table(spark, "/root/testdata/sf0.001", "part").where(F.col("p_size") >= 45).select("p_partkey")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,45)]" in p


def test_no_python_udf_in_extraction(fixture_files):
    p = _plan(X.statements(fixture_files))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
