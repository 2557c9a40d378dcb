import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8 and "q50" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["summary_text", "correlation_matrix", "roc_curve", "label_encode",
                                  "stratified_split"])
def test_no_global_window(spark, name):
    """No window without a partition spec (it would move all rows to one task)."""
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[.*\], \[\], \[", plan)


def test_outlier_bounds_pushed_to_scan(spark):
    from tabsight.operators import distribution as D
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value")
    plan = D.outliers_iqr(ev, "value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "value" in plan.split("PushedFilters")[1][:200]


def test_quantile_bins_stay_in_codegen(spark):
    """The histogram pass of the exact quantiles is a codegen hash aggregate
    (no sketch buffers, no object or sort aggregate)."""
    from pyspark.sql import functions as F
    from tabsight.functions.quantiles import _bin_counts
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    inside = li.select(F.lit(0).cast("long").alias("bid"), F.col("l_extendedprice").alias("v"),
                       F.lit(900.0).alias("lo"), F.lit(100.0).alias("w"))
    plan = _bin_counts(inside, 1024)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert "ReadSchema: struct<l_extendedprice:double>" in plan
