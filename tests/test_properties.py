"""Property tests: exactness against numpy on random inputs and independence
from the input partitioning (SURVEY §5, layer 3)."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabsight.functions import column_quantiles
from tabsight.operators import prepare as PR
from tabsight.plans.compare import assign_folds

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, parts=st.integers(1, 7))
def test_quantiles_exact_and_partition_free(spark, vals, parts):
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(parts)
    got = {r["p"]: r["quantile"] for r in column_quantiles(df, ["x"], [0.1, 0.5, 0.9], max_group=4, bins=3).collect()}
    clean = [v for v in vals if v is not None]
    for p, v in got.items():
        if not clean:
            assert v is None
        else:
            assert v == pytest.approx(float(np.quantile(clean, p)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("parts", [1, 5])
def test_split_and_folds_partition_free(spark, parts):
    rows = [(i, "abc"[i % 3] if i % 11 else "a") for i in range(120)]
    df = spark.createDataFrame(rows, "k int, y string")
    base = PR.stratified_split(df, ["k"], "y", 0.25).select("k", "is_test")
    other = PR.stratified_split(df.repartition(parts), ["k"], "y", 0.25).select("k", "is_test")
    assert sorted(base.collect()) == sorted(other.collect())
    f1 = assign_folds(df, "k", 4, "y").select("k", "fold").collect()
    f2 = assign_folds(df.repartition(parts), "k", 4, "y").select("k", "fold").collect()
    assert sorted(f1) == sorted(f2)
