import math

import numpy as np
import pandas as pd
import pytest

from tabsight.functions import canonicalize
from tabsight.operators import profile as P

ROWS = [(1.0, "a", 10), (2.0, "b", 10), (None, "a", 11), (float("nan"), None, 12), (4.0, "b", 10),
        (7.0, "c", 10), (2.0, "a", 13)]


@pytest.fixture()
def df(spark):
    return canonicalize(spark.createDataFrame(ROWS, "`x.y` double, `t s` string, n int"))


def _pdf():
    return pd.DataFrame(ROWS, columns=["x.y", "t s", "n"])


def test_summary_numeric_matches_pandas(df):
    got = {r["column_name"]: r for r in P.summary_numeric(df).collect()}
    desc = _pdf()[["x.y", "n"]].describe()
    for c in ("x.y", "n"):
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert got[c][ours] == pytest.approx(desc.loc[theirs, c])
    assert got["x.y"]["missing_count"] == 2
    assert got["x.y"]["missing_pct"] == pytest.approx(200 / 7)


def test_summary_text_top_ties_smallest(df):
    r = P.summary_text(df).collect()[0]
    assert (r["count"], r["unique"], r["top"], r["freq"], r["missing_count"]) == (6, 3, "a", 3, 1)


def test_skewness_matches_pandas(df):
    got = {r["column_name"]: r["skewness"] for r in P.skewness(df).collect()}
    pdf = _pdf()
    assert got["x.y"] == pytest.approx(pdf["x.y"].skew())
    assert got["n"] == pytest.approx(pdf["n"].skew())


def test_skewness_constant_and_short(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "c double, s double")
    got = {r["column_name"]: r["skewness"] for r in P.skewness(df).collect()}
    assert got == {"c": None, "s": None}


def test_column_info_and_missing(df):
    info = {r["column_name"]: r for r in P.column_info(df).collect()}
    assert info["x.y"]["null_count"] == 2 and info["x.y"]["null_pct"] == round(200 / 7, 2)
    assert info["t s"]["n_distinct"] == 3 and info["t s"]["sample_value"] == "a"
    miss = [(r[0], r[1]) for r in P.missing_by_column(df).collect()]
    assert miss == [("x.y", 2), ("t s", 1)]
    mc = P.missing_cells(df).first()
    assert (mc["missing_cells"], mc["total_cells"]) == (3, 21)


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "y")], "a int, b string")
    assert P.duplicate_rows(df).first()["n_duplicates"] == 2


def test_zero_rows(spark):
    df = spark.createDataFrame([], "a double, b string")
    s = P.summary_numeric(df).first()
    assert s["count"] == 0 and s["mean"] is None and s["q50"] is None
    assert P.table_shape(df).first()["n_rows"] == 0
    assert P.missing_by_column(df).count() == 0


def test_value_counts_and_shares(df):
    vc = [(r["value"], r["count"]) for r in P.value_counts(df, "t s").collect()]
    assert vc == [("a", 3), ("b", 2), ("c", 1)]
    sh = P.value_shares(df, "t s").collect()
    assert math.isclose(sum(r["share"] for r in sh), 1.0)


def test_logical_bytes_and_kinds(df):
    b = {r["column_name"]: r["bytes"] for r in P.logical_bytes(df).collect()}
    assert b["x.y"] == 8 * 5 and b["t s"] == 6 and b["n"] == 4 * 7
    kinds = {r["kind"]: r["n_columns"] for r in P.kind_counts(df).collect()}
    assert kinds == {"numeric": 2, "text": 1}


def test_nan_canonicalized(spark):
    df = canonicalize(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert np.isnan(float("nan")) and df.where("v is null").count() == 1
