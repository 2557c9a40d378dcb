import math
import numpy as np
import pandas as pd
import pytest

from tabsight.operators import distribution as D
from tabsight.operators import stats as S

VALS = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 5.0, 6.0, 40.0, -30.0, None, 3.0, 2.5]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALS)], "id int, v double")


def _clean():
    return np.array([v for v in VALS if v is not None])


def test_iqr_z_mad(df):
    x = _clean()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    iqr = {r["id"] for r in D.outliers_iqr(df, "v").collect()}
    assert iqr == {i for i, v in enumerate(VALS) if v is not None and (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))}
    z = (x - x.mean()) / x.std()
    assert D.outliers_zscore(df, "v").count() == int((np.abs(z) > 3).sum())
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    assert D.outliers_mad(df, "v").count() == int((np.abs(0.6745 * (x - med) / mad) > 3.5).sum())


def test_mad_zero_flags_everything_off_median(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "v double")
    assert D.outliers_mad(df, "v").count() == 1


def test_histogram_edges_and_constant(spark, df):
    h = D.histogram(df, "v", 30).collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == 12 and h[-1]["count"] == 1
    c = D.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 30).collect()
    assert c[0]["count"] == 4 and sum(r["count"] for r in c) == 4


def test_cap_keeps_nulls(df):
    out = {r["id"]: r["v"] for r in D.outliers_cap_iqr(df, ["v"]).collect()}
    assert out[10] is None and max(v for v in out.values() if v is not None) < 40


def test_box_stats(df):
    r = D.box_stats(df, "v").first()
    x = _clean()
    assert r["median"] == pytest.approx(np.median(x)) and r["n_outliers"] == 2


def test_correlation_pairwise_and_constant(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.1, 5.0, 1.0), (3.0, 6.2, 5.0, 0.0), (4.0, None, 5.0, 3.0),
            (5.0, 9.9, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["col_x"], r["col_y"]): r["corr"] for r in S.correlation_matrix(df).collect()}
    pdf = pd.DataFrame(rows, columns=list("abcd")).corr()
    for (x, y), v in got.items():
        if np.isnan(pdf.loc[x, y]):
            assert v is None
        else:
            assert v == pytest.approx(pdf.loc[x, y])


def test_ttest_and_pvalue(spark):
    a = [5.1, 4.9, 6.2, 5.8, 6.0, 5.5, 5.3]
    b = [4.1, 4.5, 5.0, 4.8, None, 4.2]
    df = spark.createDataFrame(list(zip(a, b + [None])), "a double, b double")
    r = S.ttest_pvalue(df, "a", "b").first()
    xa, xb = np.array(a), np.array([v for v in b if v is not None])
    sp = ((len(xa) - 1) * xa.var(ddof=1) + (len(xb) - 1) * xb.var(ddof=1)) / (len(xa) + len(xb) - 2)
    t = (xa.mean() - xb.mean()) / np.sqrt(sp * (1 / len(xa) + 1 / len(xb)))
    assert r["t_stat"] == pytest.approx(t) and r["dof"] == 10
    assert r["p_value"] == pytest.approx(_tail(t, 10), rel=1e-8) and 0 < r["p_value"] < 0.01
    far = df.selectExpr("a + 1e9 AS a", "b + 1e9 AS b")
    assert S.ttest_pvalue(far, "a", "b").first()["p_value"] == pytest.approx(_tail(t, 10), rel=1e-4)
    for flat in ("1.0D AS a", "CAST(NULL AS double) AS a"):
        assert S.ttest_pvalue(df.selectExpr(flat, "1.0D AS b"), "a", "b").first()["p_value"] is None


def _tail(t, dof):
    """P(|T| > |t|), by Simpson's rule on the density."""
    x = np.linspace(0, abs(t), 20_001)
    log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
    y = np.exp(log_c - (dof + 1) / 2 * np.log1p(x * x / dof))
    w = np.ones(len(x))
    w[1:-1:2], w[2:-1:2] = 4, 2
    return 1 - 2 * (w * y).sum() * (x[1] - x[0]) / 3


def test_f_scores(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 60)
    x = y + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    f = S.f_classif(df, ["x"], "y").first()["f_score"]
    groups = [x[y == k] for k in range(3)]
    ssb = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert f == pytest.approx((ssb / 2) / (ssw / 57))
    fr = S.f_regression(df, ["x"], "y").first()["f_score"]
    r = np.corrcoef(x, y)[0, 1]
    assert fr == pytest.approx(r * r / (1 - r * r) * 58)


def test_histograms_equal_single_column(spark, df):
    two = df.withColumn("w", df["v"] * 2)
    many = {(r["column_name"], r["bin"]): r["count"] for r in D.histograms(two, ["v", "w"], 10).collect()}
    for c in ("v", "w"):
        one = {r["bin"]: r["count"] for r in D.histogram(two, c, 10).collect()}
        assert one == {b: n for (cc, b), n in many.items() if cc == c}


def test_zscore_constant_column_has_no_outlier(spark):
    from tabsight.operators.distribution import outliers_zscore
    df = spark.range(1000).selectExpr("CAST(0.1 AS double) AS x")
    assert outliers_zscore(df, "x").count() == 0
