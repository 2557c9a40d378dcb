"""Heavy tails, signed zeros, datetimes, null features and wrong targets."""

import datetime

import numpy as np
import pytest

from tabsight.functions.quantiles import exact_quantiles
from tabsight.operators import models as M
from tabsight.operators import prepare as PR
from tabsight.operators import profile as P
from tabsight.plans import compare as C


@pytest.mark.parametrize("kind", ["log", "both", "lognormal", "hot"])
def test_quantiles_of_heavy_tails(spark, kind):
    rng = np.random.default_rng(3)
    x = {"log": 10.0 ** rng.uniform(-300, 300, 6000),
         "both": rng.choice([-1.0, 1.0], 6000) * 10.0 ** rng.uniform(-300, 308, 6000),
         "lognormal": rng.lognormal(0, 8, 6000),
         "hot": np.where(rng.random(6000) < 0.4, 7.0, 10.0 ** rng.uniform(-9, 9, 6000))}[kind]
    df = spark.createDataFrame([("x", float(v)) for v in x], "column_name string, value double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, probs, max_group=50, bins=64).collect()}
    s = np.sort(x)
    for p in probs:
        h = (len(s) - 1) * p
        a, b = s[int(h)], s[min(int(h) + 1, len(s) - 1)]
        want = a if h == int(h) or a == b else a + (b - a) * (h - int(h))
        assert got[p] == pytest.approx(want, rel=1e-12)


def test_signed_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "x double")
    assert P.distinct_counts(df).first()["n_distinct"] == 2


def test_datetimes_in_imputation(spark):
    t = datetime.datetime(2020, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(i, t if i < 12 else None, i % 2) for i in range(14)], "id int, t timestamp_ntz, y int")
    assert {r["t"] for r in PR.impute_mode(df).collect()} == {t}
    assert PR.impute_constant(df).where("t IS NULL").count() == 2
    assert PR.impute_constant(df, ["t"], "2021-01-01 00:00:00").where("t IS NULL").count() == 0
    assert PR.prepare(df, "y", ["t"], keep=["id"]).count() == 14


def test_split_fraction_is_exact(spark):
    df = spark.range(40000).withColumnRenamed("id", "k")
    for p in (0.004, 0.125):
        assert PR.split(df, ["k"], p).where("is_test").count() / 40000 == pytest.approx(p, rel=0.15)


def test_naive_bayes_null_feature(spark):
    rows = [(float(i % 7), float(i % 3), i % 2) for i in range(40)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    got = M.gaussian_nb(df, ["a", "b"], "y").transform(df).where("a IS NULL").first()
    assert got["prediction"] is None and got["probability"] is None


@pytest.mark.parametrize("scale", [0.01, 1.0, 1000.0])
def test_svr_fits_at_any_scale(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = scale * (3 + np.sin(x[:, 0]) + x[:, 1])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    out = np.array([(r["y"], r["prediction"]) for r in M.svr_rbf(df, ["a", "b"], "y").transform(df).collect()])
    assert 1 - ((out[:, 0] - out[:, 1]) ** 2).sum() / ((out[:, 0] - out[:, 0].mean()) ** 2).sum() > 0.8
    flat = df.selectExpr("a", "b", "2.5D AS y")
    assert {r["prediction"] for r in M.svr_rbf(flat, ["a", "b"], "y").transform(flat).collect()} == {2.5}


def test_wrong_targets_are_refused(spark):
    df = spark.createDataFrame([(i, float(i), i + 0.5, "ab"[i % 2]) for i in range(30)], "id int, a double, y double, s string")
    with pytest.raises(ValueError):
        C.compare_models(df, "y", ["a"], "Classification", "id")
    with pytest.raises(ValueError):
        C.compare_models(df, "s", ["a"], "Regression", "id")
