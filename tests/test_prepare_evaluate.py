import math

import numpy as np
import pytest

from tabsight.operators import evaluate as EV
from tabsight.operators import prepare as PR


@pytest.fixture()
def df(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 9), None if i % 5 == 0 else "abc"[i % 3]) for i in range(40)]
    return spark.createDataFrame(rows, "k int, x double, t string")


def test_imputers(df):
    vals = [float(i % 9) for i in range(40) if i % 4]
    m = {r["k"]: r["x"] for r in PR.impute_mean(df, ["x"]).collect()}
    assert m[0] == pytest.approx(np.mean(vals))
    md = {r["k"]: r["x"] for r in PR.impute_median(df, ["x"]).collect()}
    assert md[0] == pytest.approx(np.median(vals))
    mo = {r["k"]: (r["x"], r["t"]) for r in PR.impute_mode(df, ["x", "t"]).collect()}
    counts = {v: vals.count(v) for v in set(vals)}
    best = min(counts, key=lambda v: (-counts[v], v))
    assert mo[0][0] == best and mo[0][1] in "abc"
    co = {r["k"]: (r["x"], r["t"]) for r in PR.impute_constant(df, ["x", "t"], "zz").collect()}
    assert co[0] == (0.0, "zz")


def test_label_encode_sorted_codes(spark):
    df = spark.createDataFrame([(1, "pear"), (2, "apple"), (3, None), (4, "pear")], "k int, f string")
    got = {r["k"]: r["f"] for r in PR.label_encode(df, ["f"]).collect()}
    # sorted categories: apple, nan, pear
    assert got == {1: 2, 2: 0, 3: 1, 4: 2}


def test_scalers_constant_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, c double")
    st = PR.standard_scale(df, ["a", "c"]).collect()
    assert [r["a"] for r in st] == [-1.0, 1.0, None] and [r["c"] for r in st] == [0.0, 0.0, 0.0]
    mm = PR.minmax_scale(df, ["a", "c"]).collect()
    assert [r["a"] for r in mm] == [0.0, 1.0, None] and mm[0]["c"] == 0.0


def test_split_independent_of_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r["k"] for r in PR.split(df.repartition(3), ["k"]).where("is_test").collect()}
    b = {r["k"] for r in PR.split(df.repartition(11), ["k"]).where("is_test").collect()}
    assert a == b and 300 < len(a) < 500


def test_stratified_quota(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 < 7 else "b") for i in range(103)], "k int, y string")
    out = PR.stratified_split(df, ["k"], "y", 0.2).where("is_test").groupBy("y").count().collect()
    got = {r["y"]: r["count"] for r in out}
    na = len([i for i in range(103) if i % 10 < 7])
    assert got == {"a": math.ceil(0.2 * na), "b": math.ceil(0.2 * (103 - na))}


def test_prepare_guards(spark):
    df = spark.createDataFrame([(i, float(i), "u") for i in range(5)], "k int, x double, y string")
    with pytest.raises(ValueError):
        PR.prepare(df, "y", ["x"])
    with pytest.raises(ValueError):
        PR.prepare(df, "y", [])


def test_problem_and_target_type(spark):
    df = spark.createDataFrame([(float(i % 2), float(i) / 3, "s") for i in range(30)], "b double, c double, t string")
    assert PR.target_type(df, "b").first()["target_type"] == "binary"
    assert PR.target_type(df, "c").first()["target_type"] == "continuous"
    assert PR.problem_type(df, "t").first()["problem_type"] == "Classification"
    assert PR.problem_type(df, "c").first()["problem_type"] == "Regression"


Y = [0, 0, 1, 1, 0, 1, 1, 0, 1, 1]
S = [0.1, 0.4, 0.35, 0.8, 0.2, 0.9, 0.6, 0.6, 0.3, 0.7]


@pytest.fixture()
def pred(spark):
    return spark.createDataFrame([(float(y), s, 1.0 if s > 0.5 else 0.0) for y, s in zip(Y, S)],
                                 "label double, score double, prediction double")


def _auc():
    pos = [s for y, s in zip(Y, S) if y == 1]
    neg = [s for y, s in zip(Y, S) if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_binary_metrics(pred):
    p = [1.0 if s > 0.5 else 0.0 for s in S]
    assert EV.metric_accuracy(pred).first()["accuracy"] == pytest.approx(np.mean(np.array(p) == np.array(Y)))
    assert EV.roc_auc(pred).first()["auc"] == pytest.approx(_auc())
    roc = sorted((r["fpr"], r["tpr"]) for r in EV.roc_curve(pred).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    pr = EV.pr_curve(pred).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)


def test_confusion_and_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "c"), ("a", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    cm = {(r["actual"], r["predicted"]): r["count"] for r in EV.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("a", "a")] == 2 and cm[("b", "c")] == 0
    w = EV.metric_weighted_prf(df).first()
    # per class precision a=1, b=1/3, c=1; recall a=2/3, b=1, c=1/2; supports 3,1,2
    assert w["precision"] == pytest.approx((3 * 1 + 1 / 3 + 2 * 1) / 6)
    assert w["recall"] == pytest.approx((3 * 2 / 3 + 1 + 2 * 0.5) / 6)
    rep = {r["class"]: r for r in EV.classification_report(df).collect()}
    assert rep["accuracy"]["f1"] == pytest.approx(4 / 6) and rep["macro avg"]["support"] == 6


def test_regression_metrics(spark):
    y, p = [1.0, 2.0, 3.0, 4.0], [1.5, 1.5, 3.5, 3.0]
    df = spark.createDataFrame(list(zip(y, p)), "label double, prediction double")
    r = EV.regression_metrics(df).first()
    e = np.array(y) - np.array(p)
    assert r["mse"] == pytest.approx((e ** 2).mean()) and r["mae"] == pytest.approx(np.abs(e).mean())
    assert r["r2"] == pytest.approx(1 - (e ** 2).sum() / ((np.array(y) - 2.5) ** 2).sum())


def test_default_features(df):
    assert PR.default_features(df, "t") == ["k", "x"]
    assert PR.default_features(df, None, 1, kind="text") == ["t"]


def test_folds_balanced_per_class(spark):
    from tabsight.plans.compare import assign_folds
    df = spark.createDataFrame([(i, "a" if i % 10 < 7 else "b") for i in range(103)], "k int, y string")
    got = assign_folds(df, "k", 5, "y").groupBy("y", "fold").count().collect()
    per = {}
    for r in got:
        per.setdefault(r["y"], []).append(r["count"])
    for y, counts in per.items():
        n = sum(counts)
        assert len(counts) == 5 and set(counts) <= {n // 5, -(-n // 5)}
    plain = assign_folds(df, "k", 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in plain) in ([25, 26, 26, 26], [25, 25, 26, 27]) or \
        sum(r["count"] for r in plain) == 103 and len(plain) == 4
