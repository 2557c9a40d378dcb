"""Comparison, search, ensembles and many-class statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import evaluate as EV
from tabsight.operators import models as M
from tabsight.operators import prepare as PR
from tabsight.operators import stats as S
from tabsight.plans import compare as C


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        x, z = float(rng.normal()), float(rng.normal())
        y = int(x > 0)
        rows.append((i, x + (3.0 if y else -3.0), z, y, ("a", "b", "c")[i % 3], 2 * x - z + 0.25))
    return spark.createDataFrame(rows, "k long, x double, z double, y int, g string, r double")


def test_comparison_keeps_rows_points_and_models(spark, data):
    c = C.compare(data.select("k", "x", "z", "y"), "y", ["x", "z"], "Classification", "k",
                  ["Logistic Regression", "Decision Tree", "Naive Bayes"], cv_folds_k=2)
    spark.catalog.clearCache()  # nothing that is returned hangs on a cache
    m = {r["model"]: r for r in c.metrics.collect()}
    assert set(m) == set(c.models) and all(r["error"] is None and r["accuracy"] == 1.0 and r["roc_auc"] == 1.0 for r in m.values())
    n = c.predictions.groupBy("model").count().collect()
    assert len(n) == 3 and {r["count"] for r in n} in ({32}, {33})  # a fifth of each class, rounded up
    assert c.predictions.where("actual <> predicted").count() == 0
    pts = c.points.where("model = 'Naive Bayes'").orderBy("fpr", "tpr").collect()
    assert (pts[0]["fpr"], pts[0]["tpr"]) == (0.0, 0.0) and (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0)
    again = c.models["Decision Tree"].transform(data).where("prediction = y").count()
    assert again == 160


def test_failing_model_is_reported(data, monkeypatch):
    fit = C.fit_model
    monkeypatch.setattr(C, "fit_model", lambda name, *a, **b: 1 / 0 if name == "Naive Bayes" else fit(name, *a, **b))
    c = C.compare(data.select("k", "x", "y"), "y", ["x"], "Classification", "k", ["Naive Bayes", "Decision Tree"], cv_folds_k=2)
    m = {r["model"]: r for r in c.metrics.collect()}
    assert "ZeroDivisionError" in m["Naive Bayes"]["error"] and m["Naive Bayes"]["accuracy"] is None
    assert m["Decision Tree"]["error"] is None and list(c.models) == ["Decision Tree"]


@pytest.mark.parametrize("target, problem", [("y", "Regression"), ("k", "Regression"), ("g", "Regression"), ("r", "Classification")])
def test_targets_of_the_other_kind_are_refused(data, target, problem):
    with pytest.raises(ValueError):
        C.compare(data, target, ["x"], problem, "k")
    whole = data.withColumn("w", F.col("k").cast("double"))
    with pytest.raises(ValueError):
        C.refuse_wrong_target(whole, "w", False)
    C.refuse_wrong_target(whole, "r", False)
    C.refuse_wrong_target(whole, "g", True)


def test_search_draws_and_refits(data):
    grid = {"max_depth": [1, 2, 3], "min_leaf": [1, 5, 200], "num_trees": [2, 3]}
    s = C.search_random(data, ["x", "z"], "y", "k", "Random Forest", True, 2, n_iter=5, grid=grid)
    table = s.table.collect()
    assert len(table) == 5 and len({r["params"] for r in table}) == 5 and sum(r["best"] for r in table) == 1
    best = next(r for r in table if r["best"])
    assert best["params"] == str(sorted(s.best_params.items())) and best["mean_score"] == s.best_score == max(r["mean_score"] for r in table)
    stage = s.model.stage
    assert len(stage.trees) == s.best_params["num_trees"] and stage.getMinInstancesPerNode() == s.best_params["min_leaf"]
    assert s.model.transform(data).where("prediction = y").count() >= 0.9 * 160
    again = C.search_random(data, ["x", "z"], "y", "k", "Random Forest", True, 2, n_iter=5, grid=grid)
    assert [r["params"] for r in again.table.collect()] == [r["params"] for r in table]


def test_grids_cover_the_axes():
    sizes = {k: math.prod(map(len, g.values())) for k, g in C.param_grids().items()}
    assert sizes == {"Random Forest": 27, "Logistic Regression": 6, "SVM": 12, "Gradient Boosting": 27}
    with pytest.raises(ValueError):
        C.search_grid(None, [], "y", "k", "Naive Bayes")


def test_elastic_net_and_kernels(data):
    l1 = M.logistic(data, ["x", "z"], "y", C=0.02, elastic_net=1.0)
    assert [v for _, f, v in l1.coefficients() if f == "z"] == [0.0]
    for kernel in ("linear", "rbf"):
        m = M.svm_rbf(data, ["x", "z"], "y", kernel=kernel, gamma="scale")
        assert m.transform(data).where("prediction = y").count() >= 150


def test_linear_svm_survives_saving(spark, data, tmp_path):
    m = M.svm_rbf(data, ["x", "z"], "y", kernel="linear")
    back = M.load_model(m.save(str(tmp_path / "m")))
    assert m.transform(data).select("k", "prediction").exceptAll(back.transform(data).select("k", "prediction")).count() == 0


def test_ensembles_have_no_join(data):
    few = data.where("k < 80")
    votes = C.voting_classifier(few, data, ["x"], "y", "k")
    mean = C.voting_regressor(few, data, ["x", "z"], "r", "k")
    for out in (votes, mean):
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    rows = votes.collect()
    assert sum(r["prediction"] == r["y"] for r in rows) >= 155 and len(rows) == 160
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in rows)
    assert EV.regression_metrics(mean, "r").first()["r2"] > 0.8


def test_quick_model_comes_back_fitted(data):
    score, m, rows = C.quick_model(data.select("k", "x", "g", "y"), "y", "k", problem_type="Classification")
    assert score.first()["value"] == 1.0
    assert m.transform(rows).where("prediction = y").count() == rows.count()
    assert C.quick_model(data.select("k", "x", "y"), "y", "k")[1] is None


def test_reduced_tables(data):
    assert S.keep_k_best(data, ["x", "z"], "y", 1).columns == ["k", "x", "y", "g", "r"]
    assert C.keep_rfe(data, ["x", "z"], "y", "k", 1, num_trees=5).columns == ["k", "x", "y", "g", "r"]


def test_folds_without_scores(spark, monkeypatch, data):
    monkeypatch.setattr(C, "_fold_scores", lambda *a, **b: [0.5, None, 1.0])
    rows = {r["fold"]: r["score"] for r in C.cv_folds(data, ["x"], "y", "k", "Naive Bayes", True, 3).collect()}
    assert rows["Fold 2"] is None and (rows["mean"], rows["std"], rows["max"]) == (0.75, 0.25, 1.0)


def test_strategies_by_column(spark):
    rows = [(1, 1.0, "a", 5.0), (2, None, None, None), (3, 5.0, "b", 1.0), (4, 9.0, "a", None)]
    df = spark.createDataFrame(rows, "k int, x double, t string, d double")
    out = {r["k"]: r for r in PR.impute_by_column(df, {"x": "mean", "d": "drop", "t": "most_frequent"}).collect()}
    assert set(out) == {1, 3} and out[1]["x"] == 1.0
    out = {r["k"]: r for r in PR.impute_by_column(df, {"x": "mean", "t": "constant", "d": "constant"}, {"t": "?", "d": "7"}).collect()}
    assert out[2]["x"] == 5.0 and out[2]["t"] == "?" and out[4]["d"] == 7.0
    for bad in ({"t": "mean"}, {"x": "other"}):
        with pytest.raises(ValueError):
            PR.impute_by_column(df, bad)
    both = PR.preprocess(df, ["x", "d"], {"x": "median", "t": "most_frequent", "d": "mean"}, "minmax", None)
    assert both.where("x IS NULL OR t IS NULL OR d IS NULL").count() == 0 and both.agg(F.max("x")).first()[0] == 1.0


def test_append_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, n string"), spark.createDataFrame([(2.5, 2)], "v double, k int")
    assert sorted(map(tuple, PR.append_by_name(a, b).collect())) == [(1, "x", None), (2, None, 2.5)]


MANY = 10_000


@pytest.fixture(scope="module")
def many(spark):
    """Ten thousand classes, four rows each."""
    c = (F.col("id") % MANY).cast("long")
    return spark.range(4 * MANY, numPartitions=4).select(
        "id", c.alias("c"), (c * 10 + F.floor(F.col("id") / MANY) * 0.1).alias("x"),
        F.when(F.col("id") < 100, (c + 1) % MANY).otherwise(c).alias("p"))


def test_report_of_many_classes(many):
    rep = EV.classification_report(many, "c", "p")
    assert rep.count() == MANY + 3
    r = {x["class"]: x for x in rep.where("class IN ('accuracy', 'macro avg', 'weighted avg', '50')").collect()}
    assert r["accuracy"]["f1"] == pytest.approx(1 - 100 / (4 * MANY)) and r["macro avg"]["support"] == 4 * MANY
    assert (r["50"]["recall"], r["50"]["precision"]) == (0.75, 0.75)


def test_pairs_of_classes_are_made_by_spark(many):
    some = many.where("c < 150").withColumn("p", F.when(F.col("id") < 3, None).otherwise(F.col("c")))
    cm = EV.confusion_matrix(some, "c", "p")
    assert cm.count() == 151 * 151 and cm.agg(F.sum("count")).first()[0] == 600
    assert {r["actual"] for r in cm.where("predicted IS NULL AND count > 0").collect()} == {0, 1, 2}


def test_variance_ratio_of_many_classes(many):
    f = S.f_classif(many, ["x"], "c").first()["f_score"]
    x = (np.arange(MANY) * 10)[:, None] + np.arange(4) * 0.1
    ssb = 4 * ((x.mean(axis=1) - x.mean()) ** 2).sum() / (MANY - 1)
    ssw = ((x - x.mean(axis=1, keepdims=True)) ** 2).sum() / (3 * MANY)
    assert f == pytest.approx(ssb / ssw, rel=1e-9)


def test_naive_bayes_of_many_classes(spark, many, tmp_path):
    m = M.gaussian_nb(many, ["x"], "c")
    assert isinstance(m, M.GaussianNBTable) and m.n_classes == MANY
    asked = many.where("id % 997 = 0").select("id", "c", "x").union(spark.createDataFrame([(-1, 5, None)], "id long, c long, x double"))
    for model in (m, M.load_model(m.save(str(tmp_path / "nb")))):
        out = model.transform(asked).collect()
        for r in out:
            if r["x"] is None:
                assert r["prediction"] is None and r["probability"] is None
            else:
                assert r["prediction"] == r["c"] and len(r["probability"]) == MANY and sum(r["probability"]) == pytest.approx(1)


def test_both_forms_of_naive_bayes_agree(data):
    few = M.GaussianNB.fit(data, ["x", "z"], "g").transform(data).select("k", "prediction", "probability").orderBy("k").collect()
    table = M.GaussianNBTable.fit(data, ["x", "z"], "g").transform(data).select("k", "prediction", "probability").orderBy("k").collect()
    for a, b in zip(few, table):
        assert a["prediction"] == b["prediction"] and a["probability"] == pytest.approx(b["probability"], rel=1e-9)


@pytest.mark.parametrize("regression", [False, True])
def test_random_features_spread_over_partitions(spark, data, monkeypatch, regression):
    # one partition of narrow rows must not become one partition of wide ones
    seen = []
    kind = M.LinearRegression if regression else M.LinearSVC
    fit = kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, df, *a: (seen.append(df.groupBy(F.spark_partition_id()).count().agg(
        F.max("count")).first()[0]), fit(self, df, *a))[1])
    monkeypatch.setattr(M, "SPREAD_BYTES", 16 * 128 * 8)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        one = data.coalesce(1)
        m = M.svr_rbf(one, ["x", "z"], "r") if regression else M.svm_rbf(one, ["x", "z"], "y")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen and max(seen) < 80 and m.transform(data).count() == 160
