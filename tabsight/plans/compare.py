"""Model comparison, cross-validation, tuning and ensembles (SURVEY §2.7-2.9:
M10-M15, E10-E14, X10, T1-T7).

The training table is prepared once, split deterministically, written to the
shared checkpoint folder and reused by every fit.  Each fit is a distributed Spark job; the driver only loops over
models, folds and parameter combinations and collects one metric row each.
"""

from __future__ import annotations

import itertools
import random
import traceback
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.columns import col, hash_order, kind_of, numeric_value
from tabsight.functions.ranking import cuts_passed, hash_cuts, join_checked
from tabsight.operators import evaluate as EV
from tabsight.operators import models as M
from tabsight.operators import prepare as PR
from tabsight.session import keep

# Model names, default selection and the models fed scaled input.
CLASSIFIERS = ["Random Forest", "Logistic Regression", "SVM", "K-Nearest Neighbors", "Decision Tree",
               "Naive Bayes", "Gradient Boosting"]
REGRESSORS = ["Random Forest", "Linear Regression", "SVM", "K-Nearest Neighbors", "Decision Tree",
              "Gradient Boosting"]
SCALED = {"SVM", "Logistic Regression", "K-Nearest Neighbors"}
DEFAULT_COUNT = 3
PARALLELISM = 4          # concurrent fits submitted from the driver
ALONE_ROWS = 200_000     # rows from which a fit fills a cluster, and its memory, by itself


def fit_model(name: str, train: DataFrame, features: list[str], label: str, key: str,
              classification: bool, classes=None, **params) -> M.FittedModel:
    """Fit one named model of the comparison menu (M1-M9)."""
    if name == "Random Forest":
        return M.random_forest(M.fixed_layout(train, [key]), features, label, classification, classes=classes,
                               **params)
    if name == "Logistic Regression":
        return M.logistic(train, features, label, classes=classes, **params)
    if name == "Linear Regression":
        return M.linear(train, features, label)
    if name == "SVM":
        return M.svm_rbf(train, features, label, classes=classes, **params) if classification else \
            M.svr_rbf(train, features, label, **params)
    if name == "K-Nearest Neighbors":
        return M.knn(train, features, label, key, classification, scale=False, **params)
    if name == "Decision Tree":
        return M.decision_tree(train, features, label, classification, classes=classes, **params)
    if name == "Naive Bayes":
        return M.gaussian_nb(train, features, label)
    if name == "Gradient Boosting":
        return M.gbt(train, features, label, classification, classes=classes, **params)
    raise ValueError(f"unknown model {name!r}")


def assign_folds(df: DataFrame, key: str, k: int, label: str | None = None, out: str = "fold") -> DataFrame:
    """Fold number per row (E10): contiguous blocks of the md5 order of the
    key, within each class when ``label`` is given (stratified: every fold
    gets floor or ceil of n_class / k rows of each class).  The k-1 block
    boundaries per class are order statistics found with two aggregates
    (:func:`hash_cuts`) and joined to the rows by class."""
    key_text = col(key).cast("string")
    group = col(label) if label is not None else F.lit("")
    cuts = hash_cuts(df, group, hash_order(col(key)), key_text, lambda n: F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.floor(n * j / k)) if k > 1 else F.array().cast("array<bigint>"))
    cuts = cuts.select(F.col("g").alias("__g"), F.col("cuts").alias("__cuts"))
    rows = df.select("*", hash_order(col(key)).alias("__h"), key_text.alias("__k"))
    fold = F.when(F.col("__cuts").isNotNull(), cuts_passed(F.col("__cuts"), F.col("__h"), F.col("__k")))
    return join_checked(rows, cuts, group == F.col("__g"), "left").select(
        *[col(c) for c in df.columns], fold.cast("int").alias(out))


def _score(model: M.FittedModel, test: DataFrame, label: str, classification: bool, key: str) -> float:
    pred = model.transform(test, key) if isinstance(model, M.KNN) else model.transform(test)
    if classification:
        return EV.metric_accuracy(pred, label, "prediction").first()["accuracy"]
    return EV.regression_metrics(pred, label, "prediction").first()["r2"]


def _scaled(train, test, features, name):
    if name in SCALED:
        return PR.standard_scale(train, features, fit=train), PR.standard_scale(test, features, fit=train)
    return train, test


def fold_column(data: DataFrame, key: str, k: int, label: str | None) -> DataFrame:
    """``data`` with its folds, written once for every fit that uses them."""
    return keep(assign_folds(data, key, k, label), "folds")


def _fold_scores(folded: DataFrame, features, label, key, name, classification, k, classes=None, **params) -> list[float]:
    def one(f):
        tr, te = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        tr, te = _scaled(tr, te, features, name)
        m = fit_model(name, tr, features, label, key, classification, classes, **params)
        return _score(m, te, label, classification, key)
    # folds are independent Spark jobs; a few driver threads keep the
    # cluster busy while small jobs wait on scheduling (as CrossValidator)
    with ThreadPoolExecutor(max_workers=_together(folded, min(PARALLELISM, k))) as pool:
        return list(pool.map(one, range(k)))


def _together(folded: DataFrame, most: int) -> int:
    """How many fits on ``folded`` run at a time: each holds its own copy of
    the rows' features in the executors, so fits on many rows take turns."""
    return most if folded.count() < ALONE_ROWS else 1


def cv_scores(data: DataFrame, features, label, key, name, classification, k: int = 5, classes=None,
              **params) -> list[float]:
    """Per-fold accuracy / R^2 of one model (E10, E11); scaling is fitted inside
    each fold."""
    folded = fold_column(data, key, k, label if classification else None)
    return _fold_scores(folded, features, label, key, name, classification, k, classes, **params)


def _mean_std(xs):
    xs = [x for x in xs if x is not None]
    if not xs:
        return None, None
    mu = sum(xs) / len(xs)
    return mu, (sum((x - mu) ** 2 for x in xs) / len(xs)) ** 0.5


def cv_folds(data: DataFrame, features, label, key, name, classification, k: int = 5) -> DataFrame:
    """Cross-validation analysis (E11) of all rows of ``data``: one row per
    fold plus mean, std (ddof=0) and best; a fold without a score (no rows, or
    a constant target) is left out of these."""
    s = cv_scores(data, features, label, key, name, classification, k)
    mu, sd = _mean_std(s)
    best = max((v for v in s if v is not None), default=None)
    rows = [(f"Fold {i + 1}", v) for i, v in enumerate(s)] + [("mean", mu), ("std", sd), ("max", best)]
    return data.sparkSession.createDataFrame(rows, "fold string, score double")


CLS_METRICS = ["accuracy", "precision", "recall", "f1", "cv_mean", "cv_std", "roc_auc"]
REG_METRICS = ["mse", "mae", "r2", "rmse", "cv_mean", "cv_std"]


def _scored(model, test, label, key) -> DataFrame:
    """(row_key, actual, prediction[, probability]) of the test rows, written
    once: metrics, curves and the returned rows all read it."""
    pred = model.transform(test, key) if isinstance(model, M.KNN) else model.transform(test)
    more = ["probability"] if "probability" in pred.columns else []
    return keep(pred.select(col(key).cast("string").alias("row_key"), col(label).alias("actual"), "prediction", *more), "scored")


def _metrics(pred: DataFrame, classification, classes) -> tuple[dict, DataFrame | None]:
    """Metrics of scored rows, and the ROC points of two-class probabilities."""
    if not classification:
        r = EV.regression_metrics(pred, "actual").first()
        return {k: r[k] for k in ("mse", "mae", "r2", "rmse")}, None
    prf = EV.metric_weighted_prf(pred, "actual").first()
    out = {"accuracy": EV.metric_accuracy(pred, "actual").first()["accuracy"], "precision": prf["precision"],
           "recall": prf["recall"], "f1": prf["f1"]}
    if not (classes and len(classes) == 2 and "probability" in pred.columns):
        return out, None
    sc = pred.select("actual", F.col("probability")[1].alias("score"))
    out["roc_auc"] = EV.roc_auc(sc, "actual", "score", classes[1]).first()["auc"]
    return out, EV.roc_curve(sc, "actual", "score", classes[1])


def refuse_wrong_target(df: DataFrame, target: str, classification: bool) -> None:
    """Raise (X12) for a continuous target with classification; and with
    regression for a target that is no number or holds whole numbers only
    (two values are binary, more are class codes)."""
    number = kind_of(df.schema[target].dataType) == "numeric"
    if not number:
        if not classification:
            raise ValueError(f"{target} holds no numbers: choose Classification")
        return
    found = PR.target_type(df, target).first()["target_type"]
    if classification and found == "continuous":
        raise ValueError(f"{target} is continuous: choose Regression")
    if not classification and found != "continuous":
        raise ValueError(f"{target} is {found}: choose Classification")


class Comparison(NamedTuple):
    """What a comparison leaves behind.  All frames read written files, so they
    stay valid and no model is run again."""

    metrics: DataFrame            # one row per model
    predictions: DataFrame        # (model, row_key, actual, predicted)
    points: DataFrame             # (model, threshold, fpr, tpr): ROC of two-class models
    models: dict                  # fitted models by name


def compare(df: DataFrame, target: str, features: list[str], problem_type: str, key: str,
            models: list[str] | None = None, test_size: float = 0.2, cv_folds_k: int = 5) -> Comparison:
    """Run the comparison (M15): prepare -> split (stratified for
    classification) -> per model fit, predict, CV and metrics.  A failing
    model gets an ``error`` and NULL metrics.  The prepared table and its
    folds are written once."""
    classification = problem_type == "Classification"
    menu = CLASSIFIERS if classification else REGRESSORS
    models = models or menu[:DEFAULT_COUNT]
    if not features:
        raise ValueError("no feature columns selected")
    if target in features:
        raise ValueError("the target column cannot be a feature")
    refuse_wrong_target(df, target, classification)
    spark = df.sparkSession
    data = PR.prepare(df, target, features, keep=[key])
    data = keep(PR.stratified_split(data, [key], target, test_size) if classification
                else PR.split(data, [key], test_size), "prepared")
    classes = M.class_list(data, target) if classification else None
    train, test = data.where(~F.col("is_test")).drop("is_test"), data.where(F.col("is_test")).drop("is_test")
    folded = None
    names = CLS_METRICS if classification else REG_METRICS
    rows, fitted = [], {}
    preds = spark.createDataFrame([], "model string, row_key string, actual string, predicted string")
    points = spark.createDataFrame([], "model string, threshold double, fpr double, tpr double")
    for order, name in enumerate(models):
        try:
            tr, te = _scaled(train, test, features, name)
            m = fit_model(name, tr, features, target, key, classification, classes)
            scored = _scored(m, te, target, key)
            met, curve = _metrics(scored, classification, classes)
            try:
                if folded is None:
                    folded = fold_column(train, key, cv_folds_k, target if classification else None)
                cvs = _fold_scores(folded, features, target, key, name, classification, cv_folds_k, classes)
                met["cv_mean"], met["cv_std"] = _mean_std(cvs)
            except Exception:  # noqa: BLE001 - CV failure leaves NULL, as a failed fit
                met["cv_mean"] = met["cv_std"] = None
            rows.append((order, name, *[met.get(k) for k in names], None))
            fitted[name] = m
            preds = preds.unionByName(scored.select(
                F.lit(name).alias("model"), "row_key", F.col("actual").cast("string").alias("actual"),
                F.col("prediction").cast("string").alias("predicted")))
            if curve is not None:
                points = points.unionByName(keep(curve.select(F.lit(name).alias("model"), "threshold", "fpr", "tpr"), "points"))
        except Exception as e:  # noqa: BLE001 - reported per model
            rows.append((order, name, *[None] * len(names), f"{type(e).__name__}: {e}"[:500]))
            traceback.print_exc(limit=1)
    schema = "ordinal int, model string, " + ", ".join(f"{k} double" for k in names) + ", error string"
    return Comparison(spark.createDataFrame(rows, schema), preds, points, fitted)


def compare_models(df: DataFrame, target: str, features: list[str], problem_type: str, key: str,
                   models: list[str] | None = None, test_size: float = 0.2, cv_folds_k: int = 5):
    """``(metrics, predictions)`` of :func:`compare`."""
    return compare(df, target, features, problem_type, key, models, test_size, cv_folds_k)[:2]


# The metric names of the result table.
READABLE = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1-Score",
            "cv_mean": "CV Mean", "cv_std": "CV Std", "roc_auc": "ROC-AUC", "mse": "MSE", "mae": "MAE",
            "r2": "R²", "rmse": "RMSE"}


def metrics_table(metrics: DataFrame) -> DataFrame:
    """One row per model in menu order with readable column names."""
    cols = [c for c in metrics.columns if c not in ("ordinal", "error")]
    return metrics.orderBy("ordinal").select(
        *[F.col(c).alias(READABLE.get(c, "Model" if c == "model" else c)) for c in cols])


LOWER_IS_BETTER = {"mse", "mae", "rmse", "cv_std"}


def metric_extremes(metrics: DataFrame) -> DataFrame:
    """Best and worst model per metric (E13); ties -> first listed model."""
    names = [c for c in metrics.columns if c not in ("ordinal", "model", "error")]
    long = metrics.select("ordinal", "model", F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])))
    long = long.where(F.col("value").isNotNull())
    return long.groupBy("metric").agg(
        F.max_by("model", F.struct(F.col("value"), -F.col("ordinal"))).alias("max_model"),
        F.max("value").alias("max_value"),
        F.min_by("model", F.struct(F.col("value"), F.col("ordinal"))).alias("min_model"),
        F.min("value").alias("min_value"))


def recommend_model(metrics: DataFrame, problem_type: str) -> DataFrame:
    """Recommendation (E14).  Classification: best accuracy, F1 and CV mean;
    recommend the best F1 (accuracy when F1 is missing).  Regression: best
    R^2, lowest RMSE, best CV mean; recommend the best R^2.  Ties -> first
    listed model."""
    def best(c, lowest=False):
        v = F.col(c) if not lowest else -F.col(c)
        return F.max_by("model", F.struct(v, -F.col("ordinal")))
    ok = metrics.where(F.col("error").isNull())
    if problem_type == "Classification":
        has_f1 = F.count("f1") > 0
        agg = ok.agg(best("accuracy").alias("best_accuracy"), best("f1").alias("best_f1"),
                     best("cv_mean").alias("best_cv"), has_f1.alias("__f1"))
        return agg.select("best_accuracy", "best_f1", "best_cv",
                          F.when(F.col("__f1"), F.col("best_f1")).otherwise(F.col("best_accuracy"))
                          .alias("recommended"))
    agg = ok.agg(best("r2").alias("best_r2"), best("rmse", True).alias("best_rmse"), best("cv_mean").alias("best_cv"))
    return agg.select("best_r2", "best_rmse", "best_cv", F.col("best_r2").alias("recommended"))


# ------------------------------------------------------------ quick preview
def quick_model(df: DataFrame, target: str, key: str, features: list[str] | None = None,
                problem_type: str | None = None) -> tuple[DataFrame, M.FittedModel | None, DataFrame]:
    """Quick model (M10): label-encode text features (and a text target), fill
    nulls with the mode, split 80/20 by md5 order, fit logistic (max 200
    iterations) or OLS; accuracy or R^2, the fitted model, and the encoded rows
    it was fitted and scored on.  Rows with a null target are dropped first."""
    feats = features or [c for c in df.columns if c not in (target, key)]
    data = df.select(col(key), *[col(c) for c in feats], col(target)).dropna(subset=[target])
    PR.min_rows_guard(data)
    txt = [c for c in feats if PR._is_text(data, c)]
    if problem_type == "Classification" and PR._is_text(data, target):
        txt = txt + [target]
    data = PR.label_encode(data, txt) if txt else data
    data = keep(PR.split(PR.impute_mode(data, feats), [key], 0.2), "quick")
    tr, te = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    spark, m, out = df.sparkSession, None, []
    if problem_type == "Classification":
        m = M.logistic(tr, feats, target, max_iter=200)
        out = [("Accuracy", EV.metric_accuracy(m.transform(te), target).first()["accuracy"])]
    elif problem_type == "Regression":
        m = M.linear(tr, feats, target)
        out = [("R²", EV.regression_metrics(m.transform(te), target).first()["r2"])]
    return spark.createDataFrame(out, "metric string, value double"), m, data


def quick_preview(df: DataFrame, target: str, key: str, features: list[str] | None = None,
                  problem_type: str | None = None) -> DataFrame:
    """The score of :func:`quick_model`."""
    return quick_model(df, target, key, features, problem_type)[0]


# ----------------------------------------------------------- interpretation
def forest_importance(df: DataFrame, target: str, key: str, num_trees: int = 100) -> DataFrame:
    """Random-forest importances of every other column for ``target`` (M11);
    text columns are label-encoded on a copy (the input is not modified)."""
    feats = [c for c in df.columns if c not in (target, key)]
    txt = [c for c in df.columns if c != key and PR._is_text(df, c)]
    data = PR.label_encode(df, txt) if txt else df
    m = M.random_forest(M.fixed_layout(data, [key]), feats, target, True, num_trees=num_trees)
    return model_importance(m, df.sparkSession)


def model_importance(model: M.FittedModel, spark) -> DataFrame:
    """Importances, else |coefficients| of the first class (M12), sorted
    descending (ties by feature name)."""
    imp = model.importances()
    if imp is None:
        co = model.coefficients()
        if co is None:
            raise ValueError("this model has neither importances nor coefficients")
        first = co[0][0]
        imp = [(f, abs(v)) for c, f, v in co if c == first]
    rows = sorted(imp, key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def model_coefficients(model: M.FittedModel, spark, top: int | None = None) -> DataFrame:
    """Model interpretation (M13): importances (top 10), or signed
    coefficients per class, sorted by absolute value."""
    imp = model.importances()
    if imp is not None:
        rows = [(None, f, v) for f, v in sorted(imp, key=lambda r: (-r[1], r[0]))]
    else:
        co = model.coefficients() or []
        rows = sorted(co, key=lambda r: (str(r[0]), -abs(r[2]), r[1]))
    if top:
        rows = rows[:top]
    return spark.createDataFrame(rows, "class string, feature string, value double")


def batch_predict(model: M.FittedModel, new: DataFrame, key: str | None = None) -> DataFrame:
    """Batch prediction (M14): the fitted model's columns are read from the new
    table; output ``Predictions`` and ``Probability_Class_i``."""
    out = model.transform(new, key) if isinstance(model, M.KNN) else model.transform(new)
    sel = [col(c) for c in new.columns] + [F.col("prediction").alias("Predictions")]
    n = len(model.classes) if model.classes else getattr(model, "n_classes", 0)
    if "probability" in out.columns:
        sel += [F.col("probability")[i].alias(f"Probability_Class_{i}") for i in range(n)]
    return out.select(*sel)


# ---------------------------------------------------------- selection: RFE
def rfe(df: DataFrame, features: list[str], label: str, key: str, n: int | None = None,
        classification: bool = True, num_trees: int = 50) -> DataFrame:
    """Recursive feature elimination (X10): refit a 50-tree forest and drop
    the least important feature until ``n`` (default min(5, d)) remain.
    Ranking 1 = selected, larger = eliminated earlier."""
    n = min(5, len(features)) if n is None else n
    df = keep(df.select(col(key), *[col(f) for f in features], col(label)), "rfe")
    data = M.fixed_layout(df, [key])
    cur, dropped = list(features), []
    while len(cur) > n:
        m = M.random_forest(data, cur, label, classification, num_trees=num_trees)
        imp = dict(m.importances())
        worst = min(cur, key=lambda f: (imp[f], -cur.index(f)))
        cur.remove(worst)
        dropped.append(worst)
    rows = [(f, 1) for f in cur] + [(f, len(dropped) - i + 1) for i, f in enumerate(dropped)]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int")


def keep_rfe(df: DataFrame, features: list[str], label: str, key: str, n: int | None = None,
             classification: bool = True, num_trees: int = 50) -> DataFrame:
    """``df`` without the features that :func:`rfe` eliminates."""
    ranked = rfe(df, features, label, key, n, classification, num_trees).collect()
    best = {r["feature"] for r in ranked if r["ranking"] == 1}
    return df.select(*[col(c) for c in df.columns if c not in features or c in best])


# ------------------------------------------------------------------ tuning
def param_grids() -> dict:
    """Parameter grids (T3) on the axes that Spark's models have: an unbounded
    depth is MLlib's maximum 30, the leaf size is ``minInstancesPerNode``, the
    penalty is ``elasticNetParam`` (1: L1, 0: L2).  The smallest node to split
    and the solver have no counterpart."""
    forest = {"num_trees": [50, 100, 200], "max_depth": [30, 10, 20], "min_leaf": [1, 2, 4]}
    return {
        "Random Forest": forest,
        "Logistic Regression": {"C": [0.1, 1.0, 10.0], "elastic_net": [1.0, 0.0]},
        "SVM": {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]},
        "Gradient Boosting": {"rounds": [50, 100, 200], "rate": [0.01, 0.1, 0.2], "depth": [3, 5, 7]},
    }


class Search(NamedTuple):
    """A search's table (params, mean_score, std_score, best), its best
    parameters and score, and the model refitted with these on all rows."""

    table: DataFrame
    best_params: dict
    best_score: float | None
    model: M.FittedModel


def _combos(name: str, grid: dict | None) -> list[dict]:
    grid = grid or param_grids().get(name)
    if not grid:
        raise ValueError(f"nothing to search for model {name!r}")
    return [dict(zip(grid, v)) for v in itertools.product(*grid.values())]


def _search(data, features, label, key, name, classification, combos, k) -> Search:
    """All combinations on the same written folds; ties go to the first."""
    folded = fold_column(data, key, k, label if classification else None)
    classes = M.class_list(data, label) if classification else None

    def one(combo):
        return _mean_std(_fold_scores(folded, features, label, key, name, classification, k, classes, **combo))
    with ThreadPoolExecutor(max_workers=_together(folded, 2)) as pool:
        scores = list(pool.map(one, combos))
    best = max(range(len(combos)), key=lambda i: (scores[i][0] if scores[i][0] is not None else float("-inf"), -i))
    rows = [(str(sorted(c.items())), m, s, i == best) for i, (c, (m, s)) in enumerate(zip(combos, scores))]
    table = data.sparkSession.createDataFrame(rows, "params string, mean_score double, std_score double, best boolean")
    model = fit_model(name, _scaled(data, data, features, name)[0], features, label, key, classification, classes, **combos[best])
    return Search(table, combos[best], scores[best][0], model)


def search_grid(data, features, label, key, name, classification=True, k: int = 5, grid: dict | None = None) -> Search:
    """Grid search with k-fold CV (T1) over every combination."""
    return _search(data, features, label, key, name, classification, _combos(name, grid), k)


def search_random(data, features, label, key, name, classification=True, k: int = 5, n_iter: int = 20,
                  seed: int = M.SEED, grid: dict | None = None) -> Search:
    """Random search (T2): ``n_iter`` combinations drawn without replacement
    with a seeded generator (the whole grid when smaller)."""
    combos = _combos(name, grid)
    if len(combos) > n_iter:
        combos = random.Random(seed).sample(combos, n_iter)
    return _search(data, features, label, key, name, classification, combos, k)


def grid_search(data, features, label, key, name, classification=True, k: int = 5, grid: dict | None = None) -> DataFrame:
    """The table of :func:`search_grid`: one row per combination, the best flagged."""
    return search_grid(data, features, label, key, name, classification, k, grid).table


def random_search(data, features, label, key, name, classification=True, k: int = 5, n_iter: int = 20,
                  seed: int = M.SEED, grid: dict | None = None) -> DataFrame:
    """The table of :func:`search_random`."""
    return search_random(data, features, label, key, name, classification, k, n_iter, seed, grid).table


# --------------------------------------------------------------- ensembles
def _with_scaled(df: DataFrame, fit: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with scaled copies of the features beside them."""
    names = [f"__z{i}" for i in range(len(features))]

    def copies(x):
        return x.select("*", *[numeric_value(x, f).alias(z) for f, z in zip(features, names)])
    return PR.standard_scale(copies(df), names, fit=copies(fit)), names


def voting_classifier(train, test, features, label, key) -> DataFrame:
    """Soft voting (T4): mean class probabilities of a 50-tree forest,
    logistic regression and the Fourier-feature SVM whose margins are turned
    into probabilities with Platt scaling (binary) or a softmax.  The members
    score one after another, each into a column of its own: no join."""
    classes = M.class_list(train, label)
    trs, z = _with_scaled(train, train, features)
    out, _ = _with_scaled(test.select(col(key), col(label), *[col(f) for f in features]), train, features)
    rf = M.random_forest(M.fixed_layout(train, [key]), features, label, True, num_trees=50, classes=classes)
    lr, svm = M.logistic(trs, z, label, classes=classes), M.svm_rbf(trs, z, label, classes=classes)
    out = rf.transform(out).drop("prediction").withColumnRenamed("probability", "__p0")
    out = lr.transform(out).drop("prediction").withColumnRenamed("probability", "__p1")
    out = svm.probabilities(out, trs).withColumnRenamed("probability", "__p2")
    avg = F.zip_with(F.zip_with("__p0", "__p1", lambda a, b: a + b), "__p2", lambda a, b: (a + b) / 3.0)
    out = out.withColumn("probability", avg)
    idx = F.array_position("probability", F.array_max("probability")) - 1
    return out.select(col(key), col(label), "probability", M._label_of(idx, classes).alias("prediction"))


def voting_regressor(train, test, features, label, key) -> DataFrame:
    """Mean of a 50-tree forest, OLS and the Fourier-feature SVR (T5), scored
    one after another without a join."""
    trs, z = _with_scaled(train, train, features)
    out, _ = _with_scaled(test.select(col(key), col(label), *[col(f) for f in features]), train, features)
    members = (M.random_forest(M.fixed_layout(train, [key]), features, label, False, num_trees=50),
               M.linear(train, features, label), M.svr_rbf(trs, z, label))
    for i, m in enumerate(members):
        out = m.transform(out).withColumnRenamed("prediction", f"__p{i}")
    return out.select(col(key), col(label), ((F.col("__p0") + F.col("__p1") + F.col("__p2")) / 3).alias("prediction"))


def bagging(train, test, features, label, key, classification=True, n_estimators: int = 50) -> DataFrame:
    """Bagging of full-feature trees on bootstrap samples (T6) = a random
    forest with every feature considered at every split."""
    m = M.random_forest(M.fixed_layout(train, [key]), features, label, classification, num_trees=n_estimators,
                        feature_subset="all", bootstrap=True, name="Bagging")
    return m.transform(test).select(col(key), col(label), "prediction")


def boosting(train, test, features, label, key, classification=True, rounds: int = 100,
             rate: float = 0.1) -> DataFrame:
    """Gradient boosting."""
    m = M.gbt(train, features, label, classification, rounds=rounds, rate=rate, name="Boosting")
    return m.transform(test).select(col(key), col(label), "prediction")
