"""Registered queries: one per inventory operator, each ``(spark, sf_dir) ->
DataFrame`` over the whole driver tables (or data Spark derives from them).

Computed doubles are rounded to 6 significant digits (``round_doubles``) so
that an exact value hash against another engine does not depend on summation
order; the operators themselves return full precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.functions.columns import round_doubles, sig_round
from tabsight.operators import profile as P
from tabsight.plans import fixtures as X
from tabsight.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, d, _fn=fn: round_doubles(_fn(spark, d))
    return fn


def T(spark, d, name):
    return load_table(spark, d, name)


# ---- stage 1: profile -------------------------------------------------------
@query
def summary_numeric(spark, d):
    return P.summary_numeric(T(spark, d, "lineitem"))


@query
def summary_text(spark, d):
    return P.summary_text(X.events_nulls(spark, d))


@query
def summary_timestamp(spark, d):
    return P.summary_timestamp(T(spark, d, "lineitem"))


@query
def column_info(spark, d):
    return P.column_info(X.events_nulls(spark, d))


@query
def quality_report(spark, d):
    return P.quality_report(T(spark, d, "customer"))


@query
def missing_by_column(spark, d):
    return P.missing_by_column(X.events_nulls(spark, d))


@query
def missing_cells(spark, d):
    return P.missing_cells(X.events_nulls(spark, d))


@query
def table_shape(spark, d):
    return P.table_shape(T(spark, d, "lineitem"))


@query
def kind_counts(spark, d):
    return P.kind_counts(T(spark, d, "lineitem"))


@query
def duplicate_rows(spark, d):
    return P.duplicate_rows(X.orders_repeated(spark, d))


@query
def distinct_counts(spark, d):
    return P.distinct_counts(T(spark, d, "orders"))


@query
def logical_bytes(spark, d):
    return P.logical_bytes(T(spark, d, "documents"))


@query
def value_counts(spark, d):
    return P.value_counts(X.events_nulls(spark, d), "event_type")


@query
def value_shares(spark, d):
    return P.value_shares(T(spark, d, "customer"), "c_mktsegment")


@query
def skewness(spark, d):
    return P.skewness(T(spark, d, "events"))


@query
def preview(spark, d):
    return P.preview(T(spark, d, "customer"), "c_custkey", 10)


# ---- stage 2: distributions, outliers, correlation, tests --------------------
from tabsight.operators import distribution as D  # noqa: E402
from tabsight.operators import stats as S  # noqa: E402

EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_netprice"]
EMB_COLS = [f"e{i}" for i in range(64)]


@query
def histogram(spark, d):
    return D.histogram(X.events_nulls(spark, d), "value", 30)


@query
def outliers_iqr(spark, d):
    return D.outliers_iqr(T(spark, d, "events").select(*EV_COLS), "value")


@query
def outliers_zscore(spark, d):
    return D.outliers_zscore(T(spark, d, "events").select(*EV_COLS), "value")


@query
def outliers_mad(spark, d):
    return D.outliers_mad(T(spark, d, "events").select(*EV_COLS), "value")


@query
def outlier_counts(spark, d):
    return D.outlier_counts(T(spark, d, "events"), "value")


@query
def outlier_total(spark, d):
    return D.outlier_total(X.events_nulls(spark, d))


@query
def box_stats(spark, d):
    return D.box_stats(T(spark, d, "events"), "value")


@query
def outliers_cap_iqr(spark, d):
    return D.outliers_cap_iqr(X.events_nulls(spark, d).select("event_id", "value"), ["value"])


@query
def outliers_remove_iqr(spark, d):
    return D.outliers_remove_iqr(T(spark, d, "events").select(*EV_COLS), ["value", "user_id"])


@query
def correlation_matrix(spark, d):
    return S.correlation_matrix(X.lineitem_targets(spark, d), CORR_COLS).select("col_x", "col_y", "corr")


@query
def correlation_wide(spark, d):
    # all 64 coordinates: pairs summed as matrices, no expression per pair
    return S.correlation_matrix(X.embeddings_wide(spark, d), EMB_COLS).select("col_x", "col_y", "corr")


@query
def top_correlations(spark, d):
    return S.top_correlations(X.lineitem_targets(spark, d), CORR_COLS, 3)


@query
def high_corr_pairs(spark, d):
    return S.high_corr_pairs(X.lineitem_targets(spark, d), CORR_COLS)


@query
def ttest_pooled(spark, d):
    return S.ttest_pooled(T(spark, d, "lineitem"), "l_discount", "l_tax")


@query
def ttest_pvalue(spark, d):
    ev = T(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("even"),
                                      F.when(F.col("event_id") % 2 == 1, F.col("value")).alias("odd"))
    return S.ttest_pvalue(T(spark, d, "lineitem"), "l_discount", "l_tax").unionByName(S.ttest_pvalue(ev, "even", "odd"))


@query
def f_classif(spark, d):
    return S.f_classif(X.embeddings_wide(spark, d), EMB_COLS, "label")


@query
def f_regression(spark, d):
    return S.f_regression(X.lineitem_targets(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                          "target_reg")


@query
def select_k_best(spark, d):
    return S.select_k_best(X.embeddings_wide(spark, d), EMB_COLS, "label", 5)


# ---- stage 3: rule reports ---------------------------------------------------
from tabsight.operators import rules as RU  # noqa: E402


@query
def insights(spark, d):
    return RU.insights(X.events_nulls(spark, d)).select("rule_id", "rule", "column_name", "value")


@query
def suggestions(spark, d):
    lab = T(spark, d, "labels")
    return RU.suggestions(lab.select("doc_id", "quality", F.col("toxic").cast("string").alias("toxic"))) \
        .select("rule_id", "rule", "column_name", "value")


# ---- stage 4: preprocessing --------------------------------------------------
from tabsight.operators import prepare as PR  # noqa: E402

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query
def impute_mean(spark, d):
    return PR.impute_mean(X.events_nulls(spark, d).select("event_id", "value"), ["value"])


@query
def impute_median(spark, d):
    return PR.impute_median(X.events_nulls(spark, d).select("event_id", "value"), ["value"])


@query
def impute_mode(spark, d):
    return PR.impute_mode(X.events_nulls(spark, d).select("event_id", "event_type", "value"),
                          ["event_type", "value"])


@query
def impute_constant(spark, d):
    return PR.impute_constant(X.events_nulls(spark, d).select("event_id", "event_type", "value"),
                              ["event_type", "value"], "0")


@query
def label_encode(spark, d):
    return PR.label_encode(T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"),
                           ["c_name", "c_mktsegment"])


@query
def standard_scale(spark, d):
    return PR.standard_scale(T(spark, d, "lineitem").select(*LI_KEY, "l_quantity", "l_extendedprice"),
                             ["l_quantity", "l_extendedprice"])


@query
def minmax_scale(spark, d):
    return PR.minmax_scale(T(spark, d, "lineitem").select(*LI_KEY, "l_quantity", "l_extendedprice"),
                           ["l_quantity", "l_extendedprice"])


@query
def preprocess(spark, d):
    return PR.preprocess(X.events_nulls(spark, d).select("event_id", "user_id", "value"), ["user_id", "value"],
                         missing="median", scaling="standard", outliers="cap")


@query
def impute_by_column(spark, d):
    ev = X.events_nulls(spark, d).select("event_id", "event_type", "value", "user_id")
    return PR.impute_by_column(ev, {"event_type": "constant", "value": "median", "user_id": "drop"}, {"event_type": "none"})


@query
def impute_drop(spark, d):
    return PR.impute_drop(X.events_nulls(spark, d).select("event_id", "event_type", "value"), ["event_type", "value"])


@query
def append_by_name(spark, d):
    cu = T(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    su = T(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"),
                                        F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return PR.append_by_name(cu, su)


@query
def prepare(spark, d):
    return PR.prepare(X.events_nulls(spark, d), "event_type", ["user_id", "value", "props"], keep=["event_id"])


@query
def split(spark, d):
    return PR.split(T(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 0.2)


@query
def stratified_split(spark, d):
    return PR.stratified_split(X.lineitem_targets(spark, d).select(*LI_KEY, "target_cls"), LI_KEY,
                               "target_cls", 0.2)


@query
def target_type(spark, d):
    li = X.lineitem_targets(spark, d)
    return PR.target_type(li, "target_bin").unionByName(PR.target_type(li, "target_reg")) \
        .unionByName(PR.target_type(li, "target_cls"))


@query
def problem_type(spark, d):
    li = X.lineitem_targets(spark, d)
    return PR.problem_type(li, "target_bin").unionByName(PR.problem_type(li, "target_reg")) \
        .unionByName(PR.problem_type(li, "target_cls"))


# ---- stage 5: evaluation -----------------------------------------------------
from tabsight.operators import evaluate as EV  # noqa: E402


@query
def metric_accuracy(spark, d):
    return EV.metric_accuracy(X.prediction_table(spark, d))


@query
def metric_weighted_prf(spark, d):
    return EV.metric_weighted_prf(X.class_predictions(spark, d))


@query
def confusion_matrix(spark, d):
    return EV.confusion_matrix(X.class_predictions(spark, d))


@query
def classification_report(spark, d):
    return EV.classification_report(X.class_predictions(spark, d))


@query
def roc_curve(spark, d):
    return EV.roc_curve(X.prediction_table(spark, d))


@query
def roc_auc(spark, d):
    return EV.roc_auc(X.prediction_table(spark, d))


@query
def pr_curve(spark, d):
    return EV.pr_curve(X.prediction_table(spark, d))


@query
def regression_metrics(spark, d):
    return EV.regression_metrics(X.regression_predictions(spark, d))


@query
def residuals(spark, d):
    return EV.residuals(X.regression_predictions(spark, d), LI_KEY)


@query
def residual_histogram(spark, d):
    return EV.residual_histogram(X.regression_predictions(spark, d))


# ---- stage 6: models ---------------------------------------------------------
from tabsight.operators import models as M  # noqa: E402


def _emb_split(spark, d):
    e = PR.split(X.embeddings_wide(spark, d), ["vec_id"], 0.2)
    return e.where(~F.col("is_test")).drop("is_test"), e.where(F.col("is_test")).drop("is_test")


def _li_split(spark, d):
    li = PR.split(X.lineitem_targets(spark, d).withColumn("l_key", PR.key_column(LI_KEY)), ["l_key"], 0.2)
    return li.where(~F.col("is_test")).drop("is_test"), li.where(F.col("is_test")).drop("is_test")


REG_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query
def gaussian_nb(spark, d):
    tr, te = _emb_split(spark, d)
    return M.gaussian_nb(tr, EMB_COLS, "ring").transform(te).select("vec_id", "prediction")


@query
def knn_classify(spark, d):
    tr, te = _emb_split(spark, d)
    return M.knn(tr, EMB_COLS, "ring", "vec_id", True).transform(te).select(
        "vec_id", F.col("prediction").cast("int").alias("prediction"))


@query
def knn_rings(spark, d):
    # the same search over several pivot cells and rings
    tr, te = _emb_split(spark, d)
    m = M.knn(tr, EMB_COLS, "ring", "vec_id", True)
    m.pivots, m.block_rows = 8, 100
    return m.transform(te).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query
def knn_regress(spark, d):
    tr, te = _emb_split(spark, d)
    return M.knn(tr, EMB_COLS, "radius2", "vec_id", False).transform(te).select("vec_id", "prediction")


@query
def linear(spark, d):
    m = M.linear(X.lineitem_targets(spark, d), ["l_quantity"], "target_reg")
    st = m.stage
    return spark.createDataFrame([("intercept", float(st.intercept)), ("l_quantity", float(st.coefficients[0]))],
                                 "term string, value double")


@query
def pca_loadings(spark, d):
    return M.pca_loadings(X.lineitem_targets(spark, d), ["l_extendedprice", "l_netprice"], 2)


@query
def pca_scores(spark, d):
    # the two columns correlate at 0.998, so PC2 scores cancel about three
    # digits; they are compared at 4 significant digits
    s = M.pca_scores(X.lineitem_targets(spark, d), ["l_extendedprice", "l_netprice"], LI_KEY, 2)
    return s.select(*LI_KEY, sig_round("PC1", 4).alias("PC1"), sig_round("PC2", 4).alias("PC2"))


PART = ["gap", "price", "noise"]


def _part_split(spark, d):
    p = PR.split(X.part_planted(spark, d), ["p_partkey"], 0.2)
    return p.where(~F.col("is_test")).drop("is_test"), p.where(F.col("is_test")).drop("is_test")


def _fitted(spark, d, fit, label):
    """Test rows with what ``fit`` (on the train rows) predicts for ``label``."""
    tr, te = _part_split(spark, d)
    return fit(tr).transform(te).select("p_partkey", F.col(label).alias("actual"), "prediction")


@query
def logistic(spark, d):
    return _fitted(spark, d, lambda tr: M.logistic(tr, ["gap"], "cls"), "cls")


@query
def random_forest(spark, d):
    return _fitted(spark, d, lambda tr: M.random_forest(M.fixed_layout(tr, ["p_partkey"]), PART, "cls"), "cls")


@query
def forest_regressor(spark, d):
    return _fitted(spark, d, lambda tr: M.random_forest(M.fixed_layout(tr, ["p_partkey"]), PART, "num", False), "num")


@query
def decision_tree(spark, d):
    return _fitted(spark, d, lambda tr: M.decision_tree(tr, PART, "num", classification=False), "num")


@query
def tree_classifier(spark, d):
    return _fitted(spark, d, lambda tr: M.decision_tree(tr, PART, "cls"), "cls")


@query
def gbt(spark, d):
    return _fitted(spark, d, lambda tr: M.gbt(tr, PART, "bin", rounds=20), "bin")


@query
def gbt_regressor(spark, d):
    return _fitted(spark, d, lambda tr: M.gbt(tr, PART, "num", False, rounds=20), "num")


@query
def gbt_classes(spark, d):
    return _fitted(spark, d, lambda tr: M.gbt(tr, PART, "cls", rounds=10), "cls")


@query
def svm_rbf(spark, d):
    return _fitted(spark, d, lambda tr: M.svm_rbf(tr, ["gap"], "bin"), "bin")


@query
def svm_classes(spark, d):
    return _fitted(spark, d, lambda tr: M.svm_rbf(tr, ["gap"], "cls"), "cls")


@query
def svm_linear(spark, d):
    return _fitted(spark, d, lambda tr: M.svm_rbf(tr, ["gap"], "bin", kernel="linear"), "bin")


@query
def svr_rbf(spark, d):
    # an approximation: what is checked is that it explains the target
    out = _fitted(spark, d, lambda tr: M.svr_rbf(tr, ["gap"], "lin"), "lin")
    return EV.regression_metrics(out, "actual").select("n", (F.col("r2") > 0.9).alias("explains"))


# ---- stage 7: comparison, tuning, ensembles ----------------------------------
from tabsight.plans import compare as C  # noqa: E402


@query
def compare_models(spark, d):
    p = X.part_planted(spark, d).select("p_partkey", "gap", "bin")
    metrics, _ = C.compare_models(p, "bin", ["gap"], "Classification", "p_partkey")
    return metrics.drop("error")


@query
def compare_regression(spark, d):
    p = X.part_planted(spark, d).select("p_partkey", *PART, "num")
    metrics, _ = C.compare_models(p, "num", PART, "Regression", "p_partkey", ["Random Forest", "Decision Tree"], cv_folds_k=3)
    return metrics.drop("error")


@query
def comparison_points(spark, d):
    # ROC points of the comparison: every curve goes from (0, 0) over (0, 1) to (1, 1)
    p = X.part_planted(spark, d).select("p_partkey", "gap", "bin")
    c = C.compare(p, "bin", ["gap"], "Classification", "p_partkey", ["Logistic Regression", "Decision Tree"], cv_folds_k=2)
    return c.points.groupBy("model").agg(
        F.min("fpr").alias("first_fpr"), F.max(F.when(F.col("fpr") == 0, F.col("tpr"))).alias("best_tpr"),
        F.max("fpr").alias("last_fpr"), F.max("tpr").alias("last_tpr"))


@query
def cv_scores(spark, d):
    s = C.cv_scores(X.part_planted(spark, d), ["gap"], "cls", "p_partkey", "Logistic Regression", True, 5)
    mu, sd = C._mean_std(s)
    return spark.createDataFrame([("Logistic Regression", mu, sd)], "model string, cv_mean double, cv_std double")


@query
def cv_folds(spark, d):
    return C.cv_folds(X.embeddings_wide(spark, d), EMB_COLS, "ring", "vec_id", "Naive Bayes", True, 5)


@query
def metrics_table(spark, d):
    return C.metrics_table(X.rule_model_metrics(spark, d))


@query
def metric_extremes(spark, d):
    return C.metric_extremes(X.rule_model_metrics(spark, d))


@query
def recommend_model(spark, d):
    return C.recommend_model(X.rule_model_metrics(spark, d), "Classification")


@query
def recommend_regression(spark, d):
    # three shifts of one prediction, compared by their errors
    base = X.regression_predictions(spark, d)
    rows = []
    for i, shift in enumerate((0.0, -2.0, 5.0)):
        m = EV.regression_metrics(base.withColumn("prediction", F.col("prediction") + shift)).first()
        rows.append((i, f"Shift {shift}", m["mse"], m["mae"], m["r2"], m["rmse"], m["r2"], None, None))
    table = spark.createDataFrame(rows, "ordinal int, model string, mse double, mae double, r2 double, rmse double, "
                                        "cv_mean double, cv_std double, error string")
    return C.recommend_model(table, "Regression")


@query
def rfe(spark, d):
    p = X.part_planted(spark, d)
    return C.rfe(p, PART, "cls", "p_partkey", 1, num_trees=20).where("ranking = 1")


@query
def grid_search(spark, d):
    return C.grid_search(X.part_planted(spark, d), ["gap"], "cls", "p_partkey", "Logistic Regression", True, 3)


@query
def random_search(spark, d):
    t = C.random_search(X.part_planted(spark, d), ["gap"], "bin", "p_partkey", "SVM", True, 3, n_iter=4)
    return t.agg(F.count(F.lit(1)).alias("n_drawn"), F.count_distinct("params").alias("n_different"),
                 F.sum(F.col("best").cast("int")).alias("n_best"), F.min("mean_score").alias("least_score"))


@query
def search_model(spark, d):
    # the refitted best model of a search, applied to rows it has not seen
    tr, te = _part_split(spark, d)
    best = C.search_grid(tr, ["gap"], "cls", "p_partkey", "Logistic Regression", True, 3, {"C": [1.0, 10.0]})
    scaled = PR.standard_scale(te, ["gap"], fit=tr)
    return best.model.transform(scaled).select("p_partkey", F.col("cls").alias("actual"), "prediction")


@query
def voting_classifier(spark, d):
    tr, te = _part_split(spark, d)
    return C.voting_classifier(tr, te, ["gap"], "cls", "p_partkey").select("p_partkey", F.col("cls").alias("actual"), "prediction")


@query
def voting_regressor(spark, d):
    tr, te = _part_split(spark, d)
    out = C.voting_regressor(tr, te, ["gap", "noise"], "lin", "p_partkey")
    return EV.regression_metrics(out, "lin").select("n", (F.col("r2") > 0.95).alias("explains"))


@query
def bagging(spark, d):
    tr, te = _part_split(spark, d)
    return C.bagging(tr, te, PART, "cls", "p_partkey").select("p_partkey", F.col("cls").alias("actual"), "prediction")


@query
def boosting(spark, d):
    tr, te = _part_split(spark, d)
    return C.boosting(tr, te, PART, "bin", "p_partkey", rounds=20).select("p_partkey", F.col("bin").alias("actual"), "prediction")


@query
def quick_preview(spark, d):
    p = X.part_planted(spark, d)
    a = C.quick_preview(p.select("p_partkey", "gap", "cls"), "cls", "p_partkey", problem_type="Classification")
    b = C.quick_preview(p.select("p_partkey", "gap", "noise", "lin"), "lin", "p_partkey", problem_type="Regression")
    return a.unionByName(b)


def _first(importances):
    """The most important feature, and what all importances add up to."""
    return importances.agg(F.max_by("feature", "importance").alias("first"), F.sum("importance").alias("total"))


@query
def forest_importance(spark, d):
    return _first(C.forest_importance(X.part_planted(spark, d).select("p_partkey", *PART, "cls"), "cls", "p_partkey", 30))


@query
def model_importance(spark, d):
    tr, _ = _part_split(spark, d)
    m = M.linear(tr, ["gap", "noise"], "lin")
    return C.model_importance(m, spark)


@query
def model_coefficients(spark, d):
    tr, _ = _part_split(spark, d)
    return C.model_coefficients(M.linear(tr, ["noise", "gap"], "lin"), spark).select("feature", "value")


@query
def batch_predict(spark, d):
    tr, te = _emb_split(spark, d)
    out = C.batch_predict(M.gaussian_nb(tr, EMB_COLS, "ring"), te.select("vec_id", *EMB_COLS))
    return out.select("vec_id", "Predictions", "Probability_Class_0", "Probability_Class_1")


@query
def naive_bayes_table(spark, d):
    # the many-class form on the whole table: o_custkey // 10 as class of an order
    o = T(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"),
                                     F.floor(F.col("o_custkey") / 5).cast("long").alias("y"))
    return M.gaussian_nb(o, ["x"], "y").transform(o).select("o_orderkey", F.col("prediction"))


# ---- stage 8: sources and sinks ----------------------------------------------
from tabsight.sources import files as FI  # noqa: E402
from tabsight.sources import model_store as MS  # noqa: E402

EVN = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query
def read_csv(spark, d):
    path = FI.scratch_path(spark, "events-csv")
    FI.write_csv(X.events_nulls(spark, d).select(*EVN), path)
    return FI.read_csv(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def read_json(spark, d):
    path = FI.scratch_path(spark, "events-json")
    X.events_nulls(spark, d).select(*EVN).write.options(**FI.MICROSECONDS).json(path)
    return FI.read_json(spark, path).select(*EVN).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def read_workbooks(spark, d):
    path = FI.scratch_path(spark, "customer-xlsx")
    FI.write_workbooks(T(spark, d, "customer"), path)
    return FI.read_workbooks(spark, path)


@query
def write_predictions(spark, d):
    tr, te = _emb_split(spark, d)
    scored = C.batch_predict(M.gaussian_nb(tr, EMB_COLS, "ring"), te.select("vec_id", *EMB_COLS))
    path = FI.scratch_path(spark, "predictions")
    FI.write_predictions(scored.select("vec_id", F.col("Predictions").alias("prediction")), path)
    return FI.read_csv(spark, path).select(F.col("vec_id"), F.col("prediction").cast("int").alias("prediction"))


@query
def save_model(spark, d):
    tr, te = _emb_split(spark, d)
    store = FI.scratch_path(spark, "models")
    fname = MS.save_model(M.gaussian_nb(tr, EMB_COLS, "ring"), store)
    return MS.load_model(store, fname).transform(te).select("vec_id", "prediction")


@query
def register_model(spark, d):
    tr, _ = _emb_split(spark, d)
    store = FI.scratch_path(spark, "models")
    MS.save_model(M.logistic(tr, EMB_COLS, "ring"), store)
    MS.save_model(M.gaussian_nb(tr, EMB_COLS, "ring"), store)
    return MS.list_models(spark, store).select("model_name", "is_classification")


@query
def load_model(spark, d):
    tr, te = _emb_split(spark, d)
    store = FI.scratch_path(spark, "models")
    fname = MS.save_model(M.knn(tr, EMB_COLS, "ring", "vec_id", True), store)
    return MS.load_model(store, fname).transform(te).select(
        "vec_id", F.col("prediction").cast("int").alias("prediction"))


@query
def histograms(spark, d):
    return D.histograms(T(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 30)


@query
def insights_small(spark, d):
    # a table below the small-dataset threshold with a high-cardinality text
    # column, aggregated from the whole of lineitem
    return RU.insights(X.line_status_summary(spark, d)).select("rule_id", "rule", "column_name", "value")
