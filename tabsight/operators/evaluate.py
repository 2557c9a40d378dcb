"""Evaluation metrics as Spark aggregates.

Inputs are prediction tables ``(label, prediction[, score])``.  Every metric
is a group-by on (label, prediction) or on distinct scores followed by small
arithmetic; curves are built from distinct scores with a distributed running
sum, never a single-partition window over the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.columns import col
from tabsight.functions.ranking import running_sum
from tabsight.operators.distribution import histogram
from tabsight.session import keep


def metric_accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows with prediction == label."""
    return pred.agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts for every (actual, predicted) pair of the label set (E3),
    zero cells included; classes are the union of labels and predictions.
    The pairs are made by Spark, none of them on the driver."""
    counts = keep(_cells(pred, label, prediction), "cells")
    classes = keep(counts.select("actual").union(counts.select("predicted")).distinct(), "classes")
    k = classes.count()
    # a number for each class; a class meets every number, and the number its class
    numbered = classes.agg(F.collect_list(F.struct(F.col("actual").alias("c"))).alias("all")).select(
        F.posexplode("all").alias("j", "x")).select("j", F.col("x.c").alias("predicted"))
    grid = classes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0))))).join(numbered, "j").drop("j")
    both = grid["actual"].eqNullSafe(counts["actual"]) & grid["predicted"].eqNullSafe(counts["predicted"])
    return grid.join(counts, both, "left").select(
        grid["actual"], grid["predicted"], F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _cells(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    return pred.groupBy(col(label).alias("actual"), col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def _per_class(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class: support, tp, predicted count; precision, recall and F1 are
    0 when undefined (``zero_division=0``)."""
    cm = _cells(pred, label, prediction)
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("n_pred"))
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("count").alias("tp"))
    per = sup.join(prd, "cls", "full").join(tp, "cls", "left").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
        F.coalesce("tp", F.lit(0)).alias("tp"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    return per.withColumn("precision", p).withColumn("recall", r) \
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                  F.col("precision") + F.col("recall")), F.lit(0.0)))


def metric_weighted_prf(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support-weighted precision, recall and F1."""
    per = _per_class(pred, label, prediction)
    w = F.sum("support")
    return per.agg((F.sum(F.col("precision") * F.col("support")) / w).alias("precision"),
                   (F.sum(F.col("recall") * F.col("support")) / w).alias("recall"),
                   (F.sum(F.col("f1") * F.col("support")) / w).alias("f1"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support plus ``accuracy``, ``macro avg``
    and ``weighted avg`` rows (E4), from one reading."""
    per = keep(_per_class(pred, label, prediction), "classes")
    rows = per.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    none = F.lit(None).cast("double")
    names = ("precision", "recall", "f1")
    parts = [F.struct(F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"),
                      (F.sum("tp") / n).alias("f1"), n.alias("support")),
             F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], n.alias("support")),
             F.struct(F.lit("weighted avg").alias("class"),
                      *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in names], n.alias("support"))]
    total = per.agg(F.array(*parts).alias("parts"), n.alias("n")).where("n > 0").select(F.inline("parts"))
    return rows.unionByName(total).withColumn("support", F.col("support").cast("bigint"))


def _score_counts(pred: DataFrame, label: str, score: str, positive) -> DataFrame:
    """Positives/negatives per distinct score, with running totals from the
    highest score down (a distributed running sum over distinct scores).
    ``pred`` is read once; all that follows reads the written result.  Rows
    with a null score or label belong to no curve."""
    is_pos = (col(label) == F.lit(positive)).cast("bigint")
    per = (pred.where(col(score).isNotNull() & col(label).isNotNull())
           .groupBy(col(score).cast("double").alias("score")).agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")))
    per = per.withColumn("__desc", -F.col("score"))
    return running_sum(per, None, ["__desc"], ["pos", "neg"], ["tp", "fp"]).drop("__desc")


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score", positive=1.0) -> DataFrame:
    """ROC points (E5): one per distinct score (threshold = score, predicted
    positive when score >= threshold) plus the start (0, 0) at +inf."""
    c = _score_counts(pred, label, score, positive)
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    pts = c.select(F.col("score").alias("threshold"),
                   F.try_divide(F.col("fp").cast("double"), F.lit(N)).alias("fpr"),
                   F.try_divide(F.col("tp").cast("double"), F.lit(P)).alias("tpr"))
    start = pred.sparkSession.createDataFrame([(float("inf"), 0.0 if N else None, 0.0 if P else None)],
                                              "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score", positive=1.0) -> DataFrame:
    """Area under the ROC curve (E6), trapezoids over the distinct scores:
    sum of neg(s) * (positives above s + pos(s) / 2), over P * N."""
    c = _score_counts(pred, label, score, positive)
    area = F.sum(F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0))
    return c.agg(F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def pr_curve(pred: DataFrame, label: str = "label", score: str = "score", positive=1.0) -> DataFrame:
    """Precision-recall points (E7) at every distinct score, plus the closing
    point (precision 1, recall 0) without threshold."""
    c = _score_counts(pred, label, score, positive)
    P = c.agg(F.sum("pos")).first()[0] or 0
    pts = c.select(F.col("score").alias("threshold"),
                   F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
                   .alias("precision"),
                   F.try_divide(F.col("tp").cast("double"), F.lit(P)).alias("recall"))
    end = pred.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE and R^2 (E8) in one aggregate; R^2 is NULL for a
    constant label."""
    e = col(label).cast("double") - col(prediction).cast("double")
    s = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                 F.sum(e * e).alias("__sse"), F.var_pop(col(label).cast("double")).alias("__v"),
                 F.count(F.lit(1)).alias("n"))
    return s.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    (1 - F.try_divide(F.col("__sse"), F.col("__v") * F.col("n"))).alias("r2"), "n")


def residuals(pred: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``actual, predicted, residual`` per row."""
    return pred.select(*[col(k) for k in keys], col(label).cast("double").alias("actual"),
                       col(prediction).cast("double").alias("predicted"),
                       (col(label).cast("double") - col(prediction).cast("double")).alias("residual"))


def residual_histogram(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       bins: int = 30) -> DataFrame:
    """Histogram of ``label - prediction``."""
    r = pred.select((col(label).cast("double") - col(prediction).cast("double")).alias("residual"))
    return histogram(r, "residual", bins)
