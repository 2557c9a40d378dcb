"""Derived inputs for the registered queries.

The driver's tables hold no NULL, no NaN and almost no correlation, so nulls,
duplicates and labels with signal are derived by expression.  Every fixture is
a projection of a whole table (no row subset), written identically as DuckDB
SQL in :mod:`tabsight.plans.oracle`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.sources.tables import load_table


def events_nulls(spark: SparkSession, d: str) -> DataFrame:
    """events with NULL ``value`` every 10th id and NULL ``event_type`` every 13th."""
    e = load_table(spark, d, "events")
    return e.select("event_id", "ts", "user_id",
                    F.when(F.col("event_id") % 13 == 0, None).otherwise(F.col("event_type")).alias("event_type"),
                    F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("value")).alias("value"),
                    "props")


def lineitem_targets(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with planted targets: a binary label, a 3-class label, a
    regression target and a correlated column."""
    li = load_table(spark, d, "lineitem")
    return li.select(
        "*",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_netprice"),
        F.when(F.col("l_quantity") - 100 * F.col("l_discount") + (F.col("l_partkey") % 7) > 20, 1)
        .otherwise(0).alias("target_bin"),
        F.when(F.col("l_quantity") < 15, "low").when(F.col("l_quantity") < 35, "mid")
        .otherwise("high").alias("target_cls"),
        (3 * F.col("l_quantity") - 20 * F.col("l_discount") + (F.col("l_partkey") % 7))
        .cast("double").alias("target_reg"))


def line_status_summary(spark: SparkSession, d: str) -> DataFrame:
    """lineitem aggregated per (return flag, line status): a table below the
    small-dataset threshold whose every row is distinct text (``flag``) and
    whose ``n_lines`` is a count over the whole of lineitem."""
    li = load_table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_lines")) \
        .select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("flag"), "n_lines")


def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic prediction table (no model involved): label = planted
    binary target, score = (l_quantity + l_suppkey % 17 - 8) / 50,
    prediction = score > 0.5."""
    li = lineitem_targets(spark, d)
    score = (F.col("l_quantity") + (F.col("l_suppkey") % 17) - 8) / 50.0
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("target_bin").cast("double").alias("label"),
                     score.alias("score"),
                     F.when(score > 0.5, 1.0).otherwise(0.0).alias("prediction"))


def embeddings_wide(spark: SparkSession, d: str, n: int = 64) -> DataFrame:
    """All embedding coordinates as columns e0..e(n-1) plus the
    ring label ``e0^2 + e1^2 > 0.022``."""
    e = load_table(spark, d, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)]
    ring = F.when(F.col("embedding")[0] * F.col("embedding")[0]
                  + F.col("embedding")[1] * F.col("embedding")[1] > 0.022, 1).otherwise(0)
    rad = F.col("embedding")[0].cast("double") * F.col("embedding")[0].cast("double") \
        + F.col("embedding")[1].cast("double") * F.col("embedding")[1].cast("double")
    return e.select("vec_id", *cols, "label", ring.alias("ring"), rad.alias("radius2"))


def class_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic 3-class prediction table: actual = planted 3-class
    target, predicted = the same rule on l_quantity + l_suppkey % 5 - 2."""
    li = lineitem_targets(spark, d)
    q2 = F.col("l_quantity") + (F.col("l_suppkey") % 5) - 2
    pred = F.when(q2 < 15, "low").when(q2 < 35, "mid").otherwise("high")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("target_cls").alias("label"), pred.alias("prediction"))


def regression_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic regression prediction table: actual = planted
    regression target, predicted = 3 * l_quantity - 1."""
    li = lineitem_targets(spark, d)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("target_reg").alias("label"),
                     (3 * F.col("l_quantity") - 1).cast("double").alias("prediction"))


def rule_model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A comparison metrics table for three threshold rules on the prediction
    table's score (0.4, 0.5, 0.6), in the layout of ``compare_models``:
    test metrics on all rows, CV = accuracy over 5 md5 folds of the row key
    (mean and population std)."""
    from tabsight.functions.columns import hash_order
    from tabsight.operators import evaluate as EV
    base = prediction_table(spark, d)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey",
                                                                "l_suppkey")])
    base = base.withColumn("fold", hash_order(key) % 5)
    auc = EV.roc_auc(base).first()["auc"]
    rows = []
    for i, t in enumerate((0.4, 0.5, 0.6)):
        p = base.withColumn("prediction", F.when(F.col("score") > t, 1.0).otherwise(0.0))
        acc = EV.metric_accuracy(p).first()["accuracy"]
        prf = EV.metric_weighted_prf(p).first()
        folds = [r["a"] for r in p.groupBy("fold").agg(
            F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).collect()]
        mu = sum(folds) / len(folds)
        sd = (sum((x - mu) ** 2 for x in folds) / len(folds)) ** 0.5
        rows.append((i, f"Rule {t}", acc, prf["precision"], prf["recall"], prf["f1"], mu, sd, auc, None))
    return spark.createDataFrame(rows, "ordinal int, model string, accuracy double, precision double, "
                                       "recall double, f1 double, cv_mean double, cv_std double, "
                                       "roc_auc double, error string")


def part_planted(spark: SparkSession, d: str) -> DataFrame:
    """part with a feature ``gap`` that separates the planted classes of
    ``p_size`` by 41 or more, two features without signal, a two-class and a
    three-class label, a two-valued and a linear number.  What a sound model
    predicts from it is known exactly."""
    size, kind = F.col("p_size"), F.when(F.col("p_size") < 15, 0).when(F.col("p_size") < 35, 1).otherwise(2)
    gap, noise = (size + 40 * kind).cast("double"), (F.col("p_partkey") % 13).cast("double")
    return load_table(spark, d, "part").select(
        "p_partkey", gap.alias("gap"), F.col("p_retailprice").alias("price"), noise.alias("noise"),
        F.when(size < 15, 0).otherwise(1).alias("bin"),
        F.when(size < 15, "small").when(size < 35, "medium").otherwise("large").alias("cls"),
        F.when(size < 15, 2.5).otherwise(10.0).alias("num"), (3 * gap - 2 * noise + 0.5).alias("lin"))


def orders_repeated(spark: SparkSession, d: str) -> DataFrame:
    """orders with every 50th order twice: whole rows that repeat."""
    o = load_table(spark, d, "orders")
    return o.unionAll(o.where(F.col("o_orderkey") % 50 == 0))
