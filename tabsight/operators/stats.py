"""Correlation and statistical tests.

All statistics are single aggregates (partial on the map side).  Pearson
correlation is pairwise-complete: each pair uses the rows where both values
are present, and a constant column gives NULL instead of a division error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.columns import columns_of_kind, numeric_value, quote
from tabsight.functions.gram import masked_gram, pair_correlation, scaled_spread, spread
from tabsight.session import keep

HIGH_CORR = 0.8
#: Up to so many columns, pairs are expressions of one generated aggregate.
NARROW = 12


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, pre: dict | None = None) -> DataFrame:
    """Long-form Pearson matrix ``(col_x, col_y, corr, i, j)`` for every
    ordered pair, diagonal included (C1), pairwise-complete.

    A first small aggregate finds the columns with nulls and the constant
    columns.  Pairs of null-free, non-constant columns use the built-in
    ``corr``; pairs touching a column with nulls use moments over the rows
    where both are present (``covar_pop`` / masked ``stddev_pop``, NULL when
    either side has no spread); pairs with a constant column are NULL.  Above
    ``NARROW`` columns the pairs are summed as matrices
    (:mod:`tabsight.functions.gram`) and stay in Spark."""
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "col_x string, col_y string, corr double, i int, j int")
    xs = [numeric_value(df, c) for c in columns]
    if pre is None:   # callers that already profiled the table pass n, c{i}, lo{i}, hi{i}, m{i}, sp{i}
        pre = df.agg(F.count(F.lit(1)).alias("n"),
                     *[e for i, x in enumerate(xs) for e in (
                         F.count(x).alias(f"c{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                         F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"sp{i}"))]).first().asDict()
    if len(columns) > NARROW:
        return _wide_correlation(df, columns, xs, pre)
    has_null = [pre[f"c{i}"] < pre["n"] for i in range(len(columns))]
    const = [pre[f"lo{i}"] is None or pre[f"lo{i}"] == pre[f"hi{i}"] for i in range(len(columns))]
    aggs, exprs = [], {}
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            if has_null[i] or has_null[j]:
                if pre[f"c{i}"] == 0 or pre[f"c{j}"] == 0:
                    continue
                xi = F.when(xs[j].isNotNull(), xs[i])
                xj = F.when(xs[i].isNotNull(), xs[j])
                r = F.try_divide(F.covar_pop(xi, xj), F.stddev_pop(xi) * F.stddev_pop(xj))
            elif const[i] or const[j]:
                continue
            else:
                r = F.corr(xs[i], xs[j])
            aggs.append(r.alias(f"r{i}_{j}"))
    got = df.agg(*aggs).first().asDict() if aggs else {}
    rows = []
    for i in range(len(columns)):
        for j in range(len(columns)):
            if i == j:
                v = None if const[i] else 1.0
            else:
                a, b = min(i, j), max(i, j)
                v = got.get(f"r{a}_{b}")
                if v is not None and (v != v or abs(v) > 1.0 + 1e-9):
                    v = None          # no spread among the common rows
            rows.append((columns[i], columns[j], v, i, j))
    return spark.createDataFrame(rows, "col_x string, col_y string, corr double, i int, j int")


def _wide_correlation(df: DataFrame, columns: list[str], xs: list, pre: dict) -> DataFrame:
    """The same matrix from :func:`masked_gram`.  Pairs whose common rows show
    hardly any spread after scaling are looked at again with the built-in
    moments, which tell none from little."""
    d = len(columns)
    if not pre["n"]:
        return df.sparkSession.createDataFrame([(a, b, None, i, j) for i, a in enumerate(columns) for j, b in enumerate(columns)],
                                               "col_x string, col_y string, corr double, i int, j int")
    scale = [pre[f"sp{i}"] if pre[f"sp{i}"] and math.isfinite(pre[f"sp{i}"]) else scaled_spread(pre[f"lo{i}"], pre[f"hi{i}"])
             for i in range(d)]
    sums = keep(masked_gram(df, xs, [pre[f"m{i}"] for i in range(d)], scale), "gram")
    const = F.array(*[F.lit(pre[f"lo{i}"] is None or pre[f"lo{i}"] == pre[f"hi{i}"]) for i in range(d)])
    flat = const[F.col("i")] | const[F.col("j")]
    little = ~flat & (F.col("n") > 0) & ((spread("x") <= F.col("n") * 1e-9) | (spread("y") <= F.col("n") * 1e-9))
    again = [(r["i"], r["j"]) for r in sums.where((F.col("i") < F.col("j")) & little).select("i", "j").collect()]
    exact = []
    for at in range(0, len(again), 50):
        some = again[at:at + 50]
        aggs = []
        for k, (i, j) in enumerate(some):
            x, y = F.when(xs[j].isNotNull(), xs[i]), F.when(xs[i].isNotNull(), xs[j])
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            aggs.append(F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), r).alias(f"r{k}"))
        row = df.agg(*aggs).first()
        exact += [(i, j, row[f"r{k}"]) for k, (i, j) in enumerate(some)]
    r = F.when(~flat & ~little & (F.abs(pair_correlation()) <= 1.0 + 1e-9), pair_correlation())
    r = F.when(F.col("i") == F.col("j"), F.when(~flat, 1.0)).otherwise(r)
    found = sums.select("i", "j", r.alias("corr"), little.alias("again"))
    if exact:
        table = df.sparkSession.createDataFrame(exact, "i int, j int, exact double")
        found = found.join(F.broadcast(table), ["i", "j"], "left").withColumn(  # pairs of a d x d matrix
            "corr", F.when(F.col("again") & (F.col("i") < F.col("j")), F.col("exact")).otherwise(F.col("corr")))
    names = F.array(*[F.lit(c) for c in columns])
    full = found.select("i", "j", "corr").unionByName(
        found.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    return full.select(names[F.col("i")].alias("col_x"), names[F.col("j")].alias("col_y"), "corr", "i", "j")


def _upper(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return correlation_matrix(df, columns).where((F.col("i") < F.col("j")) & F.col("corr").isNotNull())


def top_correlations(df: DataFrame, columns: list[str] | None = None, n: int = 3) -> DataFrame:
    """The ``n`` upper-triangle pairs with the largest *signed* r."""
    return _upper(df, columns).orderBy(F.desc("corr"), "i", "j").limit(n).select("col_x", "col_y", "corr")


def high_corr_pairs(df: DataFrame, columns: list[str] | None = None,
                    threshold: float = HIGH_CORR) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold."""
    return _upper(df, columns).where(F.abs("corr") > threshold).orderBy("i", "j") \
        .select("col_x", "col_y", "corr")


def ttest_pooled(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sample t statistic with pooled variance (C4); nulls dropped from
    each column independently."""
    xa, xb = numeric_value(df, a), numeric_value(df, b)
    s = df.agg(F.count(xa).alias("n_a"), F.count(xb).alias("n_b"), F.avg(xa).alias("mean_a"),
               F.avg(xb).alias("mean_b"), F.var_samp(xa).alias("var_a"), F.var_samp(xb).alias("var_b"))
    dof = F.col("n_a") + F.col("n_b") - 2
    sp2 = F.try_divide((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), dof)
    se = F.sqrt(sp2 * (F.try_divide(F.lit(1.0), F.col("n_a")) + F.try_divide(F.lit(1.0), F.col("n_b"))))
    return s.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "n_a", "n_b", "mean_a", "mean_b",
                    F.try_divide(F.col("mean_a") - F.col("mean_b"), se).alias("t_stat"),
                    dof.cast("bigint").alias("dof"))


def ttest_pvalue(df: DataFrame, a: str, b: str) -> DataFrame:
    """:func:`ttest_pooled` plus the two-sided p-value.

    The pooled test is the test of the slope in a regression of both columns'
    values, stacked, on a 0/1 column that tells them apart, so the p-value is
    that of Spark's own regression summary.  NULL where the statistic is (no
    spread, or fewer than three values)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    t = ttest_pooled(df, a, b).first()
    p = None
    if t["t_stat"] is not None and t["dof"] > 0:
        # centred and scaled, which changes no t: far-off values keep their digits
        xa, xb = numeric_value(df, a), numeric_value(df, b)
        mid, size = t["mean_a"], abs(t["mean_a"] - t["mean_b"]) or 1.0
        both = df.select(F.explode(F.array(F.struct(((xa - F.lit(mid)) / F.lit(size)).alias("y"), F.lit(0.0).alias("x")),
                                           F.struct(((xb - F.lit(mid)) / F.lit(size)).alias("y"), F.lit(1.0).alias("x"))))
                         .alias("r")).select("r.y", array_to_vector(F.array("r.x")).alias("x")).where("y IS NOT NULL")
        fit = LinearRegression(featuresCol="x", labelCol="y", regParam=0.0, solver="normal").fit(both)
        p = float(fit.summary.pValues[0])
    row = tuple(t) + (p,)
    return df.sparkSession.createDataFrame(
        [row], "col_a string, col_b string, n_a long, n_b long, mean_a double, mean_b double, t_stat double, dof long, "
               "p_value double")


def class_moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``(label, rows, n, mean, var)``: one row per class with an array entry
    per feature (population variances), written once."""
    xs = [numeric_value(df, f) for f in features]
    return keep(df.where(F.col(quote(label)).isNotNull()).groupBy(F.col(quote(label)).alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.array(*[F.count(x) for x in xs]).alias("n"),
        F.array(*[F.avg(x) for x in xs]).alias("mean"), F.array(*[F.var_pop(x) for x in xs]).alias("var")), "classes")


def f_classif(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature (C5): F = (SSB/(k-1)) / (SSW/(n-k)) from
    per-class count, mean and population variance (one ``groupBy(label)``).
    The classes stay a table: only sums over all of them are read."""
    per = class_moments(df, features, label)
    at = range(len(features))
    there = [F.col("n")[i] > 0 for i in at]
    sums = per.agg(*[e for i in at for e in (F.sum(F.when(there[i], F.col("n")[i] * F.col("mean")[i])).alias(f"s{i}"),
                                             F.sum(F.col("n")[i]).alias(f"n{i}"))]).first()
    mean = [sums[f"s{i}"] / sums[f"n{i}"] if sums[f"n{i}"] else 0.0 for i in at]
    gap = [F.col("mean")[i] - F.lit(mean[i]) for i in at]
    total = per.agg(*[e for i in at for e in (
        F.count(F.when(there[i], 1)).alias(f"k{i}"), F.sum(F.when(there[i], F.col("n")[i] * gap[i] * gap[i])).alias(f"b{i}"),
        F.sum(F.when(there[i], F.col("n")[i] * F.col("var")[i])).alias(f"w{i}"))]).first()
    rows = []
    for i, f in enumerate(features):
        k, n = total[f"k{i}"], sums[f"n{i}"] or 0
        usable = k > 1 and n > k and total[f"w{i}"] > 0
        rows.append((f, (total[f"b{i}"] / (k - 1)) / (total[f"w{i}"] / (n - k)) if usable else None))
    return df.sparkSession.createDataFrame(rows, "feature string, f_score double")


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Univariate regression F per feature (C6): r^2 / (1 - r^2) * (n - 2),
    pairwise-complete."""
    y = numeric_value(df, target)
    aggs = []
    for i, f in enumerate(features):
        x = numeric_value(df, f)
        xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        aggs += [F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym)).alias(f"__r{i}"),
                 F.count(x * y).alias(f"__n{i}")]
    one = df.agg(*aggs)
    structs = []
    for i, f in enumerate(features):
        r2 = F.col(f"__r{i}") * F.col(f"__r{i}")
        structs.append(F.struct(F.lit(f).alias("feature"),
                                F.try_divide(r2, 1 - r2) * (F.col(f"__n{i}") - 2).alias("f_score")))
    return one.select(F.inline(F.array(*structs))).toDF("feature", "f_score")


def select_k_best(df: DataFrame, features: list[str], label: str, k: int | None = None,
                  classification: bool = True) -> DataFrame:
    """SelectKBest (X9): the ``k`` features (default min(10, d)) with the
    highest F score; ties by name."""
    k = min(10, len(features)) if k is None else k
    scores = f_classif(df, features, label) if classification else f_regression(df, features, label)
    return scores.orderBy(F.desc_nulls_last("f_score"), "feature").limit(k)


def keep_k_best(df: DataFrame, features: list[str], label: str, k: int | None = None,
                classification: bool = True) -> DataFrame:
    """``df`` without the features that :func:`select_k_best` leaves out;
    other columns stay."""
    best = {r["feature"] for r in select_k_best(df, features, label, k, classification).collect()}
    return df.select(*[F.col(quote(c)) for c in df.columns if c not in features or c in best])
