"""Distributions and outliers.

Bounds (min/max, quartiles, mean/std, median/MAD) are small aggregates
collected to the driver (one row, or one row per column) and applied as
literals, so row filters reach the parquet scan as pushed filters and no
join is needed.  Nulls are never outliers.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.columns import col, columns_of_kind, numeric_value
from tabsight.functions.quantiles import column_quantiles

IQR_K = 1.5          # Tukey fences
Z_LIMIT = 3.0        # |z| > 3, z with ddof=0
MODZ_LIMIT = 3.5     # |0.6745 (x - median) / MAD| > 3.5
MODZ_FACTOR = 0.6745


def _x(df: DataFrame, column: str):
    return numeric_value(df, column)


def iqr_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, q1, q3, lower, upper)`` per column (exact quartiles)."""
    q = column_quantiles(df, columns, [0.25, 0.75])
    w = q.groupBy("column_name").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("quantile"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return w.select("column_name", "q1", "q3", (F.col("q1") - IQR_K * iqr).alias("lower"),
                    (F.col("q3") + IQR_K * iqr).alias("upper"))


def _bounds(df: DataFrame, column: str) -> tuple:
    """(q1, q3, lower, upper) of one column as driver scalars (one small row)."""
    r = iqr_bounds(df, [column]).collect()
    return (r[0]["q1"], r[0]["q3"], r[0]["lower"], r[0]["upper"]) if r else (None,) * 4


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram on [min, max] (D1): ``bin`` 1..bins, edges and
    count; the maximum falls in the last bin, a constant column in bin 1, and
    empty bins are listed with count 0."""
    x = _x(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint")
    width = hi - lo
    b = F.least(F.coalesce(F.floor(F.try_divide(x - F.lit(lo), F.lit(width)) * bins) + 1, F.lit(1)),
                F.lit(bins)).cast("int")
    counts = df.where(x.isNotNull()).select(b.alias("bin")).groupBy("bin") \
        .agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + (F.col("id") - 1) * F.lit(width) / bins).alias("lower"),
        (F.lit(lo) + F.col("id") * F.lit(width) / bins).alias("upper"))
    return edges.join(counts, "bin", "left") \
        .select("bin", "lower", "upper", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")) \
        .orderBy("bin")


def histograms(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """:func:`histogram` of several columns in two passes in total: one
    aggregate for every range, one ``groupBy(column, bin)`` over a union of
    one-column projections.  Output ``(column_name, bin, lower, upper, count)``."""
    spark = df.sparkSession
    xs = [_x(df, c) for c in columns]
    r = df.agg(*[e for i, x in enumerate(xs) for e in (F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"))]).first()
    parts, edges = [], []
    for i, (c, x) in enumerate(zip(columns, xs)):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is None:
            continue
        w = hi - lo
        b = F.least(F.coalesce(F.floor(F.try_divide(x - F.lit(lo), F.lit(w)) * bins) + 1, F.lit(1)),
                    F.lit(bins)).cast("int")
        parts.append(df.where(x.isNotNull()).select(F.lit(c).alias("column_name"), b.alias("bin")))
        edges += [(c, k, lo + (k - 1) * w / bins, lo + k * w / bins) for k in range(1, bins + 1)]
    frame = spark.createDataFrame(edges, "column_name string, bin int, lower double, upper double")
    if not parts:
        return frame.withColumn("count", F.lit(0).cast("bigint"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionAll(p)
    counts = u.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    return frame.join(counts, ["column_name", "bin"], "left") \
        .select("column_name", "bin", "lower", "upper", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")) \
        .orderBy("column_name", "bin")


def outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    """Rows outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] (D3).  The fences are
    literals, so the filter reaches the parquet scan."""
    _, _, lo, hi = _bounds(df, column)
    x = _x(df, column)
    if lo is None:
        return df.where(F.lit(False))
    return df.where((x < F.lit(lo)) | (x > F.lit(hi)))


def outliers_zscore(df: DataFrame, column: str) -> DataFrame:
    """Rows with |x - mean| / std_pop > 3 (D4), aligned with the rows."""
    x = _x(df, column)
    mu, sd, low, high = df.agg(F.avg(x), F.stddev_pop(x), F.min(x), F.max(x)).first()
    if mu is None or low == high:  # no spread: a rounded mean must not make every row an outlier
        return df.where(F.lit(False))
    # |x - mu| > 3 sd as a two-sided range on literals: pushed to the scan
    return df.where((x < F.lit(mu - Z_LIMIT * sd)) | (x > F.lit(mu + Z_LIMIT * sd)))


def mad_stats(df: DataFrame, column: str) -> tuple:
    """``(median, mad)``: median, then the median of |x - median| (unscaled)."""
    med = column_quantiles(df, [column], [0.5]).first()["quantile"]
    if med is None:
        return None, None
    dev = df.select(F.abs(_x(df, column) - F.lit(med)).alias("value"))
    mad = column_quantiles(dev, ["value"], [0.5]).first()["quantile"]
    return med, mad


def outliers_mad(df: DataFrame, column: str) -> DataFrame:
    """Rows with |0.6745 (x - median) / MAD| > 3.5 (D5), written without the
    division: when MAD is 0 every x other than the median is an outlier, as
    the infinite score of the reference."""
    med, mad = mad_stats(df, column)
    x = _x(df, column)
    if med is None:
        return df.where(F.lit(False))
    # |x - median| > 3.5 MAD / 0.6745 as a two-sided range on literals
    t = MODZ_LIMIT * mad / MODZ_FACTOR
    return df.where((x < F.lit(med - t)) | (x > F.lit(med + t)))


def outlier_counts(df: DataFrame, column: str) -> DataFrame:
    """Outlier count per method for one column."""
    sel = df.select(col(column))
    # each method first computes its bounds (independent small jobs):
    # submitted together so their short stages overlap
    methods = [("IQR", outliers_iqr), ("Z-Score", outliers_zscore), ("Modified Z-Score", outliers_mad)]
    with ThreadPoolExecutor(max_workers=len(methods)) as pool:
        frames = list(pool.map(lambda m: m[1](sel, column), methods))
    out = None
    for (name, _), frame in zip(methods, frames):
        one = frame.agg(F.count(F.lit(1)).alias("n_outliers")).select(F.lit(name).alias("method"), "n_outliers")
        out = one if out is None else out.unionByName(one)
    return out


def outlier_total(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """IQR outliers per numeric column (D7); their sum is the reference's
    total.  The fences of all columns (one small row each) become literals of
    a single aggregate over the table."""
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    b = {r["column_name"]: (r["lower"], r["upper"]) for r in iqr_bounds(df, columns).collect()}
    aggs = []
    for i, c in enumerate(columns):
        lo, hi = b.get(c, (None, None))
        x = _x(df, c)
        cond = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
        aggs.append(F.count(F.when(cond, 1)).alias(f"__o{i}"))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column_name string, n_outliers bigint")
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                   F.col(f"__o{i}").alias("n_outliers"))
                                         for i, c in enumerate(columns)])))


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Box-plot statistics (D8): quartiles, fences, whiskers (most extreme
    values inside the fences) and the outlier count."""
    q = {r["p"]: r["quantile"] for r in
         column_quantiles(df, [column], [0.25, 0.5, 0.75]).collect()}
    q1, med, q3 = q.get(0.25), q.get(0.5), q.get(0.75)
    x = _x(df, column)
    if q1 is None:
        lf = uf = None
        inside = F.lit(False)
    else:
        lf, uf = q1 - IQR_K * (q3 - q1), q3 + IQR_K * (q3 - q1)
        inside = (x >= F.lit(lf)) & (x <= F.lit(uf))
    return df.agg(F.min(F.when(inside, x)).alias("lower_whisker"),
                  F.max(F.when(inside, x)).alias("upper_whisker"),
                  F.count(F.when(x.isNotNull() & ~inside, 1)).alias("n_outliers")) \
        .select(F.lit(q1).cast("double").alias("q1"), F.lit(med).cast("double").alias("median"),
                F.lit(q3).cast("double").alias("q3"), F.lit(lf).cast("double").alias("lower_fence"),
                F.lit(uf).cast("double").alias("upper_fence"), "lower_whisker", "upper_whisker",
                "n_outliers")


def outliers_cap_iqr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Winsorise each column to its IQR fences (D9); nulls stay null (Spark's
    ``least``/``greatest`` would otherwise replace them)."""
    b = iqr_bounds(df, columns).collect()   # one small row per column
    bounds = {r["column_name"]: (r["lower"], r["upper"]) for r in b}
    out = []
    for f in df.schema.fields:
        if f.name in bounds and bounds[f.name][0] is not None:
            lo, hi = bounds[f.name]
            x = col(f.name).cast("double")
            out.append(F.when(x.isNull(), None)
                       .otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def outliers_remove_iqr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Remove IQR outliers column after column (D10): the fences of a column
    are computed on the rows left by the previous columns; rows with a null in
    a processed column are removed too (a comparison with NULL is false)."""
    cur = df
    for c in columns:
        r = iqr_bounds(cur, [c]).collect()[0]
        if r["lower"] is None:
            cur = cur.where(F.lit(False))
            continue
        cur = cur.where(_x(cur, c).between(F.lit(r["lower"]), F.lit(r["upper"])))
    return cur
