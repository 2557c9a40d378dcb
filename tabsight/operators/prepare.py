"""Preprocessing.

Statistics (mean, median, mode, min/max, std) are small aggregates collected
as literals and applied in a single projection, so imputation and scaling are
one narrow ``select`` over the data.  Encoding and stratified splitting use
the distributed ranks of :mod:`tabsight.functions.ranking`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.columns import (
    col, columns_of_kind, hash_order, kind_of, numeric_value, unpivot_numeric,
)
from tabsight.functions.quantiles import column_quantiles
from tabsight.functions.ranking import cuts_passed, dense_codes, hash_cuts, join_checked

MIN_ROWS = 10          # fixed value: minimum rows for training
UNKNOWN = "Unknown"    # fixed value: fill for an all-null text feature
BROADCAST_LIMIT_BYTES = 64 << 20   # code tables up to this size are broadcast


def _replace(df: DataFrame, exprs: dict) -> DataFrame:
    return df.select(*[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns])


def _is_text(df, c):
    return kind_of(df.schema[c].dataType) in ("text", "boolean")


def column_means(df: DataFrame, columns: list[str]) -> dict:
    r = df.agg(*[F.avg(numeric_value(df, c)).alias(f"__{i}") for i, c in enumerate(columns)]).first()
    return {c: r[f"__{i}"] for i, c in enumerate(columns)}


def column_medians(df: DataFrame, columns: list[str]) -> dict:
    q = column_quantiles(df, columns, [0.5]).collect()
    return {r["column_name"]: r["quantile"] for r in q}


def column_modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent non-null value per column, ties -> smallest (numeric
    order for numbers, text order for text).  One ``groupBy(column, value)``
    per kind, then ``min_by`` per column."""
    out: dict = {c: None for c in columns}
    num = [c for c in columns if kind_of(df.schema[c].dataType) == "numeric"]
    txt = [c for c in columns if c not in num]  # datetimes too: their text sorts as they do
    for names, long in ((num, unpivot_numeric(df, num) if num else None),
                        (txt, df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("n"),
                                                                    col(c).cast("string").alias("v"))
                                                           for c in txt]))).toDF("column_name", "value")
                         if txt else None)):
        if not names:
            continue
        per = long.where(F.col("value").isNotNull()).groupBy("column_name", "value") \
            .agg(F.count(F.lit(1)).alias("cnt"))
        best = per.groupBy("column_name").agg(
            F.min_by("value", F.struct((-F.col("cnt")).alias("a"), F.col("value").alias("b"))).alias("mode"))
        out.update({r["column_name"]: r["mode"] for r in best.collect()})
    return out


def default_features(df: DataFrame, target: str | None = None, n: int | None = None,
                     kind: str | None = None) -> list[str]:
    """Default feature choice (P3): columns other than the target in schema
    order, optionally of one kind, the first ``n`` of them (the reference
    preselects 5 or 10 features and the first 4 numeric columns for plots)."""
    cols = [f.name for f in df.schema.fields if f.name != target
            and (kind is None or kind_of(f.dataType) == kind)]
    return cols[:n] if n is not None else cols


def _fill(df: DataFrame, values: dict) -> DataFrame:
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        dt = df.schema[c].dataType
        exprs[c] = F.coalesce(col(c), F.lit(v).cast(dt))
    return _replace(df, exprs)


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with the column mean."""
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    m = column_means(df, columns)
    return _replace(df, {c: F.coalesce(col(c).cast("double"), F.lit(m[c])) for c in columns if m[c] is not None})


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with the exact median."""
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    m = column_medians(df, columns)
    return _replace(df, {c: F.coalesce(col(c).cast("double"), F.lit(m[c])) for c in columns if m.get(c) is not None})


def impute_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill nulls with the most frequent value (X2), numeric or text."""
    columns = columns if columns is not None else df.columns
    return _fill(df, column_modes(df, columns))


def impute_constant(df: DataFrame, columns: list[str] | None = None, fill: str = "0") -> DataFrame:
    """Fill with a constant (X3): text gets ``fill``; numeric gets ``fill``
    parsed as a number, 0 when it does not parse; a datetime gets ``fill``
    parsed as one and keeps its nulls when it does not parse."""
    columns = columns if columns is not None else df.columns
    exprs = {}
    for c in columns:
        dt = df.schema[c].dataType
        if kind_of(dt) == "datetime":
            exprs[c] = F.coalesce(col(c), F.lit(fill).try_cast(dt))
        elif _is_text(df, c):
            exprs[c] = F.coalesce(col(c).cast("string"), F.lit(fill))
        else:
            exprs[c] = F.coalesce(col(c).cast("double"),
                                  F.coalesce(F.lit(fill).try_cast("double"), F.lit(0.0)))
    return _replace(df, exprs)


def impute_drop(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strategy ``drop`` (P6): rows with a null in the chosen columns go."""
    return df.dropna(subset=columns)


def append_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows one after another, columns matched by name (U1); a column that one
    side lacks is null there."""
    out = first
    for o in others:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def label_encode(df: DataFrame, columns: list[str] | None = None, null_token: str = "nan") -> DataFrame:
    """Codes = position of the value among the column's sorted distinct values
    (X5); nulls become the category ``'nan'``.  Two readings: one for the
    distinct values of all columns, whose code table is a distributed dense
    rank, one to join the codes back (broadcast while the code tables sent add
    up to at most ``BROADCAST_LIMIT_BYTES``, otherwise a shuffle join)."""
    columns = columns if columns is not None else columns_of_kind(df, "text")
    if not columns:
        return df
    txt = {c: F.coalesce(col(c).cast("string"), F.lit(null_token)) for c in columns}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), txt[c].alias("value"))
                                        for c in columns])))
    codes = dense_codes(long, "column_name", "value", "code")
    # the code tables' sizes (rows and text bytes, one small aggregate): the
    # smallest are broadcast as long as all of these together stay under the
    # limit, so a hot category never meets in one reducer; larger ones are
    # joined by the planner (AQE splits skewed partitions)
    size = {r["column_name"]: r["b"] for r in codes.groupBy("column_name").agg(
        (F.sum(F.octet_length("value")) + F.count(F.lit(1)) * 16).alias("b")).collect()}
    out, held, sent = df, 0, set()
    for c in sorted(columns, key=lambda c: size.get(c) or 0):
        held += size.get(c) or 0
        if held <= BROADCAST_LIMIT_BYTES:
            sent.add(c)
    for i, c in enumerate(columns):
        m = codes.where(F.col("column_name") == c).select(F.col("value").alias(f"__v{i}"),
                                                          F.col("code").alias(f"__code{i}"))
        out = out.withColumn(f"__v{i}", txt[c]).join(F.broadcast(m) if c in sent else m, f"__v{i}", "left")
    return out.select(*[F.col(f"__code{columns.index(c)}").cast("bigint").alias(c) if c in columns else col(c)
                        for c in df.columns])


def standard_scale(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std_pop with statistics of ``fit`` (default ``df``) (X6);
    a constant column scales to 0."""
    fit = fit if fit is not None else df
    r = fit.agg(*[e for i, c in enumerate(columns) for e in (
        F.avg(numeric_value(fit, c)).alias(f"m{i}"), F.stddev_pop(numeric_value(fit, c)).alias(f"s{i}"))]).first()
    exprs = {}
    for i, c in enumerate(columns):
        x = numeric_value(df, c)
        mu, sd = r[f"m{i}"], r[f"s{i}"]
        if mu is None:
            exprs[c] = x
            continue
        z = F.lit(0.0) if not sd else (x - F.lit(mu)) / F.lit(sd)
        exprs[c] = F.when(x.isNull(), None).otherwise(z)
    return _replace(df, exprs)


def minmax_scale(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min) to [0, 1] (X7); a constant column scales to 0."""
    fit = fit if fit is not None else df
    r = fit.agg(*[e for i, c in enumerate(columns) for e in (
        F.min(numeric_value(fit, c)).alias(f"lo{i}"), F.max(numeric_value(fit, c)).alias(f"hi{i}"))]).first()
    exprs = {}
    for i, c in enumerate(columns):
        x = numeric_value(df, c)
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is None:
            exprs[c] = x
            continue
        z = F.lit(0.0) if hi == lo else (x - F.lit(lo)) / F.lit(hi - lo)
        exprs[c] = F.when(x.isNull(), None).otherwise(z)
    return _replace(df, exprs)


STRATEGIES = ("mean", "median", "most_frequent", "constant", "drop")


def impute_by_column(df: DataFrame, strategies: dict[str, str], fill: str | dict[str, str] = "0") -> DataFrame:
    """Fill every column by its own strategy (``STRATEGIES``; P6, X1-X3), text
    included, in the order given: rows that a ``drop`` column rules out count
    for the columns before it and no longer for those after it.  ``fill`` is
    one text or one per column.  Columns between two drops share their
    readings."""
    def fill_up(rows: DataFrame, by: dict) -> DataFrame:
        for s, fit in (("mean", impute_mean), ("median", impute_median), ("most_frequent", impute_mode)):
            if s in by:
                rows = fit(rows, by[s])
        for c in by.get("constant", []):
            rows = impute_constant(rows, [c], fill if isinstance(fill, str) else fill.get(c, "0"))
        return rows

    out, open_ = df, {}
    for c, s in strategies.items():
        if s not in STRATEGIES:
            raise ValueError(f"no strategy {s!r}")
        if s in ("mean", "median") and kind_of(df.schema[c].dataType) != "numeric":
            raise ValueError(f"{c} has no {s}")
        if s == "drop":
            out, open_ = impute_drop(fill_up(out, open_), [c]), {}
        else:
            open_.setdefault(s, []).append(c)
    return fill_up(out, open_)


def preprocess(df: DataFrame, columns: list[str] | None = None, missing: str | dict | None = "mean",
               scaling: str | None = "standard", outliers: str | None = "cap",
               fill: str | dict[str, str] = "0") -> DataFrame:
    """Missing values -> scaling -> outliers, each optional (X8).  ``missing``
    is one strategy for ``columns`` or a dict with one for each column, text
    columns included; scaling and outliers take the numeric ``columns``."""
    from tabsight.operators import distribution as D
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    if isinstance(missing, str):
        missing = {c: missing for c in columns}
    out = impute_by_column(df, missing, fill) if missing else df
    numeric = [c for c in columns if kind_of(out.schema[c].dataType) == "numeric"]
    if scaling == "standard":
        out = standard_scale(out, numeric)
    elif scaling == "minmax":
        out = minmax_scale(out, numeric)
    if outliers == "cap":
        out = D.outliers_cap_iqr(out, numeric)
    elif outliers == "remove":
        out = D.outliers_remove_iqr(out, numeric)
    return out


def key_column(keys: list[str]):
    """A single text key from one or more key columns."""
    return col(keys[0]).cast("string") if len(keys) == 1 else \
        F.concat_ws("|", *[col(k).cast("string") for k in keys])


def split(df: DataFrame, keys: list[str], test_fraction: float = 0.2, out: str = "is_test") -> DataFrame:
    """Deterministic train/test split (X11): a row is in the test set when
    the md5 order of its key, modulo 100 (for a fraction that is no whole
    percentage: a million), is below the test share.
    Independent of partitioning; no shuffle."""
    steps = 100 if abs(test_fraction * 100 - round(test_fraction * 100)) < 1e-9 else 1_000_000
    return df.withColumn(out, (hash_order(key_column(keys)) % steps) < int(round(test_fraction * steps)))


def stratified_split(df: DataFrame, keys: list[str], label: str, test_fraction: float = 0.2,
                     out: str = "is_test") -> DataFrame:
    """Stratified split (X11): within every class the first
    ceil(test_fraction * n_class) rows in md5 order (ties by key) are test
    rows.  The cut of every class is an order statistic found with two
    aggregates (:func:`hash_cuts`) and joined to the rows (broadcast, if the
    classes are few enough by count), so the table is neither shuffled nor
    written, a hot class costs nothing extra and classes may be many."""
    k = key_column(keys)
    cuts = hash_cuts(df, col(label), hash_order(k), k, lambda n: F.array(F.ceil(F.lit(float(test_fraction)) * n)))
    rows = df.select("*", hash_order(k).alias("__h"), k.alias("__k"))
    cuts = cuts.select(F.col("g").alias("__g"), F.col("cuts").alias("__cuts"))
    test = F.coalesce(cuts_passed(F.col("__cuts"), F.col("__h"), F.col("__k")) == 0, F.lit(False))
    return join_checked(rows, cuts, col(label) == F.col("__g"), "left").select(
        *[col(c) for c in df.columns], test.alias(out))


def target_type(df: DataFrame, target: str) -> DataFrame:
    """``continuous`` (a fractional value exists), ``binary`` (2 distinct) or
    ``multiclass`` (X12)."""
    dt = df.schema[target].dataType
    x = col(target)
    frac = F.max(F.when(x.cast("double") != F.floor(x.cast("double")), 1).otherwise(0)) \
        if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)) else F.lit(0)
    s = df.agg(F.count_distinct(x).alias("n_distinct"), frac.alias("__frac"))
    kind = F.when(F.col("__frac") == 1, "continuous").when(F.col("n_distinct") == 2, "binary") \
        .otherwise("multiclass")
    return s.select(F.lit(target).alias("target"), kind.alias("target_type"), "n_distinct")


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """Classification for text targets or fewer than 10 distinct values,
    otherwise Regression (X13)."""
    s = df.agg(F.count_distinct(col(target)).alias("n_distinct"))
    text = _is_text(df, target)
    kind = F.lit("Classification") if text else \
        F.when(F.col("n_distinct") < 10, "Classification").otherwise("Regression")
    return s.select(F.lit(target).alias("target"), kind.alias("problem_type"), "n_distinct")


def min_rows_guard(df: DataFrame, n: int = MIN_ROWS) -> None:
    """Raise when fewer than ``n`` rows (P8); reads at most ``n`` rows."""
    got = df.limit(n).count()
    if got < n:
        raise ValueError(f"{got} complete rows left, at least {n} are needed")


def prepare(df: DataFrame, target: str, features: list[str], keep: list[str] | None = None,
            encode_target: bool = True) -> DataFrame:
    """Data preparation for model comparison (X14): project features and
    target (P2), drop null targets (P4), fill text features with the mode
    (``'Unknown'`` when all null) and numeric features with the median (0
    when all null) (X4), drop remaining nulls (P5), require 10 rows (P8),
    label-encode text features and a text target (X5)."""
    if not features:
        raise ValueError("no feature columns selected")
    if target in features:
        raise ValueError("the target column cannot be a feature")
    keep = keep or []
    data = df.select(*[col(c) for c in keep + features + [target]]).dropna(subset=[target])
    txt = [c for c in features if _is_text(data, c)]
    num = [c for c in features if c not in txt]
    modes = column_modes(data, txt) if txt else {}
    meds = column_medians(data, num) if num else {}
    exprs = {c: F.coalesce(col(c).cast("string"), F.lit(modes.get(c) if modes.get(c) is not None else UNKNOWN))
             for c in txt}
    exprs.update({c: F.coalesce(numeric_value(data, c), F.lit(meds.get(c) if meds.get(c) is not None else 0.0))
                  for c in num})
    data = _replace(data, exprs).dropna()
    min_rows_guard(data)
    enc = txt + ([target] if encode_target and _is_text(data, target) else [])
    return label_encode(data, enc) if enc else data
