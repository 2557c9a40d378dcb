"""Per-column profile of a table.

Design: a table is profiled with as few scans as possible.  All counts and
moments of all columns come from **one** ``agg`` (partial aggregation on the
map side, one row shuffled per task); distinct counts and modes come from one
``groupBy(column, value)`` over the unpivoted table (no ``Expand`` per
``count(distinct)``); quantiles come from :func:`column_quantiles`.  Results are
long-form DataFrames with one row per profiled column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.columns import (
    col, columns_of_kind, kind_of, numeric_value, quote,
)
from tabsight.functions import quantiles as Q
from tabsight.functions.quantiles import column_quantiles

_FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def _dtype(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _as_text(df: DataFrame, name: str):
    """Value of any column as text, for distinct counts and modes."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col(name))
    if isinstance(dt, (T.FloatType, T.DoubleType)):  # 0.0 and -0.0 are one value
        return F.when(col(name) == 0, F.lit(0).cast(dt)).otherwise(col(name)).cast("string")
    return col(name).cast("string")


def _long_text(df: DataFrame, columns: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("n"), _as_text(df, c).alias("v")) for c in columns])
    return df.select(F.inline(arr)).toDF("column_name", "value")


def table_shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def kind_counts(df: DataFrame) -> DataFrame:
    """Columns per kind and their non-null cells."""
    kinds: dict = {}
    for f in df.schema.fields:
        kinds.setdefault(kind_of(f.dataType), []).append(f.name)
    aggs = []
    for k, names in kinds.items():
        aggs.append(sum((F.count(col(n)) for n in names), F.lit(0)).cast("bigint").alias(k))
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(k).alias("kind"), F.lit(len(v)).cast("bigint").alias("n_columns"),
                        F.col(quote(k)).alias("non_null_cells")) for k, v in kinds.items()]
    return one.select(F.inline(F.array(*structs)))


def _null_counts(df: DataFrame) -> DataFrame:
    """One row per column: ``column_name, dtype, non_null, null_count, n_rows``."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count(col(c)).alias(f"__c{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(_dtype(df, c)).alias("dtype"),
                        F.col(f"__c{i}").alias("non_null"),
                        (F.col("__n") - F.col(f"__c{i}")).alias("null_count"),
                        F.col("__n").alias("n_rows"))
               for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*structs)))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """Distinct non-null values per column (A9).  Exact: one distributed
    ``groupBy(column, value)`` on the unpivoted table.  ``approx=True``: one
    aggregate of HyperLogLog++ sketches (relative error ``rsd``), no shuffle
    of values, for very wide or very large tables."""
    columns = columns or df.columns
    if approx:
        one = df.agg(*[F.approx_count_distinct(_as_text(df, c), rsd).alias(f"__d{i}") for i, c in enumerate(columns)])
        return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                       F.col(f"__d{i}").alias("n_distinct"))
                                             for i, c in enumerate(columns)])))
    vals = _long_text(df, columns).where(F.col("value").isNotNull())
    per = vals.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    got = per.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(got, "column_name", "left") \
        .select("column_name", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"))


def column_info(df: DataFrame) -> DataFrame:
    """Column information (A3): dtype, non-null, null count, null % rounded to
    2 (half-even), distinct non-null, a sample value (smallest non-null as
    text, ``'NaN'`` when all null)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(col(c)).alias(f"__c{i}"))
        aggs.append(F.min(_as_text(df, c)).alias(f"__s{i}"))
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(_dtype(df, c)).alias("dtype"),
                        F.col(f"__c{i}").alias("non_null"),
                        (F.col("__n") - F.col(f"__c{i}")).alias("null_count"),
                        F.bround(F.coalesce(F.try_divide((F.col("__n") - F.col(f"__c{i}")) * 100.0,
                                                         F.col("__n")), F.lit(0.0)), 2).alias("null_pct"),
                        F.coalesce(F.col(f"__s{i}"), F.lit("NaN")).alias("sample_value"))
               for i, c in enumerate(cols)]
    info = one.select(F.inline(F.array(*structs)))
    return info.join(distinct_counts(df, cols), "column_name") \
        .select("column_name", "dtype", "non_null", "null_count", "null_pct", "n_distinct",
                "sample_value")


def quality_report(df: DataFrame) -> DataFrame:
    """Data quality report (A4): column, dtype, missing, distinct."""
    return _null_counts(df).join(distinct_counts(df), "column_name") \
        .select("column_name", "dtype", F.col("null_count").alias("missing"), "n_distinct")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first (A5); empty when none."""
    return _null_counts(df).where(F.col("null_count") > 0) \
        .select("column_name", F.col("null_count").alias("missing_count")) \
        .orderBy(F.desc("missing_count"), "column_name")


def missing_cells(df: DataFrame) -> DataFrame:
    """Total missing cells and their share of all cells."""
    nc = _null_counts(df)
    return nc.agg(F.coalesce(F.sum("null_count"), F.lit(0)).cast("bigint").alias("missing_cells"),
                  (F.coalesce(F.max("n_rows"), F.lit(0)) * F.lit(len(df.columns))).cast("bigint")
                  .alias("total_cells")) \
        .withColumn("missing_pct", F.try_divide(F.col("missing_cells") * 100.0, F.col("total_cells")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row (A8): rows minus distinct rows,
    nulls equal.  One shuffle on all columns, map-side combined."""
    g = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__k"))
    return g.agg(F.coalesce(F.sum("__k"), F.lit(0)).cast("bigint").alias("n_rows"),
                 F.count(F.lit(1)).alias("n_distinct_rows")) \
        .withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct_rows"))


def logical_bytes(df: DataFrame) -> DataFrame:
    """Logical size per column (A10): UTF-8 bytes of text, fixed width times
    non-null values for fixed-size types, JSON bytes for nested values."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        width = next((w for t, w in _FIXED_WIDTH.items() if isinstance(f.dataType, t)), None)
        if isinstance(f.dataType, T.DecimalType):
            width = 16
        if width is not None:
            e = F.count(c) * F.lit(width)
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            e = F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
        else:
            e = F.coalesce(F.sum(F.octet_length(F.to_json(c))), F.lit(0))
        aggs.append(e.cast("bigint").alias(f"__b{i}"))
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.col(f"__b{i}").alias("bytes")) for i, f in enumerate(df.schema.fields)]
    return one.select(F.inline(F.array(*structs)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per value, most frequent first, nulls excluded."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")) \
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among the non-null rows."""
    vc = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")) \
        .agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(col(column))).first()[0]
    return vc.select("value", "count", F.try_divide(F.col("count"), F.lit(total).cast("double")).alias("share")) \
        .orderBy(F.desc("count"), "value")


def skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness (pandas ``skew``) per numeric column (A13),
    largest first.

    Spark's ``skewness`` is the population g1 (from numerically stable
    central moments); G1 = g1 * sqrt(n(n-1)) / (n-2), NULL for n < 3 or a
    constant column."""
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    aggs = []
    for i, c in enumerate(columns):
        x = numeric_value(df, c)
        aggs += [F.count(x).alias(f"__c{i}"), F.skewness(x).alias(f"__g{i}"),
                 F.stddev_pop(x).alias(f"__sp{i}")]
    one = df.agg(*aggs)
    structs = []
    for i, c in enumerate(columns):
        n = F.col(f"__c{i}").cast("double")
        g = F.when((n >= 3) & (F.col(f"__sp{i}") > 0),
                   F.col(f"__g{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        structs.append(F.struct(F.lit(c).alias("column_name"), g.alias("skewness")))
    return one.select(F.inline(F.array(*structs))).orderBy(F.desc_nulls_last("skewness"), "column_name")


def _joined_moments(parts) -> tuple:
    """Mean and sample deviation of all rows from (n, mean, population
    variance) of groups of them."""
    n, mean, m2 = 0, None, 0.0
    for k, m, v in sorted(p for p in parts if p[0]):
        if mean is None:
            n, mean, m2 = k, m, k * v
            continue
        step = m - mean
        m2 += k * v + step * step * (n * k / (n + k))
        mean += step * (k / (n + k))
        n += k
    return mean, math.sqrt(m2 / (n - 1)) if n > 1 else None


def summary_numeric(df: DataFrame, columns: list[str] | None = None,
                    percentiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """``describe`` of numeric columns (A1): count, mean, std (ddof=1), min,
    quartiles (linear interpolation), max, missing count and %.

    The table is read three times: one wide aggregate with moments, ranges
    and sketches (per ``MERGERS`` groups of tasks, whose moments are put
    together here), one that counts around the ranks, one that reads the rows
    near them (:mod:`tabsight.functions.quantiles`)."""
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    spark = df.sparkSession
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    qnames = [names.get(p, f"q{int(p * 100)}") for p in percentiles]
    xs = [F.nanvl(numeric_value(df, c), F.lit(None).cast("double")) for c in columns]
    parts = Q.mergers(df).agg(F.count(F.lit(1)).alias("__n"), *[e for i, x in enumerate(xs) for e in (
        *Q.sketch_columns(x, i), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"))])
    r = parts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"), *[e for i in range(len(columns)) for e in (
        *Q.merged_sketches(i, percentiles), F.collect_list(F.struct(f"n{i}", f"m{i}", f"v{i}")).alias(f"p{i}"))]
                  ).first().asDict()
    for i in range(len(columns)):
        r[f"n{i}"] = r[f"n{i}"] or 0
        r[f"m{i}"], r[f"s{i}"] = _joined_moments(r[f"p{i}"])
    q = {(row["column_name"], row["p"]): row["quantile"]
         for row in column_quantiles(df, columns, list(percentiles), stats=r).collect()}
    n = r["__n"]
    rows = []
    for i, c in enumerate(columns):
        miss = n - r[f"n{i}"]
        rows.append((c, _dtype(df, c), r[f"n{i}"], r[f"m{i}"], r[f"s{i}"], r[f"lo{i}"],
                     *[q.get((c, float(p))) for p in percentiles], r[f"hi{i}"], miss,
                     miss * 100.0 / n if n else None))
    schema = ("column_name string, dtype string, count bigint, mean double, std double, min double, "
              + ", ".join(f"{x} double" for x in qnames) + ", max double, missing_count bigint, missing_pct double")
    return spark.createDataFrame(rows, schema)


def summary_timestamp(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``describe`` of datetime columns (A1) in epoch microseconds: count,
    mean, min, quartiles, max (no std, as pandas)."""
    columns = columns if columns is not None else columns_of_kind(df, "datetime")
    s = summary_numeric(df, columns)
    return s.select("column_name", "dtype", "count", F.col("mean").alias("mean_us"),
                    F.col("min").alias("min_us"), F.col("q25").alias("q25_us"),
                    F.col("q50").alias("q50_us"), F.col("q75").alias("q75_us"),
                    F.col("max").alias("max_us"), "missing_count")


def summary_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``describe`` of text (and boolean) columns (A1, A2): count, unique,
    top (most frequent; ties -> smallest value), freq, missing count and %."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if kind_of(f.dataType) in ("text", "boolean")]
    per = _long_text(df, columns).where(F.col("value").isNotNull()) \
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top = per.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("cnt")).alias("a"), F.col("value").alias("b"))).alias("top"),
        F.max("cnt").alias("freq"))
    nc = _null_counts(df.select(*[col(c) for c in columns]))
    return nc.join(top, "column_name", "left").select(
        "column_name", "dtype", F.col("non_null").alias("count"),
        F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"), "top",
        F.col("freq").cast("bigint").alias("freq"),
        F.col("null_count").alias("missing_count"),
        F.try_divide(F.col("null_count") * 100.0, F.col("n_rows")).alias("missing_pct"))


def preview(df: DataFrame, key: list[str] | str, n: int = 10) -> DataFrame:
    """First ``n`` rows by an explicit key (S9/K1): Spark has no row order, so
    "head" means the smallest keys (``TakeOrderedAndProject``, a per-task
    top-n merged on the driver side of the plan)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[col(k) for k in keys]).limit(n)
