"""Column kinds, quoting and value canonicalisation.

One numeric predicate is used everywhere (every integral, floating and decimal
type), text is ``StringType``, datetimes are date/timestamp/timestamp_ntz.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("numeric", "text", "datetime", "boolean", "nested")

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "nested"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of one kind, in schema order (driver-side schema scan)."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def quote(name: str) -> str:
    """Backtick-quote a column name so dots and spaces survive ``F.col``/SQL."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def canonicalize(df: DataFrame) -> DataFrame:
    """Single missing-value notion: NaN in float/double columns becomes NULL.

    Applied once at the load boundary; every later statistic can then rely on
    SQL null semantics."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def numeric_value(df: DataFrame, name: str) -> Column:
    """A column as double for statistics; datetimes become epoch microseconds
    (time-zone independent for ``timestamp_ntz``)."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, {quote(name)})").cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dt, T.DateType):
        return (F.unix_date(c).cast("double") * F.lit(86_400_000_000.0))
    return c.cast("double")


def hash_order(key: Column) -> Column:
    """Deterministic pseudo-random order of a key, independent of partitioning:
    the first 28 bits of md5 of the key's text, as a bigint."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("bigint")


def sig_round(c: str, digits: int = 6) -> Column:
    """Round the double column named ``c`` to ``digits`` significant digits
    (values below 1e-9 in magnitude become 0, and -0.0 becomes 0.0).  Used
    where results are compared exactly with another engine whose summation
    order differs.  Only exact powers of ten are used as factors, so both
    engines round identically.  Built as one SQL expression: one call to the
    JVM per column instead of one per sub-expression."""
    x = f"CAST({quote(c)} AS DOUBLE)"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    return F.expr(
        f"CASE WHEN {x} IS NULL THEN NULL "
        f"WHEN isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE) THEN {x} "
        f"WHEN abs({x}) < 1e-9D THEN 0.0D "
        f"WHEN {k} >= 0 THEN round({x} * pow(10.0D, {k})) / pow(10.0D, {k}) + 0.0D "
        f"ELSE round({x} / pow(10.0D, -{k})) * pow(10.0D, -{k}) + 0.0D END")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Apply :func:`sig_round` to every double/float column."""
    return df.select(*[sig_round(f.name, digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
                       for f in df.schema.fields])


def unpivot_numeric(df: DataFrame, columns: list[str] | None = None,
                    name_col: str = "column_name", value_col: str = "value") -> DataFrame:
    """Long form ``(column_name, value double)`` of the numeric (and, when
    listed, datetime) columns; nulls are kept so callers decide."""
    columns = columns if columns is not None else columns_of_kind(df, "numeric")
    if not columns:
        return df.sparkSession.createDataFrame([], f"{name_col} string, {value_col} double")
    arr = F.array(*[F.struct(F.lit(c).alias("n"), numeric_value(df, c).alias("v")) for c in columns])
    return df.select(F.inline(arr)).toDF(name_col, value_col)


def unpivot_text(df: DataFrame, columns: list[str] | None = None,
                 name_col: str = "column_name", value_col: str = "value") -> DataFrame:
    """Long form ``(column_name, value string)`` of text-like columns."""
    columns = columns if columns is not None else columns_of_kind(df, "text")
    if not columns:
        return df.sparkSession.createDataFrame([], f"{name_col} string, {value_col} string")
    arr = F.array(*[F.struct(F.lit(c).alias("n"), col(c).cast("string").alias("v")) for c in columns])
    return df.select(F.inline(arr)).toDF(name_col, value_col)
