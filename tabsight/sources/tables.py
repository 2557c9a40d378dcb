"""Named-table catalog (S4): the driver's parquet tables, canonicalised once
at the load boundary (NaN -> NULL in float columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsight.functions.columns import canonicalize

# The table names the catalog serves.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str, canonical: bool = True) -> DataFrame:
    """``spark.read.parquet(<sf_dir>/<name>.parquet)``; column pruning and
    filter pushdown reach the scan because everything downstream is lazy."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return canonicalize(df) if canonical else df
