"""Helpers shared by the operators of this package."""

from __future__ import annotations

import importlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.session import checkpoint_dir

#: Rows of one Arrow batch handed to Python, unless the session says otherwise.
ARROW_ROWS = 1000
#: Largest side that a join may broadcast, by its counted size.
BROADCAST_BYTES = 32 << 20
#: A word, as a Java / Python pattern (ASCII white space separates words).
WORD = "[^\\x20\\x09-\\x0D]+"

MASK = (1 << 64) - 1


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the package holding them is the
    default of every ``path`` parameter and is only needed for that."""
    return importlib.import_module("public_tokenizers").path(name)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound Arrow batches by rows and bytes, because texts may be long.  A
    session that names its own row bound keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_large(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that broadcasts neither side.  Left to itself, Spark broadcasts what
    it takes to be small, and it sizes a table by its files: rows made by an
    explode, or packed well in Parquet, may be a hundred times as large, and
    the driver gathers them all."""
    return left.join(right.hint("merge"), on, how)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", row_bytes: int = 32,
               rows: int | None = None) -> DataFrame:
    """Join where ``right`` is broadcast only if its counted size is under
    ``BROADCAST_BYTES``; otherwise neither side is."""
    if rows is None:
        rows = right.count()
    if rows * row_bytes > BROADCAST_BYTES:
        return join_large(left, right, on, how)
    return left.join(F.broadcast(right), on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out
