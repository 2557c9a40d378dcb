"""Running sums, ranks and order statistics in a total order, without a window
over a whole table.

``Window.orderBy`` without ``partitionBy`` (or with a hot partition key) moves
every row to one task.  :func:`running_sum` sums inside sorted ranges and adds
the totals of earlier ranges; :func:`hash_cuts` finds order statistics of a
hash order from counts of its leading bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.session import keep

#: Rows of a range of :func:`running_sum`, about.
RANGE_ROWS = 1_000_000
#: Largest counted side that a join may broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits of a hash order (:func:`tabsight.functions.columns.hash_order`) that are
#: left out of its cells: 28 bits are cut into 65,536 cells.
CELL_SHIFT = 12


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", row_bytes: int = 64) -> DataFrame:
    """Join that broadcasts ``right`` (a kept table) if its counted size is
    under ``BROADCAST_BYTES``; beyond it Spark plans a shuffled join."""
    small = right.count() * row_bytes <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)


def running_sum(df: DataFrame, group: str | None, order: list[str], value, out,
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows of the same ``group`` that
    come before or at this row in ``order`` (which must be a total order).
    ``value``/``out`` may be lists to accumulate several columns at once.

    ``df`` runs once: it is written, and the written rows are dealt to sorted
    ranges of (group, order), in which each task adds up while it reads.  That
    is the only exchange of rows; what earlier ranges hold of a group is one
    small row per range and group."""
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    group_of = F.col(group).cast("string") if group else F.lit("")
    rows = keep(df.select("*", F.coalesce(group_of, F.lit("\x00null")).alias("__g")), "rows")
    n = partitions or max(1, -(-rows.count() // RANGE_ROWS))
    if n == 1:  # one range: counted, so a window by group holds few rows
        w = Window.partitionBy("__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*[F.col(f"`{c}`") for c in df.columns],
                           *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(o) for v, o in zip(values, outs)])
    kinds = ["double" if df.schema[v].dataType.typeName() in ("double", "float") else "long" for v in values]
    local = [f"__local{i}" for i in range(len(values))]

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sums = None, None
        for part in parts:  # sorted by group, so only one group is open
            if part.empty:
                continue
            made = {}
            first = part["__g"].iloc[0]
            for i, (name, v, kind) in enumerate(zip(local, values, kinds)):
                x = part[v].fillna(0).astype("float64" if kind == "double" else "int64")
                made[name] = x.groupby(part["__g"], sort=False).cumsum()
                if first == last:
                    made[name] = made[name].where(part["__g"] != first, made[name] + sums[i])
            part = part.assign(**made)
            last, sums = part["__g"].iloc[-1], [part[name].iloc[-1] for name in local]
            yield part

    types = rows.select("*", *[F.lit(None).cast(k).alias(name) for name, k in zip(local, kinds)]).schema
    dealt = rows.repartitionByRange(n, "__g", *order).sortWithinPartitions("__g", *order)
    summed = keep(dealt.mapInPandas(add_up, types).withColumn("__pid", F.spark_partition_id()), "sums")
    totals = summed.groupBy("__pid", "__g").agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(values)])
    earlier = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(totals.select("__pid", "__g", *[
        F.coalesce(F.sum(f"__t{i}").over(earlier), F.lit(0)).cast(k).alias(f"__off{i}") for i, k in enumerate(kinds)]), "offsets")
    res = join_checked(summed, offsets, ["__pid", "__g"])
    return res.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(name) + F.col(f"__off{i}")).alias(o)
                                     for i, (name, o) in enumerate(zip(local, outs))])


def dense_codes(values: DataFrame, group: str, value: str, out: str = "code") -> DataFrame:
    """0-based dense rank of the distinct ``value`` within each ``group``."""
    dv = values.select(group, value).distinct().withColumn("__one", F.lit(1).cast("bigint"))
    return running_sum(dv, group, [value], "__one", out).withColumn(out, F.col(out) - 1).drop("__one")


def hash_cuts(df: DataFrame, group: Column, score: Column, tie: Column, counts) -> DataFrame:
    """Order statistics of a hash order within groups, from two readings of
    ``df`` and none of its rows moved.

    ``counts(n)`` gives, for a group's number of rows, an array column of
    ranks c (from 1); the result holds the ``(score, tie)`` of the c-th row in
    that order: one row ``(g, cuts array<struct<score, tie>>)`` per group, with
    a null for a rank of 0.  Exactly c rows are at or below a cut, but for rows
    that repeat its score and tie.

    1. Rows are counted per group and leading bits of the hash.  The running
       sum over a group's cells (65,536 at most) shows the cell in which each
       rank falls.
    2. Only rows of those cells, one in 65,536, are ranked; rows that repeat a
       key are one counted row."""
    rows = df.select(group.alias("g"), score.alias("score"), tie.alias("tie")).where("g IS NOT NULL")
    cell = F.shiftright("score", CELL_SHIFT).alias("cell")
    cells = keep(rows.groupBy("g", cell).agg(F.count(F.lit(1)).alias("c")), "cells")
    upto = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("g")
    placed = cells.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(whole))
    ranks = F.filter(F.transform(counts(F.col("n")), lambda c, j: F.struct(j.alias("j"), c.cast("long").alias("rank"))),
                     lambda x: (F.col("upto") - F.col("c") < x["rank"]) & (x["rank"] <= F.col("upto")))
    edges = keep(placed.select("g", "cell", F.explode(ranks).alias("x"), (F.col("upto") - F.col("c")).alias("below"))
                 .groupBy("g", "cell").agg(F.collect_list(F.struct("x.j", (F.col("x.rank") - F.col("below")).alias("rest")))
                                           .alias("open")), "edges")
    near = join_checked(rows.withColumn("cell", F.shiftright("score", CELL_SHIFT)), edges.select("g", "cell"), ["g", "cell"])
    counted = near.groupBy("g", "cell", "score", "tie").agg(F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy("g", "cell").orderBy("score", "tie").rowsBetween(Window.unboundedPreceding, 0)
    hit = (counted.withColumn("upto", F.sum("c").over(within)).join(edges, ["g", "cell"])
           .select("g", F.struct("score", "tie").alias("at"), F.explode(F.filter("open", lambda x: (
               F.col("upto") - F.col("c") < x["rest"]) & (x["rest"] <= F.col("upto")))).alias("x")))
    n = cells.groupBy("g").agg(F.sum("c").alias("n")).select("g", F.size(counts(F.col("n"))).alias("size"))
    found = hit.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("x.j", "at"))).alias("at"))
    return keep(n.join(found, "g", "left").select("g", F.transform(
        F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.try_element_at("at", j.cast("int"))).alias("cuts")), "cuts")


def cuts_passed(cuts: Column, score: Column, tie: Column) -> Column:
    """How many of the ``cuts`` of a row's group lie below the row."""
    return F.size(F.filter(cuts, lambda c: c.isNull() | (score > c["score"]) | ((score == c["score"]) & (tie > c["tie"]))))
