"""Sums of products of many columns in one pass, under null masks.

With d columns a correlation matrix needs d(d+1)/2 pairs; as expressions of one
aggregate they outgrow generated code at a few dozen columns.  Here each task
keeps matrices: per batch, four matrix products add up, for every pair, the
number of rows in which both are present and the sums of values, squares and
products over these rows.  A task hands over one small row per pair, which
Spark adds up by pair.  Values are shifted and scaled (by statistics that the
caller has) so that the sums keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def masked_gram(df: DataFrame, xs: list[Column], shift: list, scale: list) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` for every pair i <= j of ``xs``:
    sums over the rows with both present, of (x - shift) / scale."""
    d = len(xs)
    shift = np.array([0.0 if v is None else v for v in shift])
    scale = np.array([v if v else 1.0 for v in scale])
    at = np.triu_indices(d)

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, p = (np.zeros((d, d)) for _ in range(4))
        for part in parts:
            a = part.to_numpy(dtype=float, na_value=np.nan)
            there = ~np.isnan(a)
            z = np.where(there, (a - shift) / scale, 0.0)
            there = there.astype(float)
            n += there.T @ there
            s += z.T @ there
            q += (z * z).T @ there
            p += z.T @ z
        yield pd.DataFrame({"i": at[0], "j": at[1], "n": n[at].astype(np.int64), "sx": s[at], "sy": s.T[at],
                            "sxx": q[at], "syy": q.T[at], "sxy": p[at]})

    rows = df.select(*[x.alias(f"c{i}") for i, x in enumerate(xs)]).mapInPandas(
        add, "i int, j int, n long, " + ", ".join(f"{c} double" for c in SUMS[1:]))
    return rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def scaled_spread(lo, hi) -> float:
    """Scale of a column of range [lo, hi]: the range, if it is a number."""
    if lo is None or lo == hi:
        return 1.0
    width = hi - lo
    return width if np.isfinite(width) else max(abs(lo), abs(hi)) if np.isfinite(max(abs(lo), abs(hi))) else 1.0


def spread(side: str) -> Column:
    """n times the variance of one side ("x" or "y") of a pair."""
    return F.col(f"s{side}{side}") - F.try_divide(F.col(f"s{side}") * F.col(f"s{side}"), F.col("n"))


def pair_correlation() -> Column:
    """Pearson's r of a pair from its sums; null without spread."""
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    x, y = spread("x"), spread("y")
    return F.when((x > 0) & (y > 0), F.try_divide(F.try_divide(cov, F.sqrt(x)), F.sqrt(y)))
