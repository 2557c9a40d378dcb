"""Exact quantiles (linear interpolation, as pandas ``quantile`` / DuckDB
``quantile_cont``) computed without funnelling a column into one task.

Spark's exact ``percentile`` aggregate merges a value->count map of the whole
column in one final task, which does not survive a column with billions of
distinct values.  Here a table is read three times, whatever its size, and all
columns share each reading:

1. one aggregate gives ``n``, ``min``, ``max`` and a KLL sketch per column.
   Sketches are merged in two levels, so that no task gets those of all tasks.
   Each target rank takes the sketch's values a margin below and above it as
   its bracket;
2. one aggregate counts the rows below and inside every bracket, which are
   literals.  A bracket that the sketch put beside its rank (a matter of luck)
   is widened and counted again;
3. the rows inside any bracket (about two margins of the table) are grouped to
   ``(bracket, value, count)``.

What is left is small.  A bracket with few values is ranked by a running sum
within it; one with many values is written and cut into bins (count, min and
max per bin), and the bin that holds the rank is the next bracket, narrowed to
its own ``[min, max]``, until few values are left.  Every such pass puts the
smallest and the largest value into different bins, so it ends.  A hot value is
one ``(value, count)`` row after the partial aggregation.  Collected results
are bounded by targets and bins.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.session import keep

#: Size parameter of the sketches (rank error about 0.2 %), share of the rows
#: on each side of a rank that its bracket takes in (and then, if it misses),
#: and number of tasks that merge sketches.
SKETCH_K = 2048
MARGINS = (0.005, 0.04, 0.3)
MERGERS = 64


def _inf():
    return F.lit(float("inf"))


@dataclass
class _Bracket:
    bid: int
    value: Column        # of the frame that the bracket is looked for in
    where: Column | None
    lo: float            # inclusive
    hi: float            # inclusive
    below: int           # rows of the column below ``lo``
    rows: int            # rows inside, which bounds the distinct values
    ranks: list = field(default_factory=list)
    log: bool = False    # bins of equal width in the logarithm

    def inside(self) -> Column:
        at = (self.value >= F.lit(self.lo)) & (self.value <= F.lit(self.hi))
        return at if self.where is None else self.where & at

    def base(self) -> float:
        return _log_value(self.lo) if self.log else self.lo

    def width(self, bins: int) -> float:
        return ((_log_value(self.hi) - _log_value(self.lo)) if self.log else (self.hi - self.lo)) / bins


_TINY = 2.0 ** -1022     # smallest normal double


def _log_value(v: float) -> float:
    return math.copysign(math.log(abs(v)) - math.log(_TINY), v) if abs(v) > _TINY else 0.0


def _log_column(v):
    """Signed logarithm above the smallest normal double: keeps the order, and
    spreads values of all magnitudes over about +-1420."""
    return F.when(F.abs(v) > _TINY, F.signum(v) * (F.log(F.abs(v)) - F.lit(math.log(_TINY)))).otherwise(F.lit(0.0))


def _bin_counts(inside: DataFrame, bins: int) -> DataFrame:
    """``(bid, bin, cnt, mn, mx)`` of the rows ``(bid, v, base, w, lg)`` of the
    brackets being cut: declarative aggregates only (whole-stage codegen).
    Rows ``(bid, v, lo, w)`` without a scale are cut into equal widths."""
    if "lg" not in inside.columns:
        inside = inside.withColumns({"base": F.col("lo"), "lg": F.lit(False)})
    # every step keeps the order of the values, so bins are ordered ranges
    x = F.when(F.col("lg"), _log_column(F.col("v"))).otherwise(F.col("v"))
    b1 = F.least(F.greatest(F.floor((x - F.col("base")) / F.col("w")), F.lit(0)), F.lit(bins - 1)).cast("long")
    # infinities get their own end bins (one value each: resolved); a range
    # of infinite width puts all finite values in bin 0, whose [min, max] is
    # finite
    b1 = (F.when(F.col("v") == -_inf(), F.lit(-1).cast("long"))
          .when(F.col("v") == _inf(), F.lit(bins).cast("long"))
          .when(F.col("w") == _inf(), F.lit(0).cast("long"))
          .otherwise(b1))
    return (inside.withColumn("bin", b1)
            .groupBy("bid", "bin").agg((F.sum("c") if "c" in inside.columns else F.count(F.lit(1))).alias("cnt"),
                                       F.min("v").alias("mn"), F.max("v").alias("mx")))


def _matching(src: DataFrame, brackets: list[_Bracket], count: Column, *more) -> DataFrame:
    """``(bid, v, c, ...)`` of the rows of ``src`` inside any bracket; all
    bounds are literals, so they reach the scan as filters."""
    hits = [F.when(b.inside(), F.struct(F.lit(b.bid).cast("long").alias("bid"), b.value.alias("v"), count.alias("c"),
                                        *[F.lit(f(b)).alias(name) for name, f in more])) for b in brackets]
    any_of = brackets[0].inside()
    for b in brackets[1:]:
        any_of = any_of | b.inside()
    return src.where(any_of).select(F.inline(F.array_compact(F.array(*hits))))


def _rank_values(counted: DataFrame, brackets: list[_Bracket]) -> list:
    """Rows ``(bid, r, v)``: the value at each rank of each bracket, from a
    running sum over the bracket's few ``(value, count)`` rows."""
    w = Window.partitionBy("bid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("c").over(w))
    wanted = F.array(*[F.struct(F.lit(b.bid).cast("long").alias("b"), F.lit(r - b.below).cast("long").alias("r"))
                       for b in brackets for r in b.ranks])
    mine = F.filter(wanted, lambda x: (x["b"] == F.col("bid")) & (F.col("upto") - F.col("c") <= x["r"])
                    & (x["r"] < F.col("upto")))
    return upto.select("bid", "v", F.explode(mine).alias("x")).select("bid", "x.r", "v").collect()


def _values_at_ranks(src: DataFrame, brackets: list[_Bracket], max_group: int, bins: int,
                     count: Column | None = None) -> dict:
    """``{(bracket, rank): value}`` for every rank of every bracket of ``src``
    (``count`` rows per row), which is read once if all brackets hold at most
    ``max_group`` rows.  Otherwise what the brackets hold is written grouped by
    value, and the large ones are cut into bins there."""
    found: dict = {}
    active = []
    for b in brackets:
        if b.lo == b.hi:
            found.update({(b.bid, r): b.lo for r in b.ranks})
        else:
            active.append(b)
    if not active:
        return found
    counted = (_matching(src, active, F.lit(1).cast("long") if count is None else count)
               .groupBy("bid", "v").agg(F.sum("c").alias("c")))
    if any(b.rows > max_group for b in active):
        counted = keep(counted, "quantiles")
    owner = {b.bid: b.bid for b in active}       # bracket -> the one whose ranks it holds
    for b in active:
        b.value, b.where = F.col("v"), F.col("bid") == b.bid
    next_id, first = max(b.bid for b in brackets) + 1, True
    while active:
        # a range too narrow to cut into bins is ranked as it is
        small = [b for b in active if b.rows <= max_group or not (b.hi - b.lo) / bins > 0]
        big = [b for b in active if b not in small]
        for b in big:
            finite = math.isfinite(b.lo) and math.isfinite(b.hi)
            b.log = finite and (b.log or math.isinf(b.hi - b.lo))
            b.log = b.log and b.width(bins) > 0

        def finalize(small=small, first=first):
            if not small:
                return []
            same = first and len(small) == len(active)
            return _rank_values(counted if same else _matching(counted, small, F.col("c")), small)

        def histogram(big=big):
            if not big:
                return []
            return _bin_counts(_matching(counted, big, F.col("c"), ("base", _Bracket.base), ("lg", lambda b: b.log),
                                         ("w", lambda b: b.width(bins))), bins).collect()

        # the two passes are independent jobs: submit them together
        with ThreadPoolExecutor(max_workers=2) as pool:
            f_hit, f_hist = pool.submit(finalize), pool.submit(histogram)
            hit, hist = f_hit.result(), f_hist.result()
        below = {b.bid: b.below for b in small}
        for row in hit:
            found[(owner[row["bid"]], int(row["r"]) + below[row["bid"]])] = row["v"]
        active, first = [], False
        per: dict = {}
        for row in hist:
            per.setdefault(row["bid"], []).append((int(row["bin"]), int(row["cnt"]), float(row["mn"]), float(row["mx"])))
        for b in big:
            acc = b.below
            for _, cnt, mn, mx in sorted(per.get(b.bid, [])):
                ranks = [r for r in b.ranks if acc <= r < acc + cnt]
                if ranks and mn == mx:
                    found.update({(owner[b.bid], r): mn for r in ranks})
                elif ranks:
                    # a bin that keeps over an eighth of its bracket (a heavy tail) is cut in the logarithm next
                    active.append(_Bracket(next_id, b.value, b.where, mn, mx, acc, cnt, ranks, not b.log and 8 * cnt > b.rows))
                    owner[next_id] = owner[b.bid]
                    next_id += 1
                acc += cnt
    return found


def _lerp(a: float, b: float, frac: float) -> float:
    """Linear interpolation between neighbouring order statistics; equal or
    infinite endpoints give the endpoint (both infinite and different: NaN)."""
    if not frac or a == b:
        return a
    if math.isinf(a) or math.isinf(b):
        return math.nan if math.isinf(a) and math.isinf(b) else (a if math.isinf(a) else b)
    return a + (b - a) * frac


def _shares(probs) -> list[float]:
    return [s for p in probs for m in MARGINS for s in (max(p - m, 0.0), min(p + m, 1.0))]


def sketch_columns(x: Column, i) -> list[Column]:
    """Aggregates of one column for :func:`merged_sketches`."""
    return [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias(f"sk{i}")]


def merged_sketches(i, probs) -> list[Column]:
    """The same over the results of several groups of rows, with the sketch's
    values around each probability (``q{i}``)."""
    n, sketch = F.sum(f"n{i}"), F.kll_merge_agg_double(f"sk{i}", F.lit(SKETCH_K))
    at = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(s)) for s in _shares(probs)]))
    return [n.alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"),
            F.when(n > 0, at).alias(f"q{i}")]


def mergers(df: DataFrame, *by):
    """``df`` grouped into ``MERGERS`` parts by task (and by ``by``)."""
    return df.groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("__part"))


def _finish(spark, src: DataFrame, columns: list[dict], probs, max_group: int, bins: int, name_col: str) -> DataFrame:
    """``columns``: for each, its name ``k``, ``value`` and ``where`` columns of
    ``src`` and n, lo, hi, q of the sketch pass."""
    plan, open_, brackets = [], [], []
    for c in columns:
        n, whole = int(c["n"] or 0), None
        for j, p in enumerate(probs):
            if not n:
                plan.append((c["k"], p, None, 0, 0, 0.0))
                continue
            h = (n - 1) * float(p)
            r0, r1 = int(math.floor(h)), min(int(math.floor(h)) + 1, n - 1)
            b = whole
            if b is None:
                b = _Bracket(len(brackets), c["value"], c["where"], float(c["lo"]), float(c["hi"]), 0, n)
                brackets.append(b)
            b.ranks = sorted({*b.ranks, r0, r1})
            plan.append((c["k"], p, b.bid, r0, r1, h - r0))
            if n > max_group and b.lo < b.hi:
                q = c["q"][2 * len(MARGINS) * j:]
                open_.append((b, [(q[2 * m], q[2 * m + 1]) for m in range(len(MARGINS))]))
            else:
                whole = b  # a short column is one bracket for all its ranks
    while open_:  # one reading, but for brackets beside their ranks
        tries = [(b, *around[0]) for b, around in open_ if around]
        if not tries:
            break
        r = src.agg(*[F.count(F.when(e if b.where is None else b.where & e, 1)).alias(f"{name}{i}")
                      for i, (b, lo, hi) in enumerate(tries)
                      for name, e in (("b", b.value < F.lit(lo)), ("i", (b.value >= F.lit(lo)) & (b.value <= F.lit(hi))))]
                    ).first()
        missed = []
        for i, (b, lo, hi) in enumerate(tries):
            if r[f"b{i}"] <= b.ranks[0] and b.ranks[-1] < r[f"b{i}"] + r[f"i{i}"]:
                b.lo, b.hi, b.below, b.rows = float(lo), float(hi), r[f"b{i}"], r[f"i{i}"]
            else:
                missed.append(b.bid)
        open_ = [(b, around[1:]) for b, around in open_ if b.bid in missed]
    found = _values_at_ranks(src, brackets, max_group, bins)
    out = [(k, float(p), None if bid is None else _lerp(found[(bid, r0)], found[(bid, r1)], frac))
           for k, p, bid, r0, r1, frac in plan]
    return spark.createDataFrame(out, f"{name_col} string, p double, quantile double")


def exact_quantiles(long_df: DataFrame, probs: list[float], name_col: str = "column_name",
                    value_col: str = "value", max_group: int = 20_000, bins: int = 1024) -> DataFrame:
    """Exact ``quantile_cont`` of every column in a long ``(name, value)`` frame.

    Returns a small DataFrame ``(column_name, p, quantile)`` with one row per
    column and probability; nulls (and NaN) are ignored; a column without values
    gets NULL quantiles."""
    src = long_df.select(F.col(name_col).alias("k"),
                         F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double")).alias("v"))
    base = mergers(src, "k").agg(*sketch_columns(F.col("v"), "")).groupBy("k").agg(*merged_sketches("", probs)).collect()
    return _finish(long_df.sparkSession, src, [r.asDict() | {"value": F.col("v"), "where": F.col("k").eqNullSafe(F.lit(r["k"]))}
                                               for r in base], probs, max_group, bins, name_col)


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], max_group: int = 20_000,
                     bins: int = 1024, stats: dict | None = None) -> DataFrame:
    """:func:`exact_quantiles` of columns of a wide frame; ``stats`` (keys
    n{i}, lo{i}, hi{i}, q{i}) lets a caller that has already aggregated the
    table with :func:`sketch_columns` and :func:`merged_sketches` skip the
    first reading."""
    from tabsight.functions.columns import numeric_value
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column_name string, p double, quantile double")
    xs = [F.nanvl(numeric_value(df, c), F.lit(None).cast("double")) for c in columns]
    if stats is None:
        stats = mergers(df).agg(*[e for i, x in enumerate(xs) for e in sketch_columns(x, i)]).agg(
            *[e for i in range(len(columns)) for e in merged_sketches(i, probs)]).first()
    return _finish(spark, df, [{"k": c, "value": x, "where": None} | {name: stats[f"{name}{i}"] for name in ("n", "lo", "hi", "q")}
                               for i, (c, x) in enumerate(zip(columns, xs))], probs, max_group, bins, "column_name")


def approx_quantiles(long_df: DataFrame, probs: list[float], accuracy: int = 10_000,
                     name_col: str = "column_name", value_col: str = "value") -> DataFrame:
    """Single-pass sketch alternative (rank error <= n/accuracy)."""
    q = (long_df.where(F.col(value_col).isNotNull())
         .groupBy(name_col)
         .agg(F.percentile_approx(F.col(value_col).cast("double"), list(probs), accuracy).alias("qs")))
    return q.select(name_col, F.posexplode("qs").alias("i", "quantile")) \
        .withColumn("p", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1)) \
        .select(name_col, "p", "quantile")
