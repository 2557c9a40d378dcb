import numpy as np
import pytest

from tabsight.functions import column_quantiles, exact_quantiles, unpivot_numeric
from tabsight.functions.ranking import running_sum


def _q(spark, values, probs, **kw):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    rows = column_quantiles(df, ["x"], probs, **kw).collect()
    return {r["p"]: r["quantile"] for r in rows}


@pytest.mark.parametrize("max_group,bins", [(20_000, 1024), (3, 4)])
def test_matches_numpy_linear(spark, max_group, bins):
    rng = np.random.default_rng(1)
    vals = np.round(rng.lognormal(size=997), 3).tolist()
    got = _q(spark, vals, [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0], max_group=max_group, bins=bins)
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(vals, p)), rel=1e-12)


def test_hot_value_and_nulls(spark):
    vals = [5.0] * 400 + list(range(200)) + [None] * 50
    got = _q(spark, vals, [0.25, 0.5, 0.75], max_group=2, bins=8)
    clean = [v for v in vals if v is not None]
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(clean, p)))


def test_empty_and_single(spark):
    assert _q(spark, [None, None], [0.5]) == {0.5: None}
    assert _q(spark, [3.5], [0.25, 0.75]) == {0.25: 3.5, 0.75: 3.5}


def test_long_form_several_columns(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(100)], "a double, b double")
    rows = exact_quantiles(unpivot_numeric(df, ["a", "b"]), [0.5]).collect()
    got = {r["column_name"]: r["quantile"] for r in rows}
    assert got == {"a": 49.5, "b": float(np.median([i % 7 for i in range(100)]))}


def test_running_sum_total_order(spark):
    df = spark.createDataFrame([(i % 3, i, 1) for i in range(50)], "g int, o int, one long")
    out = running_sum(df, "g", ["o"], "one", "rank", partitions=5).collect()
    for r in out:
        assert r["rank"] == len([i for i in range(50) if i % 3 == r["g"] and i <= r["o"]])


def test_constant_zero_and_clustered_values(spark):
    # a constant 0.0 column (its range cannot be cut into bins) and clusters
    # of near-equal values that need several narrowing passes
    assert _q(spark, [0.0] * 50, [0.1, 0.9], max_group=3, bins=4) == {0.1: 0.0, 0.9: 0.0}
    rng = np.random.default_rng(7)
    vals = ([1e-6 * i for i in range(40)] + [1e6 + i * 1e-3 for i in range(40)]
            + rng.normal(size=40).tolist() + [2.0] * 60)
    got = _q(spark, vals, [0.05, 0.3, 0.5, 0.7, 0.95], max_group=3, bins=4)
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(vals, p)), rel=1e-12)


def test_hash_cuts_repeated_key(spark):
    # one key repeated on a third of the rows: it is one counted row of its cell
    from pyspark.sql import functions as F
    from tabsight.functions.ranking import cuts_passed, hash_cuts
    rows = [("a", 5, "k1")] * 30 + [("a", 5, f"k{i:03d}") for i in range(2, 32)] \
        + [("a", i << 13, f"z{i}") for i in range(30)] + [("b", 7, "x"), (None, 1, "y")]
    df = spark.createDataFrame(rows, "g string, s long, t string")
    order = sorted((s, t) for g, s, t in rows if g == "a")
    ranks = [1, 10, 40, 45, 70, 90]
    cuts = hash_cuts(df, F.col("g"), F.col("s"), F.col("t"), lambda n: F.when(n > 1, F.array(*map(F.lit, ranks)))
                     .otherwise(F.array(F.lit(0), F.lit(1))))
    got = {r["g"]: [c and tuple(c) for c in r["cuts"]] for r in cuts.collect()}
    assert got == {"a": [order[c - 1] for c in ranks], "b": [None, (7, "x")]}
    passed = df.join(cuts, "g").select("g", "s", "t", cuts_passed(F.col("cuts"), F.col("s"), F.col("t")).alias("n")).collect()
    for r in passed:
        assert r["n"] == (sum(order[c - 1] < (r["s"], r["t"]) for c in ranks) if r["g"] == "a" else 1)


def test_running_sum_over_ranges_and_batches(spark):
    """Groups over several ranges and several batches; a null group; two sums."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(("a", "b", None)[i % 3], i * 7 % 101, i, None if i % 5 == 0 else i / 4) for i in range(101)]
        df = spark.createDataFrame(rows, "g string, o int, x long, y double")
        for n in (None, 6):
            out = running_sum(df, "g", ["o"], ["x", "y"], ["sx", "sy"], partitions=n).collect()
            assert len(out) == len(rows)
            for r in out:
                same = [q for q in rows if q[0] == r["g"] and q[1] <= r["o"]]
                assert r["sx"] == sum(q[2] for q in same)
                assert r["sy"] == pytest.approx(sum(q[3] or 0 for q in same))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("max_group,bins", [(20_000, 1024), (3, 4)])
def test_infinite_values(spark, max_group, bins):
    inf = float("inf")
    vals = [-inf] * 5 + [float(i) for i in range(30)] + [inf] * 7
    probs = [0.0, 0.05, 0.2, 0.5, 0.8, 0.95, 1.0]
    got = _q(spark, vals, probs, max_group=max_group, bins=bins)
    # exact order statistics: compare the probabilities that hit a single rank
    n = len(vals)
    for p in probs:
        h = (n - 1) * p
        if h == int(h):
            assert got[p] == sorted(vals)[int(h)]
    assert _q(spark, [inf] * 4, [0.5], max_group=max_group, bins=bins) == {0.5: inf}   # as DuckDB
    assert _q(spark, [-inf, 1.0, 2.0], [0.25], max_group=max_group, bins=bins) == {0.25: -inf}
    mixed = [1.0, 2.0, 3.0, inf]
    assert _q(spark, mixed * 10, [0.25], max_group=max_group, bins=bins)[0.25] == \
        float(np.quantile(mixed * 10, 0.25))
