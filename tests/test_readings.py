"""How often operators read their input, and that wide or many-class inputs
keep their results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import evaluate as EV
from tabsight.operators import prepare as PR
from tabsight.operators import profile as P
from tabsight.operators import stats as S
from tabsight.plans.compare import assign_folds


class Counted:
    """A frame that counts the rows read of it."""

    def __init__(self, spark, df):
        self.n, self.rows = df.count(), spark.sparkContext.accumulator(0)
        rows = self.rows

        def pass_on(parts):
            for part in parts:
                rows.add(len(part))
                yield part
        self.df = df.mapInPandas(pass_on, df.schema)

    def readings(self):
        return self.rows.value / self.n


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    n = 60_000
    pdf = pd.DataFrame({"k": np.arange(n), "a": rng.normal(size=n), "b": rng.lognormal(0, 3, n),
                        "c": np.where(np.arange(n) % 7 == 0, np.nan, np.arange(n) % 50), "g": [f"g{i % 3}" for i in range(n)],
                        "label": (np.arange(n) % 2).astype(float), "score": np.round(rng.normal(size=n), 2)})
    df = spark.createDataFrame(pdf).repartition(4)
    return df.withColumn("c", F.nanvl("c", F.lit(None).cast("double")))


def test_summary_reads_three_times(spark, numbers):
    t = Counted(spark, numbers.select("a", "b", "c"))
    got = {r["column_name"]: r for r in P.summary_numeric(t.df).collect()}
    assert t.readings() <= 3
    pdf = numbers.select("a", "b", "c").toPandas()
    want = pdf.describe()
    for c in pdf:
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert got[c][ours] == pytest.approx(want[c][theirs], rel=1e-11)


def test_curves_read_once(spark, numbers):
    for curve in (EV.roc_curve, EV.pr_curve, EV.roc_auc):
        t = Counted(spark, numbers.select("label", "score"))
        curve(t.df).collect()
        assert t.readings() == 1


def test_curves_leave_out_rows_without_score(spark):
    rows = [(1.0, 0.9), (0.0, 0.8), (1.0, 0.7), (0.0, 0.1)]
    whole = spark.createDataFrame(rows, "label double, score double")
    more = whole.union(spark.createDataFrame([(1.0, None), (0.0, None), (None, 0.5)], "label double, score double"))
    for curve in (EV.roc_curve, EV.pr_curve, EV.roc_auc):
        assert sorted(map(str, curve(more).collect())) == sorted(map(str, curve(whole).collect()))


def test_encoding_reads_twice(spark, numbers):
    t = Counted(spark, numbers.select("k", "g"))
    got = {r["k"]: r["g"] for r in PR.label_encode(t.df, ["g"]).collect()}
    assert t.readings() == 2 and all(v == k % 3 for k, v in got.items())


def test_split_and_folds_read_three_times(spark, numbers):
    t = Counted(spark, numbers.select("k", "g"))
    out = PR.stratified_split(t.df, ["k"], "g", 0.2).groupBy("g").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()
    assert t.readings() == 3 and {r["n"] for r in out} == {4000}  # two to find the cuts, one for the rows
    t = Counted(spark, numbers.select("k", "g"))
    out = assign_folds(t.df, "k", 5, "g").groupBy("g", "fold").count().collect()
    assert t.readings() == 3 and len(out) == 15 and {r["count"] for r in out} == {4000}


def test_split_with_many_classes(spark):
    df = spark.range(40_000, numPartitions=4).select(F.col("id").alias("k"), (F.col("id") % 5000).cast("string").alias("y"))
    out = PR.stratified_split(df, ["k"], "y", 0.25).groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("n"))
    assert [(r["n"], r["count"]) for r in out.groupBy("n").count().collect()] == [(2, 5000)]
    null = df.union(spark.createDataFrame([(-1, None)], "k long, y string"))
    assert PR.stratified_split(null, ["k"], "y", 0.25).where("y IS NULL").first()["is_test"] is False


@pytest.mark.parametrize("d", [13, 200])
def test_correlation_of_wide_tables(spark, d):
    rng = np.random.default_rng(d)
    n = 400
    x = (rng.normal(size=(n, d)) + rng.normal(size=d) * 1e3) * 10.0 ** rng.integers(-30, 30, d)
    x[:, 1] = 3 * x[:, 0] + rng.normal(size=n) * np.abs(x[:, 0]).mean() / 100
    x[rng.random((n, d)) < 0.15] = np.nan
    x[:, 4] = 7.0                                       # no spread at all
    x[:, 5] = np.where(np.isnan(x[:, 6]), rng.normal(size=n), 2.5)  # none where column 6 is present
    x[:, 7] = np.nan
    x[:n // 2, 8], x[n // 2:, 9] = np.nan, np.nan        # never present together
    x[:, 10] = 1e6 + np.where(np.arange(n) % 2, 1e-4, 0)  # little beside its size
    x[0, 10], x[:, 11] = np.nan, np.where(np.arange(n) == 3, 1e12, rng.normal(size=n))  # one far value
    x[3, 12] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(d)])
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in pdf]).repartition(5)
    got = {(r["i"], r["j"]): r["corr"] for r in S.correlation_matrix(df).collect()}
    want = pdf.corr(min_periods=2).to_numpy()
    assert len(got) == d * d
    for (i, j), r in got.items():
        if i == j:
            assert r == (None if i in (4, 7) else 1.0)
            continue
        both = pdf.iloc[:, [i, j]].dropna()
        if len(both) < 2 or both.iloc[:, 0].nunique() < 2 or both.iloc[:, 1].nunique() < 2:
            assert r is None, (i, j, r)
        else:
            exact = np.corrcoef(both.to_numpy().T)[0, 1] if {10, 11} & {i, j} else want[i, j]
            assert r == pytest.approx(exact, rel=1e-6, abs=1e-7), (i, j)
    assert S.correlation_matrix(df.limit(0)).where("corr IS NOT NULL").count() == 0
