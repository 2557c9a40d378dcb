import json
import os

import numpy as np
import pytest

from tabsight.operators import models as M
from tabsight.plans import compare as C
from tabsight.sources import files as FI
from tabsight.sources import model_store as MS


@pytest.fixture(scope="module")
def ring(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3))
    y = (X[:, 0] ** 2 + X[:, 1] ** 2 > 1.2).astype(int)
    rows = [(i, *map(float, X[i]), int(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int"), X, y


def test_knn_matches_brute_force(spark, ring):
    df, X, y = ring
    tr, te = df.where("k < 240"), df.where("k >= 240")
    m = M.knn(tr, ["a", "b", "c"], "y", "k", True, scale=False)
    m.pivots, m.block_rows = 6, 40                 # force several cells and rings
    got = {r["k"]: r["prediction"] for r in m.transform(te).collect()}
    for q in range(240, 300):
        d = ((X[:240] - X[q]) ** 2).sum(axis=1)
        nn = np.lexsort((np.arange(240), d))[:5]
        votes = np.bincount(y[nn], minlength=2)
        assert got[q] == int(np.argmax(votes))


def test_gaussian_nb_matches_numpy(spark, ring):
    df, X, y = ring
    m = M.gaussian_nb(df, ["a", "b", "c"], "y")
    got = np.array([r["prediction"] for r in m.transform(df).orderBy("k").collect()])
    eps = 1e-9 * X.var(axis=0).max()
    ll = []
    for c in (0, 1):
        Xc = X[y == c]
        mu, var = Xc.mean(axis=0), Xc.var(axis=0) + eps
        ll.append(np.log(len(Xc) / len(X)) - 0.5 * np.log(2 * np.pi * var).sum()
                  - ((X - mu) ** 2 / (2 * var)).sum(axis=1))
    assert (got == np.argmax(np.vstack(ll), axis=0)).all()


def test_models_beat_majority_and_are_deterministic(spark, ring):
    df, _, y = ring
    majority = max(y.mean(), 1 - y.mean())
    rf1 = M.random_forest(M.fixed_layout(df.repartition(3), ["k"]), ["a", "b", "c"], "y", num_trees=20)
    rf2 = M.random_forest(M.fixed_layout(df.repartition(7), ["k"]), ["a", "b", "c"], "y", num_trees=20)
    assert rf1.importances() == rf2.importances()
    assert abs(sum(v for _, v in rf1.importances()) - 1.0) < 1e-9
    acc = np.mean([r["prediction"] == r["y"] for r in rf1.transform(df).collect()])
    assert acc >= majority
    svm = M.svm_rbf(df, ["a", "b", "c"], "y", n_components=64)
    acc_svm = np.mean([r["prediction"] == r["y"] for r in svm.transform(df).collect()])
    assert acc_svm >= majority


def test_save_load_same_predictions(spark, ring, tmp_path):
    df, _, _ = ring
    store = str(tmp_path / "store")
    for m in (M.logistic(df, ["a", "b"], "y"), M.gaussian_nb(df, ["a", "b"], "y"),
              M.knn(df, ["a", "b"], "y", "k", True)):
        fname = MS.save_model(m, store)
        back = MS.load_model(store, fname)
        a = [r["prediction"] for r in m.transform(df).orderBy("k").collect()]
        b = [r["prediction"] for r in back.transform(df).orderBy("k").collect()]
        assert a == b
    assert MS.list_models(spark, store).count() == 3


def test_recommendation_ties_first(spark):
    rows = [(0, "A", 0.9, 0.8, 0.7, 0.8, 0.5, 0.1, None, None), (1, "B", 0.9, 0.9, 0.9, 0.8, 0.6, 0.1, None, None)]
    m = spark.createDataFrame(rows, "ordinal int, model string, accuracy double, precision double, recall double, "
                                    "f1 double, cv_mean double, cv_std double, roc_auc double, error string")
    r = C.recommend_model(m, "Classification").first()
    assert (r["best_accuracy"], r["best_f1"], r["best_cv"], r["recommended"]) == ("A", "A", "B", "A")


def test_csv_na_tokens_and_dates(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,v,when,name\n1,1.5,2024-01-02,x\n2,NA,2024-02-03,n/a\n3,#N/A,,y\n")
    df = FI.read_csv(spark, str(p))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "date", "string"]
    assert df.where("v is null").count() == 2 and df.where("name is null").count() == 1


def test_json_array_and_nested(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"a": 1, "o": {"x": 2}}, {"a": 3, "o": {"x": 4}}]))
    df = FI.read_json(spark, str(p))
    assert df.count() == 2 and df.select("o.x").first()[0] == 2


def test_workbook_round_trip(spark, tmp_path):
    d = tmp_path / "wb"
    os.makedirs(d)
    (d / "one.xlsx").write_bytes(FI.workbook_bytes(["k", "name", "v"], [(1, "a&b", 1.5), (2, None, None)]))
    df = FI.read_workbooks(spark, str(d))
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, "a&b", 1.5), (2, None, None)]


def test_csv_quotes_line_breaks_and_codes(spark, tmp_path):
    import pandas as pd
    from tabsight.sources.files import read_csv, write_csv
    f = tmp_path / "a.csv"
    f.write_text('id,j,code\n1,"{""a"": 1, ""b"": 2}",1d\n2,"two\nlines, here",2f\n')
    df = read_csv(spark, str(f))
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, '{"a": 1, "b": 2}', "1d"), (2, "two\nlines, here", "2f")]
    out = write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = pd.read_csv(next((tmp_path / "out").glob("part-*.csv")))
    assert out and sorted(map(tuple, back.values.tolist())) == rows


def test_workbooks_are_written_and_parsed_in_bounded_parts(spark, tmp_path, monkeypatch):
    import tracemalloc
    from types import GeneratorType
    monkeypatch.setattr(FI, "WORKBOOK_ROWS", 40)
    df = spark.range(0, 330, 1, 1).selectExpr("id AS k", "concat('<n&', id, '>') AS name", "IF(id % 3 = 0, NULL, id / 4) AS v")
    path = FI.write_workbooks(df, str(tmp_path / "wb"))
    files = list((tmp_path / "wb").glob("*.xlsx"))
    assert len(files) >= 9  # no file holds all rows of the one partition
    got = sorted(map(tuple, FI.read_workbooks(spark, path).collect()))
    assert got == sorted(map(tuple, df.collect()))
    data = FI.workbook_bytes(["a", "b"], [(i, "x" * 50) for i in range(20_000)])
    rows = FI._first_sheet_rows(data)
    assert isinstance(rows, GeneratorType)
    tracemalloc.start()
    assert sum(1 for _ in rows) == 20_001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6
