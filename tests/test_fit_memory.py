"""What fits hold in the executors: features once, and one fit on many rows at a time."""

import threading
import time

import pytest

from tabsight.operators import models as M
from tabsight.plans import compare as C


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 30 + 40 * (i % 3)), i % 3) for i in range(90)], "k long, x double, y int")


def test_features_of_a_machine_are_not_kept_in_memory_twice(spark, rows, monkeypatch):
    seen = []
    for kind in (M.LinearSVC, M.OneVsRest):
        monkeypatch.setattr(kind, "fit", lambda self, dataset: seen.append((type(self), dataset.storageLevel, dataset.count())))
    M.svm_rbf(rows.where("y < 2"), ["x"], "y", n_components=16)
    M.svm_rbf(rows, ["x"], "y", n_components=16)
    assert [(kind, s.useMemory, s.useDisk, n) for kind, s, n in seen] == [
        (M.LinearSVC, False, False, 60), (M.OneVsRest, False, True, 90)]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


@pytest.mark.parametrize("least, most", [(10, 1), (1000, 6)])
def test_fits_on_many_rows_take_turns(rows, monkeypatch, least, most):
    lock, running, peak = threading.Lock(), [0], [0]

    def fit(*_, **__):
        with lock:
            running[0] += 1
            peak[0] = max(peak[0], running[0])
        time.sleep(0.5)
        with lock:
            running[0] -= 1
    monkeypatch.setattr(C, "ALONE_ROWS", least, raising=False)
    monkeypatch.setattr(C, "fit_model", fit)
    monkeypatch.setattr(C, "_score", lambda *_: 1.0)
    found = C.search_random(rows, ["x"], "y", "k", "Decision Tree", True, 3, n_iter=4, grid={"max_depth": [1, 2, 3, 4]})
    assert found.table.count() == 4 and (peak[0] == 1 if most == 1 else 1 < peak[0] <= most)
