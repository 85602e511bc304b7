"""Queries on vectors see all 64 numbers and all labels."""

import numpy as np
import pytest

from loam.plans import choosing as C
from loam.plans import crossval as M

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    frame = C.whole(spark, SF).toPandas()
    return frame, frame[list(C.ALL)].to_numpy()


def test_all_numbers_and_labels(spark, table):
    frame, x = table
    assert x.shape[1] == 64 and frame.label.nunique() == 10
    assert {r.feature for r in C.mi_knn(spark, SF).collect()} == set(C.ALL)
    assert {r.feature for r in C.whole_mi_binned(spark, SF).collect()} == set(C.ALL)


def test_pairs_of_all_features(spark, table):
    r = np.corrcoef(table[1].T)
    got = {(x.a, x.b): x.r for x in C.whole_corr_matrix(spark, SF).collect()}
    assert got == {(a, b): pytest.approx(r[i, j], abs=1e-5) for i, a in enumerate(C.ALL) for j, b in enumerate(C.ALL) if i < j}
    assert [x.feature for x in C.whole_corr_prune(spark, SF).collect() if x.dropped] == ["x0"]


def test_histogram_of_each_feature(spark, table):
    got = C.whole_class_histogram(spark, SF).groupBy("feature").sum("n").collect()
    assert {x[0]: x[1] for x in got} == dict.fromkeys(C.ALL, len(table[0]))


def test_predictions_know_ten_labels(spark, table):
    got = C.loro_predict(spark, SF).collect()
    assert len(got) == len(table[0]) and all(len(x.proba) == 10 for x in got)


def test_permutation_of_all_features_at_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, "ab"[i // 2 % 2], float((i // 2 % 2) * 6 + rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(80)]
    t = spark.createDataFrame(rows, "k long, run_id long, label string, p double, q double, s double")
    got = {(x.fold, x.feature): x.importance for x in M.permutation_importance(t, ["p", "q", "s"], 4, key=["k"]).collect()}
    assert len(got) == 6 and all(got[f, "p"] > 0.2 > abs(got[f, "q"]) for f in (0, 1))
