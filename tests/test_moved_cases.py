"""Many cases of a row at once, against a row for each case."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators.evaluation import class_metrics, fold_metrics
from loam.plans import crossval as M
from loam.plans.together import Case, Models, fit

FEATURES = ["q", "b", "z"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, "abc"[i // 3 % 3], *(float(i // 3 % 3 * s + rng.normal()) for s in (2, -1, 0))) for i in range(120)]
    rows[7] = (*rows[7][:3], None, math.nan, 1.0)
    rows[8] = (*rows[8][:3], math.inf, 0.5, None)
    return spark.createDataFrame(rows, "k long, run_id int, label string, q double, b double, z double")


def counted(rows, *by):
    return {tuple(r)[:-1]: r[-1] for r in rows.groupBy(*by).agg(F.sum("_n")).collect()}


@pytest.fixture(scope="module")
def models(table):
    return fit(table, [Case(r, tuple(FEATURES)) for r in range(3)])


def test_steps_along(table, models):
    moved = table.withColumn("_move", F.array(*(F.lit(0.3) * (F.col("k") % 5 - 2 + i) for i in range(3))))
    got = models.predict_along(moved, "run_id", "_move", [0.0, 1.0, 4.0], ["run_id", "label"])
    each = moved.withColumn("place", F.explode(F.array(*map(F.lit, range(3))))).withColumn("_f", F.get(F.array(F.lit(0.0), F.lit(1.0), F.lit(4.0)), F.col("place")))
    each = each.withColumns({f: F.col(f) + F.col("_f") * F.col("_move")[i] for i, f in enumerate(models.features)})
    want = models.predict(each, "run_id").withColumn("_n", F.lit(1))
    keys = ("run_id", "label", "place", "pred")
    assert counted(got, *keys) == counted(want, *keys)


def test_swapped_values(table, models):
    new = F.transform(F.sequence(F.lit(5), F.lit(0), F.lit(-1)), lambda p: F.struct(p.alias("_place"), (F.col("k") % 7 - p).cast("double").alias("_new")))
    got = models.predict_swapped(table.withColumn("_dealt", new), "run_id", "_dealt", 2, ["run_id", "label"])
    each = table.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(6))))
    each = each.withColumns({f: F.when(F.floor(F.col("place") / 2) == i, (F.col("k") % 7 - F.col("place")).cast("double")).otherwise(F.col(f)) for i, f in enumerate(models.features)})
    want = models.predict(each, "run_id").withColumn("_n", F.lit(1))
    keys = ("run_id", "label", "place", "pred")
    assert counted(got, *keys) == counted(want, *keys)


def test_counts_stand_for_rows(spark):
    rows = [("m", 0, "a", "a", 3), ("m", 0, "a", "b", 2), ("m", 0, "b", "b", 1), ("m", 1, "b", "a", 4), ("m", 1, None, "a", 2)]
    few = spark.createDataFrame(rows, "model string, fold int, label string, pred string, n int")
    many = few.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    for f in (class_metrics, fold_metrics):
        assert sorted(map(str, f(few, classes="in_test", count="n").collect())) == sorted(map(str, f(many, classes="in_test").collect()))


def no_rows(*_):
    raise AssertionError("a row per case")


def test_noise_takes_no_row_per_sigma(table, monkeypatch):
    monkeypatch.setattr(Models, "predict", no_rows)
    assert M.noise_sweep(table, FEATURES, [0.0, 1.0], 3, key=["k"]).count() == 2


def test_importance_takes_no_row_per_case(table, monkeypatch):
    monkeypatch.setattr(Models, "predict", no_rows)
    assert M.permutation_importance(table, FEATURES, 3, key=["k"]).count() == 9
