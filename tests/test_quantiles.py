"""Exact quantiles and nearest-neighbour information without whole columns in one task, against plain NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import nearest as N
from loam.operators.quantiles import exact_quantiles
from loam.operators.selection import knn_information

PROBS = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]


def test_quantiles_of_few_and_many_rows(spark):
    rng = np.random.default_rng(1)
    columns = {"few": rng.normal(size=7), "one": np.array([3.5]), "many": np.exp(rng.normal(size=30_000) * 9), "ties": rng.integers(0, 3, 20_000).astype(float), "flat": np.full(9_000, 2.0), None: rng.normal(size=12_000)}
    rows = [(k, float(v)) for k, x in columns.items() for v in x] + [("few", None), ("none", None)]
    table = spark.createDataFrame(rows, "key string, v double").repartition(6)
    got = {r.key: r for r in exact_quantiles(table, "v", PROBS, ["key"], small=5_000, error=1e-3).collect()}
    assert got.keys() == columns.keys()
    for key, x in columns.items():
        assert got[key].n == len(x) and got[key].q == pytest.approx(np.quantile(x, PROBS).tolist(), rel=1e-12), key
    whole = exact_quantiles(table, "v", [0.25], small=100, error=1e-3).first()
    assert whole.q == pytest.approx([np.quantile([v for _, v in rows if v is not None], 0.25)])
    assert exact_quantiles(table.where("false"), "v", PROBS, ["key"]).collect() == []


def test_digamma():
    want = -np.euler_gamma + np.cumsum(np.r_[0.0, 1 / np.arange(1, 9000)])
    assert N.psi(np.arange(1, 9001)) == pytest.approx(want, abs=1e-12)


def test_farthest_double():
    r = random.Random(3)
    x = np.array([0.0, -0.0, 1.0, -1e10, 1e-300, 5.5] + [r.uniform(-5, 5) for _ in range(200)])
    radius = np.array([0.0, 1.0, 1e-17, 1e10, 3.0, 0.1] + [r.random() * 3 for _ in range(200)])
    y = N.farthest(x, radius)
    assert (y - x <= radius).all() and (np.nextafter(y, np.inf) - x > radius).all()


@pytest.mark.parametrize("chunk", [25, 400, 100_000])
def test_information_is_that_of_whole_columns(spark, chunk):
    rng = np.random.default_rng(chunk)
    n = 700
    label = np.array(["a", "b", "c", "rare", "once"])[np.minimum(rng.choice(5, n, p=[0.5, 0.3, 0.187, 0.012, 0.001]), 4)]
    label[0], label[1:3] = "once", "rare"
    label[label == "once"] = "b"
    label[0] = "once"
    x = {"plain": rng.normal(size=n), "follows": (label == "a") * 2.0 + rng.normal(size=n), "ties": rng.integers(0, 9, n).astype(float), "flat": np.zeros(n), "holes": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)), "far": np.where(label == "rare", rng.choice([-1e6, 1e6], n), rng.normal(size=n))}
    rows = [(str(label[i]), *(float(v[i]) for v in x.values())) for i in range(n)]
    table = spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in x)).repartition(4)
    got = {r.feature: r.mi for r in N.mi_knn(table, list(x), chunk_rows=chunk).collect()}
    want = {c: knn_information(np.nan_to_num(v), label) for c, v in x.items()}
    assert got == pytest.approx(want, abs=1e-9)


def test_information_by_key_and_of_single_classes(spark):
    rows = [(f, lab, float(v)) for f in (1, 2) for v, lab in enumerate("aabbcabc")] + [(3, "x", 1.0), (3, "y", 2.0), (4, None, 1.0), (4, None, 5.0)]
    table = spark.createDataFrame(rows, "fold int, label string, v double")
    got = {r.fold: r.mi for r in N.mi_knn(table, ["v"], keys=["fold"], k=2, chunk_rows=3).collect()}
    one = knn_information(np.arange(8.0), np.array(list("aabbcabc")), 2)
    assert got == pytest.approx({1: one, 2: one, 3: 0.0, 4: 0.0}, abs=1e-9)
    assert N.mi_knn(table.where("false"), ["v"]).collect() == []


def test_a_long_column_is_spread(spark):
    table = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("label"), (F.rand(1) + F.col("id") % 3).alias("v"))
    assert N.mi_knn(table, ["v"], chunk_rows=20_000).first().mi == pytest.approx(np.log(3), abs=0.01)
