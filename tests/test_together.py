"""Models that are fitted together against pyspark.ml, one fit per fold, and against a minimiser's own conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.plans import together as G
from loam.plans.crossval import _Separate, fit_cases, loro_predict
from loam.plans.together import Case, fit

FEATURES = ("p", "q", "s", "flat")
DDL = "k long, run_id string, label string, p double, q double, s double, flat double, proba string"


def rows_of(classes, n=240, seed=1):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        c = int(rng.integers(len(classes)))
        out.append((i, f"r{i % 4}", classes[c], float(100 + 2 * c + rng.normal()), float(c * rng.normal()), float(1e-3 * rng.normal()), 7.0, "clash"))
    return out


def single_fit(table, held, features, reg, kind="logistic"):
    """Probabilities of the held run's rows from one pyspark.ml pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train = table.where(F.col("run_id") != held)
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    classes, n = sorted(counts), sum(counts.values())
    index = F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))))
    weight = F.create_map(*(x for c in classes for x in (F.lit(c), F.lit(n / len(classes) / counts[c]))))
    stages = [VectorAssembler(inputCols=list(features), outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=reg, maxIter=500, tol=1e-12)]
    model = Pipeline(stages=stages).fit(train.withColumn("y", index[F.col("label")]).withColumn("w", weight[F.col("label")]))
    got = model.transform(table.where(F.col("run_id") == held)).select("k", vector_to_array("probability").alias("a")).collect()
    return {r.k: dict(zip(classes, r.a)) for r in got}


@pytest.mark.parametrize("classes", ["ab", "abc"])
def test_equal_to_single_fits(spark, classes):
    table = spark.createDataFrame(rows_of(classes), DDL).repartition(3).cache()
    cases = [Case("r1", FEATURES), Case("r2", ("p", "q"), {"regParam": 0.1}), Case("r1", ("q", "s"), {"regParam": 0.01})]
    models = fit(table, cases)
    for i, case in enumerate(cases):
        want = single_fit(table, case.held, case.features, case.params.get("regParam", 1e-3))
        got = models.predict(table.where(F.col("run_id") == case.held).withColumn("_m", F.lit(i)), "_m").select("k", F.col("pred"), F.element_at("proba", 1).alias("first")).collect()
        assert len(got) == len(want) == 60
        for r in got:
            assert r.first == pytest.approx(want[r.k]["a"], abs=2e-4)
            assert r.pred == max(want[r.k], key=want[r.k].get) or max(want[r.k].values()) < 0.5002


def test_sums_in_levels_and_models_in_several_passes(spark, monkeypatch):
    table = spark.createDataFrame(rows_of("abc"), DDL).repartition(9)
    cases = [Case(f"r{i}", ("p", "q")) for i in range(4)]
    whole = fit(table, cases)
    monkeypatch.setattr(G, "FAN", 2)
    monkeypatch.setattr(G, "PASS", 20)
    monkeypatch.setattr(G, "SCORES", 30)
    parts = fit(table, cases)
    assert np.allclose(whole.a, parts.a, atol=1e-3) and np.allclose(whole.b, parts.b, rtol=1e-4, atol=1e-3)


def test_classes_that_only_the_held_run_has(spark):
    rows = [(*r[:2], "z" if r[1] == "r3" and r[0] % 8 == 3 else r[2], *r[3:]) for r in rows_of("ab")]
    got = loro_predict(spark.createDataFrame(rows, DDL).drop("proba"), ["p", "q"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(sum(r.proba) - 1) < 1e-9 and (r.run_id != "r3" or (r.proba[2] == 0 and r.pred != "z"))


def test_nulls_and_what_is_not_finite(spark):
    rows = rows_of("ab")
    odd = [(1000, "r0", "a", None, float("nan"), float("inf"), 7.0, None), (1001, None, "a", 1.0, 1.0, 1.0, 7.0, None), (1002, "r1", None, 100.0, 0.0, 0.0, 7.0, None)]
    zero = [(1000, "r0", "a", 0.0, 0.0, 0.0, 7.0, None)]
    got = {r.k: r for r in loro_predict(spark.createDataFrame(rows + odd, DDL).drop("proba"), list(FEATURES)).collect()}
    want = {r.k: r for r in loro_predict(spark.createDataFrame(rows + zero, DDL).drop("proba"), list(FEATURES)).collect()}
    assert set(got) == set(want) | {1002}  # a row without a run has no model, one without a label has a prediction
    assert all(got[k].proba == pytest.approx(want[k].proba, abs=1e-4) for k in want) and got[1000].p is None
    with pytest.raises(ValueError):
        fit(spark.createDataFrame([], DDL), [Case("r0", ("p",))])
    with pytest.raises(ValueError):
        fit(spark.createDataFrame(rows[:1], DDL), [Case("r0", ("p",))])


def test_one_class_and_constant_features(spark):
    table = spark.createDataFrame([(i, f"r{i % 2}", "a", 1.0, 2.0, 3.0, 7.0, "") for i in range(20)], DDL).drop("proba")
    assert all(r.pred == "a" and r.proba == [1.0] for r in loro_predict(table, list(FEATURES)).collect())


def test_forests_go_one_by_one(spark):
    table = spark.createDataFrame(rows_of("abc"), DDL).drop("proba")
    models = fit_cases(table, [Case("r0", ("p", "q")), Case("r1", ("p",), {"numTrees": 5})], kind="forest")
    assert isinstance(models, _Separate)
    got = models.predict(table.where("run_id in ('r0', 'r1')").withColumn("_m", F.expr("if(run_id = 'r0', 0, 1)")), "_m").collect()
    assert len(got) == 120 and np.mean([r.pred == r.label for r in got]) > 0.5
