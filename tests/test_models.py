"""Model jobs against plain counts: noise, dropped sensors, ablations, components, one model per held-out run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators.evaluation import fold_metrics
from loam.operators.selection import explained_variance
from loam.plans import crossval as M

FEATURES = ["p", "q", "s"]


@pytest.fixture(scope="module")
def table(spark):
    """Three runs; p tells the label, q a little, s nothing."""
    rng, rows = np.random.default_rng(4), []
    for i in range(180):
        c = i % 3
        rows.append((i, i // 60, "abc"[c], float(4 * c + rng.normal()), float(c + 2 * rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "k long, run_id long, label string, p double, q double, s double").cache()


def macro_f1(rows, fold):
    own = [(r["label"], r["pred"]) for r in rows if r["run_id"] == fold]
    out = []
    for c in {a for a, _ in own}:
        tp = sum(a == b == c for a, b in own)
        out.append(2 * tp / (sum(a == c for a, _ in own) + sum(b == c for _, b in own)))
    return np.mean(out)


@pytest.fixture(scope="module")
def scores(table):
    """Macro-F1 of each fold, from its predictions."""
    rows = M.loro_predict(table, FEATURES).collect()
    assert all(abs(sum(r.proba) - 1) < 1e-9 and "abc"[int(np.argmax(r.proba))] == r.pred for r in rows)
    return [macro_f1(rows, f) for f in range(3)]


def test_predictions_are_of_models_that_never_saw_the_run(table, scores):
    # a run whose labels are turned round is predicted as the others have it
    turned = table.withColumn("label", F.when(F.col("run_id") == 1, F.translate("label", "abc", "cab")).otherwise(F.col("label")))
    kept = {r.k: r.pred for r in M.loro_predict(table, FEATURES).where("run_id = 1").collect()}
    assert {r.k: r.pred for r in M.loro_predict(turned, FEATURES).where("run_id = 1").collect()} == kept
    assert min(scores) > 0.8


def test_noise(table, scores):
    got = {r.sigma: r for r in M.noise_sweep(table, FEATURES, [0.0, 0.5, 3.0], 4, key=["k"]).collect()}
    assert got[0.0].macro_f1_mean == pytest.approx(np.mean(scores)) and got[0.0].macro_f1_std == pytest.approx(np.std(scores, ddof=1)) and got[0.0].macro_f1_min == pytest.approx(min(scores))
    assert got[0.0].macro_f1_mean > got[0.5].macro_f1_mean > got[3.0].macro_f1_mean
    again = {r.sigma: r for r in M.noise_sweep(table.repartition(7, "s"), FEATURES, [0.5], 4, key=["k"]).collect()}
    assert again[0.5].macro_f1_mean == pytest.approx(got[0.5].macro_f1_mean)  # another partitioning, the same noise


def test_normals_from_hashes(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(M.hash_normal(F.lit(1), F.col("id"))).collect()])
    y = np.array([r[0] for r in spark.range(20_000).repartition(5).select("id", M.hash_normal(F.lit(2), F.col("id"))).orderBy("id").drop("id").collect()])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.02 and abs((x**4).mean() - 3) < 0.2 and abs(np.corrcoef(x, y)[0, 1]) < 0.03


def test_dropped_sensors(table, scores):
    got = {(r.condition, r["mode"]): r for r in M.sensor_dropout(table, {"good": ["p"], "rest": ["q", "s"]}).collect()}
    base = got["baseline", "none"]
    assert base["mean"] == pytest.approx(np.mean(scores)) and base.delta == 0 and base.n_features == 3
    assert set(got) == {("baseline", "none"), *((c, m) for c in ("good", "rest") for m in ("zeroed", "removed"))}
    only = M.loro_predict(table, ["p"]).collect()
    assert got["rest", "removed"]["mean"] == pytest.approx(np.mean([macro_f1(only, f) for f in range(3)])) and got["rest", "removed"].n_features == 1
    assert got["good", "zeroed"].delta < -0.3 and got["good", "removed"].delta < -0.3 and abs(got["rest", "removed"].delta) < 0.1
    assert got["good", "zeroed"].delta == pytest.approx(got["good", "zeroed"]["mean"] - base["mean"])


def test_ablations(table, scores):
    got = {(r.feature_set, r.fold): r for r in M.ablations(table, {"all": FEATURES, "poor": ["s"]}, top=1).collect()}
    assert len(got) == 9
    assert [got["all", f].macro_f1 for f in range(3)] == pytest.approx(scores)
    only = M.loro_predict(table, ["p"]).collect()  # p tells most, whatever the fold
    assert [got["top_mi", f].macro_f1 for f in range(3)] == pytest.approx([macro_f1(only, f) for f in range(3)])
    assert all(got["poor", f].macro_f1 < 0.6 and got["poor", f].n_features == 1 for f in range(3))


def test_components(spark, table):
    x = np.array([[r.p, r.q, r.s, r.p * 2 + r.q] for r in table.collect()])
    wide = table.withColumn("u", F.col("p") * 2 + F.col("q"))
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    got = {r.component: r.ratio for r in explained_variance(wide, [*FEATURES, "u"], 3).collect()}
    assert got == pytest.approx(dict(enumerate(values[:3] / values.sum())), abs=1e-9)


def test_search_prefers_what_scores_best(table):
    got = M.random_search(table, FEATURES, k=3, draws=2, grid={"regParam": (0.001, 50.0)}).collect()
    assert [r.params for r in got] == ['{"regParam": 0.001}', '{"regParam": 50.0}'] and got[0].macro_f1 > got[1].macro_f1


def test_metrics_of_a_fold(table):
    rows = M.loro_predict(table, ["q"]).select(F.lit("m").alias("model"), F.col("run_id").alias("fold"), "run_id", "label", "pred")
    got = {r.fold: r.macro_f1 for r in fold_metrics(rows, classes="in_test").collect()}
    assert got == pytest.approx({f: macro_f1(rows.collect(), f) for f in range(3)})
