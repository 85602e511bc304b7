"""Leave-one-run-out jobs, all folds together, and the statistics of training folds without copying rows."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.channels import finite
from loam.operators.evaluation import ci95, fold_metrics
from loam.operators.selection import fold_information, hash_rank
from loam.plans.together import Case, Models, fit, moments, pooled, spread
from loam.shared import stored


def fold_sizes(rows: DataFrame, run: str) -> DataFrame:
    per = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n_test"))
    total = per.agg(F.sum("n_test").alias("_all"))
    return per.join(F.broadcast(total)).select(run, (F.col("_all") - F.col("n_test")).alias("n_train"), "n_test")


def standardise(rows: DataFrame, features: Sequence[str], run: str) -> DataFrame:
    """Features less the mean, over the deviation (population), of all other runs' rows; a constant one only less its
    mean. From sums per run, about the first run's means to keep digits."""
    centre = rows.agg(*(F.avg(f).alias(f"_c_{f}") for f in features))
    sums = rows.join(F.broadcast(centre)).groupBy(run).agg(*(g for f in features for g in (F.count(f).alias(f"_n_{f}"), F.sum(F.col(f) - F.col(f"_c_{f}")).alias(f"_s_{f}"), F.sum((F.col(f) - F.col(f"_c_{f}")) * (F.col(f) - F.col(f"_c_{f}"))).alias(f"_q_{f}"))))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per run
    rest = sums.select(run, *(((F.sum(c).over(everything) - F.col(c)).alias(c)) for c in sums.columns if c != run)).join(F.broadcast(centre))
    stats = rest.select(run, *(g for f in features for g in ((F.col(f"_c_{f}") + F.col(f"_s_{f}") / F.col(f"_n_{f}")).alias(f"_m_{f}"), F.sqrt(F.greatest(F.lit(0.0), F.col(f"_q_{f}") / F.col(f"_n_{f}") - (F.col(f"_s_{f}") / F.col(f"_n_{f}")) ** 2)).alias(f"_d_{f}"))))
    joined = rows.join(stats, run)
    return joined.select(*(((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(1.0)).alias(c) if c in features else F.col(c) for c in rows.columns))


def balanced_weights(rows: DataFrame, run: str, label: str = "label") -> DataFrame:
    """run, label, weight = training rows / (training classes x training rows of the class). The grid that is joined has a
    row per run and class, never one per row."""
    per = rows.groupBy(run, label).agg(F.count(F.lit(1)).alias("n"))
    grid = per.select(run).distinct().join(per.select(label).distinct()).join(per, [run, label], "left").fillna(0, ["n"])
    grid = grid.withColumn("_train", F.sum("n").over(Window.partitionBy(label)) - F.col("n")).where("_train > 0")
    w = Window.partitionBy(run)
    return grid.select(run, label, (F.sum("_train").over(w) / (F.count(F.lit(1)).over(w) * F.col("_train"))).alias("weight"))


def group_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """group, n, fold: groups, the largest first (ties by name), each to the fold with the fewest rows so far.

    The walk is over a row per group, on the driver: groups are runs, not rows."""
    sizes = [(r[group], r["n"]) for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()]
    load, out = [0] * k, []
    for g, n in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        fold = load.index(min(load))
        load[fold] += n
        out.append((g, n, fold))
    return rows.sparkSession.createDataFrame(out, f"{group} {rows.schema[group].dataType.simpleString()}, n bigint, fold bigint")


def holdout(rows: DataFrame, share: float, *, label: str = "label", key: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds validation: the first share of each class by hash of the key (at least half of it rounds up). No class is
    brought to one task."""
    n = rows.groupBy(F.col(label).alias("_label")).agg(F.round(F.count(F.lit(1)) * share).alias("_most"))
    ranked = hash_rank(rows, [label], key, seed).join(n, F.col(label).eqNullSafe(F.col("_label")))
    return ranked.withColumn("validation", F.col("_rank") <= F.col("_most")).select(*rows.columns, "validation")


def _estimator(kind: str, seed: int, params: dict | None = None):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    shared = {"featuresCol": "_z", "labelCol": "_y", "weightCol": "_w", "probabilityCol": "_p", "predictionCol": "_k", "rawPredictionCol": "_r"}
    if kind == "logistic":
        return LogisticRegression(**({"maxIter": 50, "regParam": 1e-3} | (params or {})), **shared)
    if kind == "forest":
        return RandomForestClassifier(**({"numTrees": 20, "maxDepth": 6} | (params or {})), seed=seed, **shared)
    raise ValueError(f"unknown model: {kind}")


def _runs_of(table: DataFrame, run: str) -> list:
    """The runs: a row each for the driver."""
    return sorted(r[run] for r in table.select(run).distinct().collect() if r[run] is not None)


def fit_cases(table: DataFrame, cases: Sequence[Case], *, kind: str = "logistic", run: str = "run_id", label: str = "label", balanced: bool = True, seed: int = 42, params: dict | None = None):
    """Models of all cases, with `predict(rows, case)` for rows whose column `case` numbers their model. Logistic models
    are fitted together, a pass over the table per step for all of them; forests one after another by pyspark.ml."""
    cases = [Case(c.held, tuple(c.features), {**(params or {}), **c.params}) for c in cases]
    if kind == "logistic":
        return fit(table, cases, run=run, label=label, balanced=balanced)
    return _Separate(table, cases, kind, run, label, balanced, seed)


class _Separate:
    """A fitted pipeline per case. Each fit is a distributed job on the table, which is written once to the shared folder."""

    def __init__(self, table: DataFrame, cases: Sequence[Case], kind: str, run: str, label: str, balanced: bool, seed: int):
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        self.features = sorted({f for c in cases for f in c.features})
        clean = stored(finite(table.where(F.col(label).isNotNull()), self.features).select(run, label, *self.features), "folds")
        sizes = clean.groupBy(run, label).count().collect()  # a row per fold and class
        self.names, self.models = sorted({r[label] for r in sizes}), []
        for case in cases:
            counts: dict = {}
            for r in sizes:
                if r[run] != case.held:
                    counts[r[label]] = counts.get(r[label], 0) + r["count"]
            classes, n = sorted(counts), sum(counts.values())
            index = F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))))
            weight = F.create_map(*(x for c in classes for x in (F.lit(c), F.lit(n / len(classes) / counts[c] if balanced else 1.0))))
            train = clean.where(F.col(run) != case.held).withColumn("_y", index[F.col(label)]).withColumn("_w", weight[F.col(label)])
            stages = [VectorAssembler(inputCols=list(case.features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), _estimator(kind, seed, case.params)]
            self.models.append((Pipeline(stages=stages).fit(train), classes))

    def predict(self, rows: DataFrame, case: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        parts = []
        for i, (model, classes) in enumerate(self.models):
            place = {c: k for k, c in enumerate(classes)}
            out = model.transform(finite(rows.where(F.col(case) == i), self.features)).withColumn("_a", vector_to_array("_p"))
            proba = F.array(*(F.col("_a")[place[c]] if c in place else F.lit(0.0) for c in self.names))
            parts.append(out.select(*(c for c in rows.columns if c.lower() not in ("proba", "pred")), proba.alias("proba"), F.get(F.array(*map(F.lit, classes)), F.col("_k").cast("int")).alias("pred")))
        return functools.reduce(DataFrame.unionByName, parts)


def _cast_of(table: DataFrame, run: str, rows: Sequence[tuple], extra: str) -> DataFrame:
    """table with the columns of rows (run, ...), given as DDL: each of its rows once for every one of its run. A row per
    run and model is broadcast."""
    small = table.sparkSession.createDataFrame(list(rows), f"_held {table.schema[run].dataType.simpleString()}, {extra}")
    return table.join(F.broadcast(small), F.col(run) == F.col("_held")).drop("_held")


def loro_predict(table: DataFrame, features: Sequence[str], *, run: str = "run_id", label: str = "label", **options) -> DataFrame:
    """Every row that has a run, predicted by the model that never saw its run: one pass for all."""
    runs = _runs_of(table, run)
    models = fit_cases(table, [Case(r, tuple(features)) for r in runs], run=run, label=label, **options)
    return models.predict(_cast_of(table, run, [(r, i) for i, r in enumerate(runs)], "_case int"), "_case").drop("_case")


def ablations(table: DataFrame, sets: dict[str, Sequence[str]], *, top: int = 15, run: str = "run_id", label: str = "label", **options) -> DataFrame:
    """feature_set, fold, n_features, accuracy, macro_f1: leave-one-run-out with each set of features, and with "top_mi",
    for each fold the `top` features of all sets that tell most about the label in its training rows. All sets and folds
    are fitted together."""
    every = sorted({f for own in sets.values() for f in own})
    best = fold_information(table, every, run=run, label=label)
    order = Window.partitionBy(run).orderBy(F.col("mi").desc(), "feature")
    chosen: dict[object, list[str]] = {}
    for r in best.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).collect():  # a few rows per fold
        chosen.setdefault(r[run], []).append(r["feature"])
    made = [(name, Case(r, tuple(own[r] if isinstance(own, dict) else own))) for name, own in {**sets, "top_mi": chosen}.items() for r in _runs_of(table, run)]
    models = fit_cases(table, [c for _, c in made], run=run, label=label, **options)
    rows = _cast_of(table, run, [(c.held, i, name, len(c.features)) for i, (name, c) in enumerate(made)], "_case int, feature_set string, n_features int")
    done = models.predict(rows, "_case").select("feature_set", "n_features", F.col(run).alias("fold"), label, "pred")
    return fold_metrics(done, keys=("feature_set", "n_features"), label=label, classes="in_test")


#: Values to draw from, by model.
GRIDS = {"logistic": {"regParam": (0.1, 0.01, 0.001)}, "forest": {"numTrees": (20, 50, 100), "maxDepth": (5, 10, 15), "minInstancesPerNode": (1, 2, 4)}}


def random_search(table: DataFrame, features: Sequence[str], *, kind: str = "logistic", run: str = "run_id", label: str = "label", draws: int = 10, k: int = 4, grid: dict | None = None, seed: int = 42) -> DataFrame:
    """draw, params (JSON), macro_f1: settings drawn from the grid without repeats, each scored over k folds of whole
    runs (macro-F1 over the classes of the fold), the best first."""
    import itertools
    import json
    import random

    grid = GRIDS[kind] if grid is None else grid
    every = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    chosen = random.Random(seed).sample(every, min(draws, len(every)))
    folded = stored(table.join(group_folds(table, run, k).select(run, "fold"), run), "folds")
    made = [(i, Case(held, tuple(features), params)) for i, params in enumerate(chosen) for held in _runs_of(folded, "fold")]
    models = fit_cases(folded, [c for _, c in made], kind=kind, run="fold", label=label, seed=seed)
    rows = models.predict(_cast_of(folded, "fold", [(c.held, n, i) for n, (i, c) in enumerate(made)], "_case int, draw int"), "_case").select("draw", "fold", label, "pred")
    score = fold_metrics(rows, keys=("draw",), label=label, classes="in_test").groupBy("draw").agg(F.avg("macro_f1").alias("macro_f1"))
    names = table.sparkSession.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(chosen)], "draw int, params string")
    return score.join(names, "draw").orderBy(F.col("macro_f1").desc(), "draw").select("draw", "params", "macro_f1")


def hash_normal(*of: Column) -> Column:
    """A standard normal number that follows from the hash of these columns alone, wherever the row lies."""
    even = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *of), 11) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.ln(even(1))) * F.cos(2 * math.pi * even(2))


def noise_sweep(table: DataFrame, features: Sequence[str], sigmas: Sequence[float], repeats: int, *, key: Sequence[str], run: str = "run_id", label: str = "label", seed: int = 7, **options) -> DataFrame:
    """sigma, mean, std (sample) and least macro-F1 (over the fold's classes) of folds whose test rows got noise of sigma
    training deviations. Models are fitted once; noise is drawn for all sigmas and repeats at once, from hashes of
    key, feature and repeat: another partitioning or cluster draws the same. The sigmas of a repeat share its draws."""
    runs = _runs_of(table, run)
    models = fit_cases(table, [Case(r, tuple(features)) for r in runs], run=run, label=label, **options)
    keys, n, mean, var = moments(finite(table.where(F.col(run).isNotNull()).select(run, *(F.col(f).cast("double").alias(f) for f in features)), features), features, [run])
    std = {}
    for i, (r,) in enumerate(keys):
        rest = np.arange(len(keys)) != i
        std[r] = np.sqrt(pooled(n[rest], mean[rest], var[rest])[1] / max(n[rest].sum(), 1.0)).tolist()
    test = _cast_of(table, run, [(r, i, std[r]) for i, r in enumerate(runs)], "_case int, _std array<double>")
    test = spread(test, int(n.sum()) * repeats, 50_000)
    normal = lambda f: hash_normal(F.lit(seed), F.lit(f), F.col("rep"), *map(F.col, key))
    test = test.withColumn("rep", F.explode(F.array(*map(F.lit, range(repeats)))))
    if isinstance(models, Models):  # all sigmas of a row's draw at once
        at = {f: i for i, f in enumerate(features)}
        noisy = test.withColumn("_noise", F.array(*(F.col("_std")[at[f]] * normal(f) for f in models.features)))
        rows = models.predict_along(noisy, "_case", "_noise", sigmas, [run, label, "rep"])
        sigma = F.get(F.array(*(F.lit(float(s)) for s in sigmas)), F.col("place"))
        per = fold_metrics(rows.withColumnRenamed(run, "fold").withColumn("sigma", sigma), keys=("sigma", "rep"), label=label, classes="in_test", count="_n")
    else:
        test = test.withColumn("sigma", F.explode(F.array(*(F.lit(float(s)) for s in sigmas))))
        noisy = test.withColumns({f: F.col(f) + F.col("sigma") * F.col("_std")[i] * normal(f) for i, f in enumerate(features)})
        rows = models.predict(noisy.drop("_std"), "_case").select("sigma", "rep", F.col(run).alias("fold"), label, "pred")
        per = fold_metrics(rows, keys=("sigma", "rep"), label=label, classes="in_test")
    mean = per.groupBy("sigma", "fold").agg(F.avg("macro_f1").alias("m"))
    return mean.groupBy("sigma").agg(F.avg("m").alias("macro_f1_mean"), F.stddev_samp("m").alias("macro_f1_std"), F.min("m").alias("macro_f1_min"))


def sensor_dropout(table: DataFrame, groups: dict[str, Sequence[str]], *, run: str = "run_id", label: str = "label", **options) -> DataFrame:
    """condition, mode, n_features, n, mean, std, worst, margin, delta to the baseline: each group of features zeroed at
    test time, or left out of training and test."""
    features = [f for g in groups.values() for f in g]
    rests = {name: tuple(f for f in features if f not in group) for name, group in groups.items()}
    runs = _runs_of(table, run)
    cases, conditions = [], []
    for name, used in {None: tuple(features), **{g: rest for g, rest in rests.items() if rest}}.items():
        for r in runs:
            if name is None:
                conditions += [(r, len(cases), "baseline", "none", len(features)), *((r, len(cases), g, "zeroed", len(features)) for g in groups)]
            else:
                conditions.append((r, len(cases), name, "removed", len(used)))
            cases.append(Case(r, used))
    models = fit_cases(table, cases, run=run, label=label, **options)
    rows = _cast_of(table, run, conditions, "_case int, condition string, mode string, n_features int")
    rows = rows.withColumns({f: F.when((F.col("mode") == "zeroed") & F.col("condition").isin(*(g for g, own in groups.items() if f in own)), 0.0).otherwise(F.col(f)) for f in features})
    rows = models.predict(rows, "_case").select("condition", "mode", "n_features", F.col(run).alias("fold"), label, "pred")
    keys = ["condition", "mode", "n_features"]
    out = ci95(fold_metrics(rows, keys=keys, label=label, classes="in_test"), keys, "macro_f1")
    base = out.where("condition = 'baseline'").select(F.col("mean").alias("_base"))
    return out.join(F.broadcast(base)).withColumn("delta", F.col("mean") - F.col("_base")).drop("_base")


def permutation_importance(table: DataFrame, features: Sequence[str], repeats: int = 8, *, run: str = "run_id", label: str = "label", key: Sequence[str], seed: int = 3, **options) -> DataFrame:
    """fold, feature, importance: the mean drop of macro-F1 on the held-out run when the feature's values are dealt out
    anew among its rows (values in hash order meet rows in key order)."""
    runs = _runs_of(table, run)
    models = fit_cases(table, [Case(r, tuple(features)) for r in runs], run=run, label=label, **options)
    test = _cast_of(table, run, [(r, i) for i, r in enumerate(runs)], "_case int")
    numbered = test.withColumn("_row", F.row_number().over(Window.partitionBy(run).orderBy(*key)))
    # a value per case: a feature, a repeat; all cases of all folds are dealt in one pass, by few and narrow columns
    order_of = list(models.features) if isinstance(models, Models) else list(features)
    values = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(i).alias("_f"), F.col(f).cast("double").alias("_new")) for i, f in enumerate(order_of)))
    dealt = spread(test, table.count() * len(features) * repeats, 1 << 20).select(run, *key, F.explode(values).alias("_v")).select(run, *key, "_v.*").withColumn("_at", F.explode(F.sequence(F.lit(seed), F.lit(seed + repeats - 1))))
    place = F.col("_f") * repeats + F.col("_at") - seed
    dealt = dealt.select(run, *key, place.alias("_place"), "_new", F.xxhash64("_at", "feature", *key).alias("_hash"))
    order = Window.partitionBy(run, "_place").orderBy("_hash", *key)
    other = dealt.select(run, "_place", "_new", F.row_number().over(order).alias("_row"))
    if isinstance(models, Models):  # a row takes all its cases' values at once
        mixed = numbered.join(other.groupBy(run, "_row").agg(F.collect_list(F.struct("_place", F.coalesce("_new", F.lit(0.0)).alias("_new"))).alias("_dealt")), [run, "_row"])
        rows, count = models.predict_swapped(mixed, "_case", "_dealt", repeats, [run, label]).withColumn("_place", F.col("place")), "_n"
    else:
        mixed = numbered.join(other, [run, "_row"]).withColumns({f: F.when(F.floor(F.col("_place") / repeats) == i, F.col("_new")).otherwise(F.col(f)) for i, f in enumerate(order_of)})
        cases = test.withColumn("_place", F.lit(len(order_of) * repeats)).unionByName(mixed.select(*test.columns, "_place"))
        rows, count = models.predict(cases, "_case"), None
    names = F.get(F.array(*map(F.lit, order_of)), F.floor(F.col("_place") / repeats).cast("int"))
    named = rows.select(F.coalesce(names, F.lit("")).alias("feature"), F.when(names.isNull(), -1).otherwise(F.col("_place") % repeats).alias("rep"), F.col(run).alias("fold"), label, "pred", *([count] if count else []))
    per = fold_metrics(named, keys=("feature", "rep"), label=label, classes="in_test", count=count)
    base = per.where("rep = -1").select("fold", F.col("macro_f1").alias("_base"))
    return per.where("rep >= 0").join(base, "fold").groupBy("fold", "feature").agg(F.avg(F.col("_base") - F.col("macro_f1")).alias("importance"))
